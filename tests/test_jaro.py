"""Jaro and Jaro-Winkler in the JVM against plain Python."""

import random

import pytest

from tessera.functions import similarity as sim


def plain_jaro(a, b):
    if not a or not b:
        return 0.0
    reach, taken, left = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    right = [c for c, t in zip(b, taken) if t]
    m, moved = len(left), sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3 if m else 0.0


def plain_winkler(a, b):
    s = plain_jaro(a, b)
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return s + same * 0.1 * (1 - s) if s > 0.7 else s


def test_against_plain_python(spark):
    rng = random.Random(3)
    make = lambda: "".join(rng.choices("abcé漢\U0001f600 \0", k=rng.randrange(0, 12)))
    pairs = [(make(), make()) for _ in range(1500)] + [("martha", "marhta"), ("dwayne", "duane"), ("a", "a"), ("a", "b"), ("", ""), ("x" * 400, "x" * 399 + "y"), (None, "a"), ("a", None), ("", None)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    out = df.select("k", sim.jaro("a", "b").alias("j"), sim.jaro_winkler("a", "b").alias("w"))
    for r in out.collect():
        a, b = pairs[r.k]
        want = (None, None) if a is None or b is None else (plain_jaro(a, b), plain_winkler(a, b))
        assert (r.j, r.w) == (want if want[0] is None else pytest.approx(want, abs=1e-12)), (a, b)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string").select(*(c.alias(k) for k, c in sim.string_features(*map(__import__("pyspark").sql.functions.col, ("a", "b"))).items()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
