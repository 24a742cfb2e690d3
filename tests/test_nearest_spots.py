"""Nearest forms against every pair, empty mentions and missing places included."""

import random

from tessera.operators import mentions as mn


def test_nearest_by_every_pair(spark):
    rng = random.Random(5)
    names = ["Ann", "ann lee", "Lee", "Ann Lee", "old Ann", "", "x"]
    forms = [(rng.choice("ab"), rng.choice(names), rng.choice([None, *range(9)]), s) for s in range(60)]
    asked = [(q, rng.choice("abc"), rng.choice([*names, None]), rng.choice([None, *range(9)])) for q in range(80)]

    def best(q, doc, mention, offset):
        if mention is None:
            return None
        met = [f for f in forms if f[0] == doc and len(f[1]) > len(mention) and (f[1].lower().startswith(mention.lower()) or f[1].lower().endswith(mention.lower()))]
        far = lambda f: (0, 0, 0) if offset is None else (2, 0, 0) if f[2] is None else (int(f[2] != offset), int(f[2] > offset), abs(f[2] - offset))
        return min(met, key=lambda f: (far(f), f[3]))[1] if met else mention

    got = mn.nearest_related(spark.createDataFrame(asked, "query_id int, doc_id string, mention string, offset int"), spark.createDataFrame(forms, "doc_id string, surface string, at int, seq int"))
    assert {r.query_id: r.surface for r in got.collect()} == {a[0]: best(*a) for a in asked}
