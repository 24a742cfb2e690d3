"""Whole license texts: mandatory wording must match to the end, the third BSD clause tells the two apart."""

import random

import pytest

from tessera.llm import license_templates as lt

CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def text_of(label):
    """A text that a template is meant for, with holders filled in and optional regions kept."""
    template = dict(lt.TEMPLATES)[label]
    for mark in ("<<optional>>", "<<end>>"):
        template = template.replace(mark, " ")
    return template.replace(lt.HOLDER, "Regents of the Example University").split()


def labels_of(text):
    words = [w for w in text]
    return {auto.label for auto, _ in lt.automata() for k in range(len(words)) if auto.label.endswith("-text") and auto.accept([w.lower() for w in words], k)}


@pytest.mark.parametrize("label", ["mit-text", "bsd-2-text", "bsd-3-text", "isc-text"])
def test_every_mandatory_word_counts(label):
    words, rng = text_of(label), random.Random(1)
    assert labels_of(["x", *words, "y"]) == {label}
    holder = {k for k, w in enumerate(words) if w in "Regents of the Example University".split()}
    kept = {k for k, w in enumerate(words) if w in ("1", "2", "3", "or")}
    for k in rng.sample(sorted(set(range(40, len(words))) - holder - kept), 25):
        for altered in ([*words[:k], "changed", *words[k + 1 :]], [*words[:k], "added", *words[k:]] if k - 1 not in holder and k not in holder else words[:-1]):
            assert label not in labels_of(altered), (k, words[k])
    assert labels_of(words[: len(words) // 2]) == set()


def test_query_tells_the_texts_apart(spark):
    two, three = " ".join(text_of("bsd-2-text")), " ".join(text_of("bsd-3-text"))
    mit = " ".join(text_of("mit-text"))
    rows = [(1, f"Copyright. {two}."), (2, three), (3, mit.replace("noninfringement", "something else")), (4, f"{mit}\n\n{two}"), (5, mit.upper()), (6, None)]
    got = {r.doc_id: r.labels for r in lt.labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "bsd-2-text", 2: "bsd-3-text", 3: "", 4: "bsd-2-text,mit-text", 5: "mit-text", 6: ""}
