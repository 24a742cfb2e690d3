"""The digest columns of personal data against spans taken from the texts by hand, through Spark."""

from __future__ import annotations

import hashlib

from tessera.llm import pii


def test_digests_and_redaction_through_spark(spark):
    text = "mail a.b@c.org or +1 (555) 010-2030 from 10.0.0.1 card 4111 1111 1111 1111"
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "nothing here"), (None, "x@y.zz " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_spans, r.base_sha256) for r in pii.digests(docs).collect()), key=str)
    line = "email:5:14,phone:18:35,ip:41:49,card:55:74"
    one = (1, 1, 1, 1, 1, 4, hashlib.sha256(line.encode()).hexdigest())
    none = hashlib.sha256(b"").hexdigest()
    many = ",".join(f"email:{7 * k}:{7 * k + 6}" for k in range(3000))
    want = [one, one, *((k, 0, 0, 0, 0, 0, none) for k in (2, 3, 4)), (None, 3000, 0, 0, 0, 3000, hashlib.sha256(many.encode()).hexdigest())]
    assert got == sorted(want, key=str)
    kept = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert kept[1] == "mail [EMAIL] or [PHONE] from [IP] card [CARD]" and kept[2] is None and kept[4] == "nothing here"
    assert pii.digests(docs.limit(0)).count() == 0
