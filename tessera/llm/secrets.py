"""Secrets: base patterns as they match, and encoded candidates that are reported once their structure holds.

Runs of base64 or hex letters, armoured blocks and dotted tokens are candidates.  Each is decoded
and read to its end before it counts: DER lengths must nest without a byte left over and make one of
the known shapes of a private key, an OpenSSH container must hold as many keys as it says in strings
of the stated lengths, a signed token must have a JSON header that names an algorithm, a JSON body and
a signature of that algorithm's length.  Text inside an encoding is searched in turn, DEPTH levels deep.

Kinds beside the base ones: ``private_key``, ``ssh_key``, ``signed_token``, and ``wrapped`` for an
encoding of text that holds one of these.  Confirmed spans may overlap base spans, and say more than these.

Edge cases: null texts are empty; empty texts have no spans; offsets count code points, the end is
exclusive; repeated rows come back as often; a text may be of any length, as every pattern reads it once;
other columns are kept by ``mask`` and not read by ``digests`` and ``spans``.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import bounded_batches

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "private_key", "ssh_key", "signed_token", "wrapped")
DEPTH = 3
Span = tuple[int, int, int]

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# From the start of a run to its end: the same matches as of all runs, without those that are too short.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")

_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\n|\\r)++)-----END \1-----")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{10,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]{16,}+)(?!\.[A-Za-z0-9_-])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}(?![A-Za-z0-9+/=_-])")
_HEX_ANY = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{64,}+(?![0-9A-Za-z])")
_SPACE = re.compile(r"\\[nr]|\s")

#: Bytes of the signature of each algorithm of signed tokens (RFC 7518, RFC 8037): exact, or at least so many for RSA.
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EDDSA": 64}
RSA_SIGNATURE, RSA_ALGORITHMS = 128, ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")

Value = tuple[int, "bytes | list[Value]"]


def der(data: bytes, lo: int = 0, hi: int | None = None, depth: int = 0) -> list[Value] | None:
    """The values (tag, bytes or values inside) that fill ``data[lo:hi]``, or None if lengths do not nest exactly."""
    hi, out = len(data) if hi is None else hi, []
    while lo < hi:
        if hi - lo < 2 or depth > 12 or data[lo] & 0x1F == 0x1F:
            return None
        tag, size, lo = data[lo], data[lo + 1], lo + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or lo + n > hi or data[lo] == 0:
                return None
            size, lo = int.from_bytes(data[lo : lo + n]), lo + n
            if size < 0x80:
                return None
        if lo + size > hi:
            return None
        inside: bytes | list[Value] | None = der(data, lo, lo + size, depth + 1) if tag & 0x20 else data[lo : lo + size]
        if inside is None:
            return None
        out.append((tag, inside))
        lo += size
    return out


def private_key(data: bytes) -> bool:
    """Whether ``data`` is one DER value in the shape of a private key: PKCS 1, SEC 1, DSA, PKCS 8, plain or encrypted."""
    if len(data) < 40 or data[0] != 0x30 or (whole := der(data)) is None or len(whole) != 1:
        return False
    parts = whole[0][1]
    tags = [t for t, _ in parts]
    if tags[:1] == [0x02]:
        version = int.from_bytes(parts[0][1])
        if tags == [0x02] * 9 or tags == [0x02] * 6:
            return version == 0 and all(len(v) > 0 for _, v in parts) and len(parts[1][1]) >= 32
        if tags[:2] == [0x02, 0x04]:
            return version == 1 and len(parts[1][1]) >= 20 and set(tags[2:]) <= {0xA0, 0xA1}
        if tags[:3] == [0x02, 0x30, 0x04] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
            return version in (0, 1) and parts[1][1][:1] != [] and parts[1][1][0][0] == 0x06 and len(parts[2][1]) >= 20
        return False
    return tags == [0x30, 0x04] and parts[0][1][:1] != [] and parts[0][1][0][0] == 0x06 and len(parts[0][1]) == 2 and len(parts[1][1]) >= 32 and len(parts[1][1]) % 8 == 0


def ssh_key(data: bytes) -> bool:
    """Whether ``data`` is an OpenSSH private key container: strings of stated lengths, up to the last byte."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(data) or at + 4 + (n := int.from_bytes(data[at : at + 4])) > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    names = [string() for _ in range(3)]
    if None in names or at + 4 > len(data) or not 1 <= (keys := int.from_bytes(data[at : at + 4])) <= 64:
        return False
    at += 4
    if any(string() is None for _ in range(keys)):
        return False
    private = string()
    return private is not None and at == len(data) and len(private) >= 32 and len(private) % 8 == 0 and (names[0] != b"none" or private[:4] == private[4:8])


def _base64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(data: bytes | None) -> dict | None:
    try:
        found = json.loads(data.decode()) if data and data[:1] == b"{" else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_token(head: str, body: str, signature: str) -> bool:
    """Whether the header names an algorithm whose signatures have this length, and the body is a JSON object."""
    named = _json(_base64(head))
    if named is None or not isinstance(named.get("alg"), str) or _json(_base64(body)) is None:
        return False
    signed, algorithm = _base64(signature), named["alg"].upper()
    return signed is not None and (len(signed) == SIGNATURE.get(algorithm) or algorithm in RSA_ALGORITHMS and len(signed) >= RSA_SIGNATURE)


def _kind_of(data: bytes | None, depth: int) -> int | None:
    """The kind that the decoded bytes confirm: a key, or text with a confirmed secret inside."""
    if data is None:
        return None
    if private_key(data):
        return 3
    if ssh_key(data):
        return 4
    if depth < DEPTH and len(data) >= 40 and not data.translate(None, _PRINTABLE):
        return 6 if confirmed(data.decode("ascii"), depth + 1) else None
    return None


_PRINTABLE = bytes([9, 10, 13, *range(32, 127)])


def confirmed(text: str, depth: int = 0) -> list[Span]:
    """(start, end, kind's number) of candidates whose structure holds; none lies inside another."""
    found: list[Span] = []
    if "-----BEGIN " in text:
        for m in _ARMOUR.finditer(text):
            if (kind := _kind_of(_base64(_SPACE.sub("", m[2])), DEPTH)) is not None:
                found.append((m.start(), m.end(), kind))
    if "." in text and "ey" in text:
        found += [(m.start(), m.end(), 5) for m in _TOKEN.finditer(text) if m[0].startswith("ey") and signed_token(*m.groups())]
    for pattern, decode in ((_HEX_ANY, lambda s: bytes.fromhex(s) if len(s) % 2 == 0 else None), (_BASE64, _base64)):
        for m in pattern.finditer(text):
            if (kind := _kind_of(decode(m[0]), depth)) is not None:
                found.append((m.start(), m.end(), kind))
    out: list[Span] = []
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if not out or b > out[-1][1]:
            out.append((a, b, kind))
    return out


def base_spans(text: str) -> list[Span]:
    """(start, end, kind's number) of the base patterns, by start, then kind."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text)
    return base, sorted(base + confirmed(text), key=lambda x: (x[0], x[2]))


def line(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x in batch.column(1):
            base, every = find(x.as_py() or "")
            kinds = [k for _, _, k in base]
            rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(line(base).encode()).hexdigest(), line(every), len(every)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])


def span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        rows = [(i, KINDS[k], a, b, s[a:b]) for i, x in zip(ids, texts, strict=True) if (s := x.as_py()) for a, b, k in find(s)[1]]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "kind", "start", "end", "secret"])


def cover(text: str, spans: list[Span]) -> str:
    """``text`` with each stretch of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = list(batch.columns)
        cols[at] = pa.array([None if (t := x.as_py()) is None else cover(t, find(t)[1]) for x in batch.column(at)], batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans and their number, for each row."""
    read = bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text"))
    return read.mapInArrow(digest_batches, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_spans bigint")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, secret) of every span."""
    read = bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text"))
    return read.mapInArrow(span_batches, "doc_id bigint, kind string, start bigint, end bigint, secret string")


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets."""
    at = df.columns.index(text)
    return bounded_batches(df).mapInArrow(lambda b: mask_batches(b, at), df.schema)
