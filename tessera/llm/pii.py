"""Personal data: spans proposed with high recall, selected by boosted trees.

Four base patterns (email, ip, card, phone) stand as they match.  Looser generators propose
further spans, which may overlap; small gradient-boosted trees weigh their format and the words
before them, and each kind has its own threshold: the least at which PRECISION of what passes is
right, on generated examples held back from training, among them spans that could be either.

The trees learn from examples made by rule (``examples``), since no table has span labels.

Edge cases: null texts are empty; empty texts have no spans; offsets count code points, the end
is exclusive; rows that repeat come back as often; other columns are kept by ``redact`` and not
read by ``digests``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import bounded_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "ssn", "local_phone")
PRECISION = 0.98
ROUNDS, DEPTH, RATE, LEAST_LEAF = 40, 4, 0.3, 20

_ANY = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where its run of digits begins; the look-behind keeps the scan linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

GENERATORS = (
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])")),
    ("local_phone", re.compile(r"(?<![0-9A-Za-z+.(-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9A-Za-z-])")),
)
CONTEXT = (
    re.compile(r"(?i)token|secret|key|passw|credential|auth|bearer"),
    re.compile(r"(?i)phone|tel|call|mobile|fax|contact"),
    re.compile(r"(?i)ssn|social|security|tax|insurance"),
    re.compile(r"(?i)iban|account|bank|konto|cuenta|compte"),
    re.compile(r"(?i)date|version|commit|sha|md5|digest|isbn|order|invoice|item|part|page|no\.|nr\."),
    re.compile(r"[=:]\s*[\"']?$"),
    re.compile(r"[\"'`]$"),
    re.compile(r"\+[0-9]{1,3}[\x20.-]?$"),
)
#: What each ASCII character is (1: upper case, 2: lower case, 3: digit, 0: other), and whether it is a vowel.
_SORTS = np.array([chr(c).isupper() + 2 * chr(c).islower() + 3 * chr(c).isdigit() for c in range(128)], np.uint8)
_VOWELS = np.array([chr(c).lower() in "aeiou" for c in range(128)])


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's number) of the base patterns, by start, then kind."""
    if not _ANY.search(text):
        return []
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end(), 0))
            done = m.end()
        at = text.find("@", at + 1)
    found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], x[2]))


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Spans of the generators, of which all but the secrets' need a digit; they may overlap."""
    usable = GENERATORS if _DIGIT.search(text) else GENERATORS[:1]
    return [(m.start(), m.end(), len(BASE_KINDS) + k) for k, (_, pattern) in enumerate(usable) for m in pattern.finditer(text)]


def features(text: str, start: int, end: int, kind: int) -> list[float]:
    s, before = text[start:end], text[max(0, start - 28) : start]
    n, d = len(s), digits_of(s)
    codes = np.frombuffer(s.encode("ascii"), np.uint8)  # The generators propose no other characters.
    counts = np.bincount(codes)
    counts, sorts = counts[counts > 0] / n, _SORTS[codes]
    share = np.bincount(sorts, minlength=4) / n
    groups = [len(g) for g in re.findall(r"[A-Za-z0-9]+", s)]
    return [
        n, len(d) / n, share[1], share[2], share[0],
        float(-(counts * np.log2(counts)).sum()), len(groups), max(groups, default=0), float(set(s) <= set("0123456789abcdef")),
        float(luhn(d)) if d else 0.0, float(kind == 5 and iban_ok(s)), float(kind == 6 and not (s.startswith(("000", "666", "9")) or d[3:5] == "00" or d[5:] == "0000")),
        np.count_nonzero(sorts[1:] != sorts[:-1]) / n, _VOWELS[codes].sum() / n,
        float("(" in s), float("/" in s), float(len(groups) == 3 and groups[0] == 4 and d[:2] in ("19", "20")), *(float(bool(p.search(before))) for p in CONTEXT),
        *(float(kind == len(BASE_KINDS) + k) for k in range(len(GENERATORS))),
    ]


def iban(rng: np.random.Generator) -> str:
    """A valid number of a country drawn at random, in one piece or in fours."""
    country, letters, figures = (("DE", 0, 18), ("FR", 0, 23), ("ES", 0, 20), ("NL", 4, 10), ("GB", 4, 14))[int(rng.integers(5))]
    body = "".join(chr(65 + int(k)) for k in rng.integers(0, 26, letters)) + "".join(str(k) for k in rng.integers(0, 10, figures))
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
    whole = f"{country}{check:02d}{body}"
    return whole if rng.random() < 0.5 else " ".join(whole[k : k + 4] for k in range(0, len(whole), 4))


def makes(rng: np.random.Generator) -> list[list[tuple[tuple[str, ...], Callable[[], str], float]]]:
    """For each added kind: (words before, a span, the chance that it is personal data).

    Chances other than 0 and 1 stand for spans that format and context leave open; they are what
    keeps the thresholds from being idle.
    """
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(alphabet[c] for c in rng.integers(0, len(alphabet), k))
    number = lambda k: chars("0123456789", k)
    size = lambda low, high: int(rng.integers(low, high))
    upper, figures = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    mixed = upper.lower() + upper + figures
    syllables = "tion en ber schlich keit ver heit ein in ung tor ment able er the an que lle ci ón re das ow con pro ly".split()
    word = lambda k: "".join(pick(syllables) for _ in range(k))
    neutral = ("", "see ", "the ", "in ", "and ", "of the ", "with ", ", ", ". ", "\n", "für ", "para ")
    goods = ("order ", "part no. ", "invoice ", "page ", "isbn ", "item ", "version ", "commit ")
    assigned = ('token = "', "secret: ", "api_key=", 'password = "', "Authorization: Bearer ", 'key = "')
    summed = ("commit ", "sha ", "md5: ", "digest ", 'digest = "', 'sha256="', "version: ", 'md5 = "', "item ")
    bank, social = ("IBAN ", "IBAN: ", "account ", "account: ", "Konto ", "bank: "), ("SSN ", "SSN: ", "social security number ", "tax id: ", "ssn: ", "insurance no. ")
    calls = ("phone ", "phone: ", "tel: ", "call ", "mobile ", "contact ", "fax ", "+1 ", "+49 ", "+44-")

    anywhere = (*neutral, *goods, *bank, *social, *calls)

    def key() -> str:
        return chars(pick((figures + "abcdef", figures + "ABCDEF", mixed, mixed + "+/", mixed + "-_")), size(24, 64))

    def words() -> str:
        joined = lambda mark: mark.join(word(2) for _ in range(5))
        forms = (lambda: word(8), lambda: word(9), lambda: word(12).capitalize(), lambda: joined("-"), lambda: joined("_"), lambda: joined("/"))
        return pick((*forms, lambda: "".join(word(2).capitalize() for _ in range(6)), lambda: pick("-_/+") * size(20, 80)))()

    def long_run() -> str:
        k = size(20, 150)
        forms = (lambda: word(3 * k)[:1200], lambda: pick("-_/+aX0") * 8 * k, lambda: "-".join(word(2) for _ in range(k)), lambda: "/".join(word(2) for _ in range(k)))
        return pick((*forms, lambda: (word(1) + number(1)) * k, lambda: number(8 * k)))()

    def insured() -> str:
        return f"{size(100, 665)}{(dash := pick('- '))}{size(1, 100):02d}{dash}{size(1, 10000):04d}"

    def never_given() -> str:
        return pick((f"9{number(2)}-{size(1, 100):02d}-{number(4)}", f"000-{number(2)}-{number(4)}", f"666-{number(2)}-{number(4)}", f"{size(100, 665)}-00-{number(4)}", f"{size(100, 665)}-{size(1, 100):02d}-0000"))

    def dialled() -> str:
        return pick((f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"{number(3)} {number(4)} {number(4)}"))

    def counted() -> str:
        return pick((f"{size(1900, 2100)}-{number(3)}-{number(3)}", f"{number(4)} {number(4)} {number(4)}", f"{number(3)}/{number(3)}.{number(3)}"))

    return [
        [
            (assigned, key, 1), (assigned, lambda: chars(pick((mixed[:52], mixed[:26], upper)), size(20, 64)), 1),
            ((*assigned, "-----BEGIN PRIVATE KEY-----\n", "-----BEGIN RSA PRIVATE ", f"Bearer eyJ{chars(mixed, 33)}.", *neutral), lambda: chars(mixed + pick(("+/", "_-")), size(100, 1200)), 1),
            (summed, key, 0.02), (('id = "', "value: ", 'data="', *neutral), key, 0.3),
            ((*anywhere, "the key ", "a secret ", "keys: ", "token "), words, 0), (assigned, lambda: "-".join(word(2) for _ in range(5)), 0.15), ((*anywhere, "the key "), long_run, 0),
        ],
        [
            (bank, lambda: iban(rng), 1), (neutral, lambda: iban(rng), 1), (goods, lambda: iban(rng), 0.5),
            ((*neutral, *goods), lambda: chars(upper, 2) + number(2) + chars(upper + figures, 16), 0), (bank, lambda: chars(upper, 2) + number(20), 0.1),
        ],
        [(social, insured, 1), (neutral, insured, 0.6), (goods, insured, 0.03), (social, never_given, 0.02), ((*neutral, *goods), never_given, 0)],
        [(calls, dialled, 1), (neutral, dialled, 0.6), (goods, dialled, 0.03), ((*neutral, *goods), counted, 0), (("date ", "version "), counted, 0)],
    ]


def examples(n: int = 2000, seed: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, truth and kind of ``n`` generated spans of each added kind, in generated contexts."""
    rng = np.random.Generator(np.random.PCG64(seed))
    xs, ys, kinds = [], [], []
    for made in makes(rng):
        for k in range(n):
            contexts, span_of, share = made[k % len(made)]
            before, span, truth = contexts[int(rng.integers(len(contexts)))], span_of(), rng.random() < share
            text = f"lorem ipsum {before}{span} dolor"
            for a, b, kind in proposals(text):
                xs.append(features(text, a, b, kind))
                ys.append(float(truth and b - a >= len(span) - 1))
                kinds.append(kind)
    return np.array(xs), np.array(ys), np.array(kinds)


@dataclass(frozen=True)
class Node:
    feature: int
    at: float
    low: "Node | float"
    high: "Node | float"


def cuts(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Up to 31 cuts of each feature at its quantiles, and each value's place among them."""
    edges = [np.unique(np.quantile(column, np.arange(1, 32) / 32)) for column in x.T]
    return edges, np.array([np.searchsorted(e, column) for e, column in zip(edges, x.T)])


def grow(edges: list[np.ndarray], places: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Node | float:
    """A regression tree on gradients and Hessians, summed by each feature's places."""
    best = (1e-3, -1, 0)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(len(edges)) if depth else ():
        size = len(edges[f]) + 1
        n, gl, hl = (np.cumsum(np.bincount(places[f], w, size))[:-1] for w in (None, g, h))
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
        gain[(n < LEAST_LEAF) | (n > len(g) - LEAST_LEAF)] = 0
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), f, at)
    if best[1] < 0:
        return float(-g.sum() / (h.sum() + 1.0))
    low = places[best[1]] <= best[2]
    return Node(best[1], float(edges[best[1]][best[2]]), *(grow(edges, places[:, side], g[side], h[side], depth - 1) for side in (low, ~low)))


def value(tree: Node | float, row: list[float]) -> float:
    while isinstance(tree, Node):
        tree = tree.low if row[tree.feature] <= tree.at else tree.high
    return tree


def values(tree: Node | float, x: np.ndarray) -> np.ndarray:
    """``value`` of every row of ``x``."""
    if not isinstance(tree, Node):
        return np.full(len(x), tree)
    return np.where(x[:, tree.feature] <= tree.at, values(tree.low, x), values(tree.high, x))


@dataclass(frozen=True)
class Selector:
    trees: tuple[Node | float, ...]
    thresholds: tuple[float, ...]

    def chance(self, row: list[float]) -> float:
        return round(float(1 / (1 + np.exp(-RATE * sum(value(t, row) for t in self.trees)))), 9)


@lru_cache(maxsize=1)
def selector() -> Selector:
    """Trees fitted on generated examples, thresholds on others."""
    x, y, _ = examples()
    edges, places = cuts(x)
    total, trees = np.zeros(len(x)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        trees.append(tree := grow(edges, places, p - y, p * (1 - p), DEPTH))
        total += RATE * values(tree, x)
    x, y, kinds = examples(seed=66)
    chance = np.round(1 / (1 + np.exp(-RATE * sum(values(t, x) for t in trees))), 9)
    return Selector(tuple(trees), tuple(threshold(chance[kinds == k], y[kinds == k]) for k in range(len(BASE_KINDS), len(KINDS))))


def threshold(chance: np.ndarray, truth: np.ndarray) -> float:
    """The least chance from which on at least PRECISION of the examples are right; 2 if none is.

    Equal chances pass together, so only the last of each run of them is looked at.
    """
    order = np.argsort(-chance, kind="stable")
    sunk = chance[order]
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero((right >= PRECISION) & np.r_[sunk[1:] != sunk[:-1], True])
    return float(sunk[good[-1]]) if len(good) else 2.0


def find(text: str, model: Selector) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each by start, then kind; added ones lie apart from base spans or hold them whole."""
    base = base_spans(text)
    added: list[tuple[int, int, int]] = []
    scored = []
    for a, b, kind in proposals(text):
        if all(b <= s or a >= e or (a <= s and e <= b and e - s < b - a) for s, e, _ in base):
            chance = model.chance(features(text, a, b, kind))
            if chance >= model.thresholds[kind - len(BASE_KINDS)]:
                scored.append((-chance, a, b, kind))
    for _, a, b, kind in sorted(scored):
        if all(b <= s or a >= e for s, e, _ in added):
            added.append((a, b, kind))
    return base, sorted(base + added, key=lambda x: (x[0], x[2]))


def line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def digest_batches(batches: Iterator[pa.RecordBatch], model: Selector) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, hashes, spans, totals = [], [], [], []
        for x in batch.column(1):
            base, every = find(x.as_py() or "", model)
            kinds = [k for _, _, k in base]
            counts.append([kinds.count(k) for k in range(4)])
            hashes.append(hashlib.sha256(line(base).encode()).hexdigest())
            spans.append(line(every))
            totals.append(len(every))
        cols = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(totals, pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])


def cover(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_batches(batches: Iterator[pa.RecordBatch], model: Selector, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if (t := x.as_py()) is None else cover(t, find(t, model)[1]) for x in batch.column(at)]
        cols = list(batch.columns)
        cols[at] = pa.array(texts, batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans and their number, for each row."""
    model = selector()
    return bounded_batches(docs).select("doc_id", F.col("text")).mapInArrow(lambda b: digest_batches(b, model), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every selected span of ``text`` replaced by its kind in brackets."""
    model, at = selector(), df.columns.index(text)
    return bounded_batches(df).mapInArrow(lambda b: redact_batches(b, model, at), df.schema)
