"""License texts matched against templates with markup.

A template is a text with ``<<optional>> ... <<end>>`` around what may be missing and
``<<var:NAME:LOW-HIGH>>`` where LOW to HIGH words of any kind may stand.  It compiles to an
automaton over words; a text holds the license where the automaton accepts some consecutive
words, so mandatory wording must be there word for word.  Runs start only where a template's
first mandatory words stand, which hashes find in all words of a batch at once.

Words are runs of ASCII digits and letters (A-Z count as a-z) and non-ASCII characters.

Edge cases: null texts are empty; without words every count is 0, places are null and labels
empty; repeated rows come back as often; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import textkit as tk
from tessera.llm.scratch import bounded_batches

# The phrases of the base scan and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Who holds the rights, in up to ten words.
HOLDER = "<<var:holder:1-10>>"
# Wording of published licenses.
BSD_OPENING = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_CLOSING = f"this software is provided by {HOLDER} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {HOLDER} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
#: Label (which may name a variable) and template, whole license texts among them.
TEMPLATES = (
    ("gpl-{version}", "<<optional>>licensed<<end>> under the <<optional>>terms of the<<end>> gnu general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version <<var:version:1-1>> <<optional>>of the license<<end>> <<optional>>or <<optional>>at your option<<end>> any later version<<end>>"),
    ("apache-{version}", "licensed under the apache license version <<var:version:1-1>> <<optional>>0<<end>> <<optional>>the license you may not use this file except in compliance with the license<<end>>"),
    ("cc-by-nc-{version}", "licensed under <<optional>>a<<end>> <<optional>>creative commons<<end>> cc by nc <<var:version:1-1>> <<optional>>0<<end>>"),
    ("cc-by-{version}", "licensed under <<optional>>a<<end>> <<optional>>creative commons<<end>> cc by <<var:version:1-1>> 0"),
    ("mit-notice", "<<optional>>this <<var:thing:1-2>> is<<end>> released under the mit license"),
    ("mit-text", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>>the software<<end>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the {HOLDER} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-2-text", f"{BSD_OPENING} {BSD_CLOSING}"),
    ("bsd-3-text", f"{BSD_OPENING} <<optional>>3<<end>> neither the name of {HOLDER} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {BSD_CLOSING}"),
    ("isc-text", f"permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {HOLDER} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {HOLDER} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
)
MARK = re.compile(r"<<(optional|end|var:\w+:\d+-\d+)>>")
ANCHOR_WORDS = 3


@dataclass(frozen=True)
class Automaton:
    """States are numbers, 0 first; ``words``: (state, word) -> state; ``any_word``: state -> (state, variable)."""

    label: str
    words: dict[tuple[int, str], int]
    any_word: dict[int, tuple[int, str]]
    free: dict[int, tuple[int, ...]]
    last: int

    def closed(self, runs: dict[int, tuple]) -> dict[int, tuple]:
        todo = list(runs)
        while todo:
            s = todo.pop()
            for t in self.free.get(s, ()):
                if t not in runs:
                    runs[t] = runs[s]
                    todo.append(t)
        return runs

    def accept(self, words: list[str], start: int) -> tuple[int, dict[str, str]] | None:
        """(end of the longest acceptance, variables) of the words from ``start``."""
        runs, best = self.closed({0: ()}), None
        for k in range(start, len(words) + 1):
            if self.last in runs:
                best = (k, dict(runs[self.last]))
            if not runs or k == len(words):
                break
            after: dict[int, tuple] = {}
            for s, seen in runs.items():
                if (t := self.words.get((s, words[k]))) is not None:
                    after.setdefault(t, seen)
                if s in self.any_word:
                    t, name = self.any_word[s]
                    after.setdefault(t, (*seen, (name, words[k])))
            runs = self.closed(after)
        return best


def build(label: str, template: str) -> Automaton:
    words: dict[tuple[int, str], int] = {}
    any_word: dict[int, tuple[int, str]] = {}
    free: dict[int, list[int]] = {}
    at, new, open_at = 0, 1, []
    for k, part in enumerate(MARK.split(template)):
        if k % 2 == 0:
            for w in part.split():
                words[at, w] = new
                at, new = new, new + 1
        elif part == "optional":
            # A state of its own, so that skipping cannot lead into another region.
            free.setdefault(at, []).append(new)
            open_at.append(at)
            at, new = new, new + 1
        elif part == "end":
            free.setdefault(open_at.pop(), []).append(new)
            free.setdefault(at, []).append(new)
            at, new = new, new + 1
        else:
            _, name, span = part.split(":")
            low, high = map(int, span.split("-"))
            ends = []
            for n in range(1, high + 1):
                any_word[at] = (new, name)
                at, new = new, new + 1
                if n >= low:
                    ends.append(at)
            for e in ends:
                free.setdefault(e, []).append(new)
            at, new = new, new + 1
    return Automaton(label, words, any_word, {s: tuple(t) for s, t in free.items()}, at)


def first_words(auto: Automaton) -> set[tuple[str, ...]]:
    """Every way in which an acceptance can begin, up to ANCHOR_WORDS words; '' stands for any word."""
    out, todo = set(), [(0, ())]
    while todo:
        s, seen = todo.pop()
        if len(seen) == ANCHOR_WORDS or s == auto.last:
            out.add(seen)
            continue
        todo += [(t, seen) for t in auto.free.get(s, ())]
        todo += [(t, (*seen, w)) for (f, w), t in auto.words.items() if f == s]
        if s in auto.any_word:
            todo.append((auto.any_word[s][0], (*seen, "")))
    return out


def hash_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return tk.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends[:-1]].astype(np.int64), ends.astype(np.int64))


def places(hashes: np.ndarray, phrase: tuple[str, ...], ranges: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after another in one text; '' is any word."""
    n = len(hashes) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    known = [(j, w) for j, w in enumerate(phrase) if w]
    first, rest = known[0], known[1:]
    at = np.flatnonzero(hashes[first[0] : first[0] + n] == hash_of([first[1]])[0])
    for j, w in rest:
        at = at[hashes[at + j] == hash_of([w])[0]]
    return at[np.searchsorted(ranges, at, "right") == np.searchsorted(ranges, at + len(phrase) - 1, "right")]


@lru_cache(maxsize=1)
def automata() -> list[tuple[Automaton, list[tuple[str, ...]]]]:
    return [(a := build(label, text), sorted(first_words(a))) for label, text in TEMPLATES]


def scan(buf: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]]:
    """For each text: number of words, base places (word, label), matches of templates (first, end, label)."""
    low = tk.LOWER[buf]
    starts, ends, ranges = tk.words(low, bounds, tk.ALNUM_LOWER)
    hashes = tk.word_hashes(low, starts, ends)
    doc = lambda at: np.searchsorted(ranges, at, "right") - 1
    base: dict[int, list[tuple[int, str]]] = {}
    for phrase, label in PHRASES.items():
        at = places(hashes, tuple(phrase.split()), ranges)
        for d, k in zip(doc(at).tolist(), at.tolist()):
            base.setdefault(d, []).append((k - int(ranges[d]), label))
    more: dict[int, list[tuple[int, int, str]]] = {}
    held: dict[int, list[str]] = {}
    for auto, anchors in automata():
        at = np.unique(np.concatenate([places(hashes, a, ranges) for a in anchors]))
        for d, k in zip(doc(at).tolist(), at.tolist()):
            if d not in held:
                held[d] = [low[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[ranges[d] : ranges[d + 1]].tolist(), ends[ranges[d] : ranges[d + 1]].tolist())]
            k -= int(ranges[d])
            if (got := auto.accept(held[d], k)) is not None:
                more.setdefault(d, []).append((k, got[0], auto.label.format(**got[1])))
    for d in range(len(bounds) - 1):
        yield int(ranges[d + 1] - ranges[d]), sorted(base.get(d, [])), sorted(more.get(d, []))


def label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(7)]
        for _, _, buf, bounds in tk.parts(batch.column(1)):
            for n, base, more in scan(buf, bounds):
                labels, all_labels = {x for _, x in base}, {x for _, x in base} | {x for _, _, x in more}
                row = (n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(all_labels)), 1.0 if more else 0.5 if base else 0.0)
                for c, x in zip(cols, row):
                    c.append(x)
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def match_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for lo, _, buf, bounds in tk.parts(batch.column(1)):
            rows += [(lo + d, *x) for d, (_, _, more) in enumerate(scan(buf, bounds)) for x in more]
        at, first, end, label = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(label, pa.string())], ["doc_id", "first_word", "end_word", "license"])


def labels(docs: DataFrame) -> DataFrame:
    """Words, base places and labels of each row; ``score`` is 1 with a template, 0.5 with a base phrase only."""
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(label_batches, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")


def matches(docs: DataFrame) -> DataFrame:
    """One row for each place where a template is accepted."""
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(match_batches, "doc_id bigint, first_word bigint, end_word bigint, license string")
