"""License scan with ordered signature rules.

A text is read as its words (ASCII case folded, punctuation dropped). Rule
families run only where one of their keywords is a word of the text; matches
of all families compete: by priority, then length, then position; a match
inside the interval of a match that has been kept is suppressed. The base
phrases of the contract are found apart at every place they stand and are
never suppressed.

Null text is empty: no words, no labels, score 0. Texts are read whole. Other
columns are not read, rows repeat as they do in the input, and an empty table
gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import map_rows, words
from concordat.llm.license_rules import BASE, rules


class Scanner:
    def __init__(self):
        self.base = [(f" {phrase} ".encode(), label) for phrase, label in BASE]
        self.families = [
            ([g.encode() for g in gates], [(r, re.compile(rf"(?<= )(?:{r.regex})(?= )".encode())) for r in own]) for gates, own in rules()
        ]
        #: A text with none of these words has nothing to find.
        self.gates = {g for gates, _ in self.families for g in gates} | {phrase.split()[0] for phrase, _ in self.base}

    def base_places(self, joined: bytes) -> list[tuple[int, str]]:
        """(start byte, label) of every place of a base phrase, overlapping ones too."""
        out = []
        for phrase, label in self.base:
            at = joined.find(phrase)
            while at >= 0:
                out.append((at, label))
                at = joined.find(phrase, at + 1)
        return out

    def detections(self, joined: bytes, present: set[bytes]) -> list[tuple[int, int, str, int, float]]:
        """(start byte, end byte, label, priority, weight) kept after suppression, in text order."""
        found = []
        for gates, own in self.families:
            if not present.isdisjoint(gates):
                for r, regex in own:
                    found += [(m.start(), m.end(), r.label, r.priority, r.weight) for m in regex.finditer(joined)]
        found.sort(key=lambda d: (-d[3], d[0] - d[1], d[0], d[2]))
        return sorted(suppress(found))

    def scan(self, text: str | None) -> dict:
        ws = words(text)
        out = {"n_words": len(ws), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
        present = set(ws)
        if not present.isdisjoint(self.gates):
            joined = b" " + b" ".join(ws) + b" "
            spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            word_at = lambda at: np.searchsorted(spaces, np.array(at, np.int64)).tolist()  # noqa: E731  spaces before a place
            base = self.base_places(joined)
            kept = self.detections(joined, present)
            labels = {label for _, label in base}
            at = word_at([i for i, _ in base])
            out |= {"n_base": len(base), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": ",".join(sorted(labels))}
            out["labels"] = ",".join(sorted(labels | {d[2] for d in kept}))
            out["score"] = 1.0 if base else max((d[4] for d in kept), default=0.0)
            first, last = word_at([d[0] for d in kept]), word_at([d[1] for d in kept])
            out["spans"] = [{"label": d[2], "first": a - 1, "last": b - 1} for d, a, b in zip(kept, first, last)]
        return out


def suppress(found: list[tuple]) -> list[tuple]:
    """Those of (start, end, ...), best first, that lie inside none kept before.

    Some interval kept so far holds a new one if, of those that start no later, the
    furthest end is no nearer: running maxima over ranks of starts, in a binary
    indexed tree, tell that in the logarithm of their number.
    """
    rank = {at: i + 1 for i, at in enumerate(sorted({d[0] for d in found}))}
    furthest, kept = [-1] * (len(rank) + 1), []
    for d in found:
        i, end = rank[d[0]], -1
        while i:
            end = max(end, furthest[i])
            i &= i - 1
        if end < d[1]:
            kept.append(d)
            i = rank[d[0]]
            while i < len(furthest):
                furthest[i] = max(furthest[i], d[1])
                i += i & -i
    return kept


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first and last word) of every row."""

    def start():
        s = Scanner()

        def step(b: pa.RecordBatch) -> dict:
            rows = [s.scan(x) for x in b.column(1).to_pylist()]
            return {"doc_id": b.column(0)} | {c: [r[c] for r in rows] for c in schema.names[1:]}

        return step

    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", span),
    ])
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(picked, start, schema, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint>>")
