"""Labels of a vocabulary found in whole texts: one pass of an Aho-Corasick automaton for all labels at once.

Texts and labels are words between blanks, A-Z lower-cased; a label is met where its words stand one after the other. The vocabulary is learned
from a table: the labels of each type. Its size is counted before it's shipped; each task builds the automaton once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels that an automaton may have: some hundred bytes each in every task.
MOST_LABELS = 500_000
_BLANKS = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def plain(text: Column) -> Column:
    """Words joined by one blank each, A-Z lower-cased."""
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _BLANKS, " "))


def vocabulary(df: DataFrame, kind: str, label: str, least: int = 1) -> DataFrame:
    """kind, label, n of the labels that rows of a kind hold at least `least` times; nulls and empty labels are none."""
    rows = df.select(F.col(kind).cast("string").alias("kind"), plain(F.col(label)).alias("label"))
    return rows.where("kind is not null and label <> ''").groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


class Labels:
    """An automaton of labels, and what it finds in a text."""

    def __init__(self, labels: Sequence[str], before: frozenset[str], after: frozenset[str]):
        import ahocorasick

        self.before, self.after, self.automaton = before, after, ahocorasick.Automaton()
        for i, label in enumerate(labels):
            self.automaton.add_word(f" {label} ", (i, label.count(" ") + 1, len(label)))
        if labels:
            self.automaton.make_automaton()

    def find(self, text: str | None, longest: bool) -> list[tuple[int, int, int]]:
        """(first word, words, label) by place, longer ones first; with `longest` none overlaps one that is taken before it."""
        words = (text or "").translate(_FOLD).split()
        if not words or not len(self.automaton):
            return []
        starts, at = {}, 1
        for i, w in enumerate(words):
            starts[at] = i
            at += len(w) + 1
        found = []
        for end, (label, n, length) in self.automaton.iter(f" {' '.join(words)} "):
            i = starts[end - length]
            if not (i and words[i - 1] in self.before) and not (i + n < len(words) and words[i + n] in self.after):
                found.append((i, n, label))
        found.sort(key=lambda f: (f[0], -f[1]))
        if not longest:
            return found
        kept, free = [], 0
        for i, n, label in found:
            if i >= free:
                kept.append((i, n, label))
                free = i + n
        return kept


def find_labels(
    texts: DataFrame, id_col: str, text_col: str, labels: DataFrame, longest: bool = True, before: Sequence[str] = (), after: Sequence[str] = (),
    most: int = MOST_LABELS,
) -> DataFrame:
    """id, kind, label, word (its first word's number from 0) for each place of a label in the texts; labels: kind, label.

    `longest`: of labels that overlap the one that begins first counts, then the longer one. A place after a word of `before` or in front of one of
    `after` (stop words) is none. A label of several kinds is found for each. Null and empty texts hold none; more than `most` labels are an error.
    """
    known = labels.select("kind", "label").distinct()
    n = known.count()
    if n > most:
        raise ValueError(f"{n} labels; an automaton holds {most}")
    kinds: dict[str, list[str]] = {}
    for r in known.collect():
        kinds.setdefault(r["label"], []).append(r["kind"])
    names = sorted(kinds)
    stops = frozenset(before), frozenset(after)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Labels(names, *stops)
        for batch in batches:
            at, out = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for word, _, label in automaton.find(text, longest):
                    for kind in kinds[names[label]]:
                        at.append(row)
                        out.append((kind, names[label], word))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [(), (), ()], (pa.string(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *columns], ["id", "kind", "label", "word"])

    rows = texts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(read, f"id {kind}, kind string, label string, word long")
