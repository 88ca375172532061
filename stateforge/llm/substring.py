"""Substring dedup: sliding sentence spans.

A text is cut into sentences: after a word that ends in . ! or ? (closing
quotes and brackets may follow), unless one of the two words before it does too,
and at line ends.  A sentence of more than
`LONG` words is cut further after the word of the least hash (of equal ones the
last) of every `WINDOW` words of it, so that one very long sentence hides no
repeat: no piece is longer than LONG words, and whether a word is a cut depends
on the WINDOW - 1 words on each side of it alone.  A passage of over 50 words
that stands in two texts with the same line ends so has a span in common, whatever
its words are: at most 13 words at each end can be cut otherwise, and the rest
is at least 3 whole pieces and 16 words.  From every sentence on, a run of `RUN` sentences, or of as many
more as it takes to reach `LEAST_WORDS` words, is a span; words compare in
lower case (A-Z) and white space doesn't count.  Spans are hashed (64 bits),
joined over all documents, and the first place of each (smallest id, then
position) keeps it; sentences covered by any span that is not at its first
place are removed, with the white space after them.

Only hashes of spans that occur twice come back to the texts.  Counts and first
places are combined before their shuffle, and the first places of the spans that
make a `HOT`th of all places or more (so HOT of them at most) are broadcast to
the others, which need no shuffle then; so a span that a third of all documents
share is no hot spot.

Defined results: null and empty texts have no sentences and stay as they are;
texts with fewer than LEAST_WORDS words have no spans, those with fewer than RUN
sentences are one span; rows of
one id are one document: equal rows don't remove each other's text; a null id is an id and
comes first; columns beside id and text are ignored.  Two different spans of one
hash (chance about n^2 / 2^65 for n spans) would count as a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateforge.llm import kit

RUN, LEAST_WORDS, LONG, WINDOW = 3, 16, 10, 7
HOT = 1000
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b"\"')]}")] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True


def least(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places of the least hash (the last of equal ones) of every WINDOW words inside a sentence of more than LONG words."""
    size = np.diff(first)
    left = np.repeat(first[1:], size) - np.arange(len(h))  # words from here to the sentence's end
    start = np.flatnonzero(np.repeat(size > LONG, size) & (left >= WINDOW))
    best, at = h[start], start.copy()
    for k in range(1, WINDOW):
        other = h[start + k]
        less = other <= best
        best = np.where(less, other, best)
        at[less] = start[less] + k
    return at


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each sentence and the number of words, len+1 offsets of each text's sentences, word starts, word ends, word hashes)."""
    starts, ends, bounds = kit.word_spans(data, offsets)
    n = len(starts)
    h = kit.word_hashes(kit.LOWER[data], starts, ends)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), starts, ends, h
    last = ends - 1
    for _ in range(3):  # at most three closing marks after the stop
        last = np.where(_CLOSING[data[last]] & (last > starts), last - 1, last)
    stop = _STOPS[data[last]]
    every = stop.copy()
    for back in (1, 2):  # a stop counts if neither of the two words before it in the text has one
        near = every[:-back] & kit.within(bounds, back)
        stop[back:] &= ~near
    lines = np.flatnonzero(data == 10)
    stop[np.unique(np.searchsorted(starts, lines)[np.searchsorted(starts, lines) > 0]) - 1] = True
    stop[bounds[1:][bounds[1:] > 0] - 1] = True
    first = np.append(0, np.flatnonzero(stop) + 1)
    stop[least(h, first)] = True
    first = np.append(0, np.flatnonzero(stop) + 1)
    return first, np.searchsorted(first, bounds), starts, ends, h


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(text, first sentence in the text, number of sentences, hash) of every span, and what `sentences` gives."""
    cut = first, per_text, _, _, h = sentences(data, offsets)
    n = len(first) - 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none, none, none, cut
    reach = np.searchsorted(first, first[:-1] + LEAST_WORDS)  # the first sentence end with enough words
    until = np.maximum(np.arange(n) + RUN, reach)
    limit = np.repeat(per_text[1:], np.diff(per_text))
    whole = per_text[:-1][(np.diff(per_text) > 0) & (np.diff(per_text) < RUN)]  # texts of few sentences are one span
    until[whole] = np.where(reach[whole] <= limit[whole], limit[whole], until[whole])
    ok = np.flatnonzero(until <= limit)
    until = until[ok]
    up, down = kit.powers(len(h) + 1)
    total = np.append(np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)]))
    a, b = first[ok], first[until]
    value = kit.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64)
    text = np.searchsorted(per_text, ok, "right") - 1
    return text, ok - per_text[text], until - ok, value, cut


def all_spans(docs: DataFrame, id_col: str, text_col: str, only: kit.Filter | None = None) -> DataFrame:
    """(h, id, row, at) of every span of every row, which id and a hash of the text (`row`) tell from others; with `only`, of those whose hash may be in it."""
    sent = docs.sparkSession.sparkContext.broadcast(only) if only else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kit.text_bytes(batch.column(1))
            for a, b in kit.chunks(offsets):
                text, at, _, value, _ = spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if sent is not None:
                    hit = sent.value.may_have(value)
                    text, at, value = text[hit], at[hit], value[hit]
                yield pa.RecordBatch.from_arrays([pa.array(value), batch.column(0).take(pa.array(text + a)), batch.column(2).take(pa.array(text + a)), pa.array(at.astype(np.int32))], ["h", "id", "row", "at"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.hash(text_col).alias("row")).mapInArrow(run, f"h long, id {kind}, row int, at int")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, at, h): every span from sentence `at` on that stands first somewhere else.

    Hashes are counted alone first; a filter of fixed size then lets (nearly)
    only those that occur twice through to the shuffle that finds first places.
    """
    counted = kit.kept(all_spans(docs, id_col, text_col).groupBy("h").count().where(F.col("count") > 1).select("h"))
    again = kit.kept(all_spans(docs, id_col, text_col, kit.Filter.of(counted, "h")))
    counted.unpersist()
    first = again.groupBy("h").agg(F.min(F.struct("id", "at")).alias("_first"), F.count("at").alias("_n"))
    first = kit.written(first.where(F.col("_n") > 1).select(F.col("h").alias("_h"), "_first", "_n"), "first")
    many = max(2, (first.agg(F.sum("_n")).head()[0] or 0) // HOT)
    hot, cold = first.where(F.col("_n") >= many), first.where(F.col("_n") < many)
    same = F.col("h") == F.col("_h")
    rest = again.join(F.broadcast(hot.select("_h")), same, "left_anti").join(cold.hint("shuffle_hash"), same)
    found = again.join(F.broadcast(hot), same).unionByName(rest)
    return found.where(~F.struct("id", "at").eqNullSafe(F.col("_first"))).select("id", "row", "at", "h")


def cut(text: str | None, marked: set[tuple[int, int]]) -> tuple[str | None, int, int, int]:
    """(the text without the sentences of the spans (at, hash) in `marked`, its number of sentences, and of removed sentences and words)."""
    if not text:
        return text, 0, 0, 0
    data = np.frombuffer(text.encode(), np.uint8)
    _, at, n, value, (first, _, starts, _, _) = spans(data, np.array([0, len(data)]))
    total = len(first) - 1
    gone = np.zeros(total + 1, np.int64)
    for k in range(len(at)) if marked else ():
        if (int(at[k]), int(value[k])) in marked:
            gone[at[k]] += 1
            gone[at[k] + n[k]] -= 1
    gone = np.cumsum(gone)[:total] > 0
    if not gone.any():
        return text, total, 0, 0
    edge = np.append(starts[first[:-1]], len(data))
    edge[0] = 0
    kept = b"".join(data[edge[i] : edge[i + 1]].tobytes() for i in np.flatnonzero(~gone))
    return kept.decode(), total, int(gone.sum()), int(np.diff(first)[gone].sum())


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_sentences, n_removed, words_removed) of every row; `text` is what is left.

    Marks go to the row that they are of, by id and text, so rows of one id (or of
    none) that differ don't meet each other's, but for equal hashes, which does no harm:
    a mark of another text that fits a row's own span is a mark of its own, too.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    marks = repeats(docs, id_col=id_col, text_col=text_col).groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("at", "h")).alias("_marks"))
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.hash(text_col).alias("row")).join(marks.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut(t.as_py(), {(m["at"], m["h"]) for m in marked.as_py() or ()}) for t, marked in zip(batch.column(1), batch.column(2), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "text", "n_sentences", "n_removed", "words_removed"])

    out = joined.select("id", "text", "_marks").mapInArrow(run, f"id {kind}, text string, n_sentences long, n_removed long, words_removed long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)
