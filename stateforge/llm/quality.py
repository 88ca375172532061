"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its hashed words, word pairs,
repeats of a word (at distance 1 and 2, whatever the word) and the n-grams of 3
and 5 characters (code points) inside its words (a blank stands for either end of a word), plus
one vector that every text has; a softmax over the two labels follows.  Vectors and output layer are trained on the driver by stochastic
gradient descent in numpy over a bounded sample of labelled rows (`per_class`
of each label, smallest hashes of the id first, and of these as many as have
`SAMPLE_BYTES` of features together); the output bias is then moved
from the sample's odds to those of all labelled rows.  As the output is linear
in the average, scoring needs one number a bucket: a fixed-size table is sent
to the executors.

Defined results: null and empty texts have only the shared vector; null ids
and labels are never learnt from; an id with several labels counts with the
largest; rows of one id but other texts teach one of these texts, the same in
every run; ids are of any type, and those of the labels are cast to it; repeated
rows are each scored; columns beside id and text are ignored.
With no labelled rows of both kinds the score is the base rate (0 if none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateforge.llm import kit
from stateforge.llm.toxicity import labelled_sample, taught

#: Buckets (the last one is the vector that every text has), sample bound, training parameters.
BITS, DIM, PER_CLASS, SAMPLE_BYTES, EPOCHS, RATE, GAIN = 16, 8, 2500, 64 << 20, 6, 0.3, 100.0
NGRAMS = (3, 5)


@dataclass
class Model:
    """Vectors (buckets x dim), output layer (2 x dim) and bias (2)."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def table(self) -> tuple[np.ndarray, float]:
        """Each bucket's share of the log-odds, and the bias's."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def framed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with white space as blanks and a blank before each and after the last; and where each text's blank is."""
    out = np.full(len(data) + len(offsets), 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    out[at] = np.where(kit.WHITE[data], 32, data)
    return out, offsets + np.arange(len(offsets))


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, len+1 offsets of each text's features)."""
    top = np.uint64(64 - bits)
    starts, ends, bounds = kit.word_spans(data, offsets)
    h = kit.word_hashes(data, starts, ends)
    yield (kit.salted(h, 11) >> top).astype(np.int64), bounds
    ok = np.append(kit.within(bounds, 1), np.zeros(min(1, len(h)), bool))
    pairs = (kit.salted(kit.grams(h, 0, 1), 12) >> top).astype(np.int64)
    yield pairs[ok[: len(pairs)]], np.append(0, np.cumsum(ok))[bounds]
    for gap in (1, 2):  # pairs without their words: only that both are the same
        m = max(0, len(h) - gap)
        ok = np.append(kit.within(bounds, gap) & (h[:m] == h[gap:]), np.zeros(min(gap, len(h)), bool))
        yield np.full(int(ok.sum()), (gap * 0x9E3779B1 >> 7) & ((1 << bits) - 1)), np.append(0, np.cumsum(ok))[bounds]
    flat, at = framed(data, offsets)
    lead = np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat))  # where code points begin
    seen = np.append(0, np.cumsum(flat[lead[:-1]] == 32))
    first = np.searchsorted(lead, at)
    for n in NGRAMS:
        m = max(0, len(lead) - n)
        ok = seen[n - 1 : n - 1 + m] == seen[1 : 1 + m]  # no blank between the first and the last
        x = kit.word_hashes(flat, lead[:m][ok], lead[n : n + m][ok])
        yield (kit.salted(x, 20 + n) >> top).astype(np.int64), np.append(0, np.cumsum(ok))[np.minimum(first, m)]


def bags(column: pa.Array, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct features and their counts (the shared vector is not among them)."""
    data, offsets = kit.text_bytes(column)
    out = []
    for a, b in kit.chunks(offsets):
        parts = list(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits))
        for k in range(b - a):
            ids, counts = np.unique(np.concatenate([f[at[k] : at[k + 1]] for f, at in parts]), return_counts=True)
            out.append((ids.astype(np.uint32), counts.astype(np.uint32)))
    return out


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Features and counts as bytes: how wide either is, then both."""
    kinds = ["u1" if x.max(initial=0) < 1 << 8 else "u2" if x.max(initial=0) < 1 << 16 else "u4" for x in (ids, counts)]
    return "".join(kinds).encode() + ids.astype(kinds[0]).tobytes() + counts.astype(kinds[1]).tobytes()


def unpacked(data) -> tuple[np.ndarray, np.ndarray]:
    wide = [int(x) for x in bytes(data[:4]).decode().split("u")[1:]]
    n = (len(data) - 4) // sum(wide)
    return np.frombuffer(data, f"u{wide[0]}", n, 4), np.frombuffer(data, f"u{wide[1]}", n, 4 + n * wide[0])


def learn(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, *, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, gain: float = GAIN, seed: int = 7) -> Model:
    """Stochastic gradient descent, one text a step, with a linearly falling rate; `gain` scales the vectors' rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, ((1 << bits) + 1, dim)).astype(np.float32)
    output = rng.normal(0, 0.3, (2, dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    share = float(labels.mean()) if len(labels) else 0.0
    shared = np.uint32(1 << bits)
    if 0 < share < 1:
        step, steps = 0, epochs * len(texts)
        for _ in range(epochs):
            for k in rng.permutation(len(texts)):
                ids, counts = texts[k]
                ids = np.append(ids.astype(np.uint32), shared)
                part = np.append(counts, 1).astype(np.float32)
                part /= part.sum()
                hidden = part @ vectors[ids]
                out = output @ hidden + bias
                p = np.exp(out - out.max())
                p /= p.sum()
                p[int(labels[k])] -= 1
                now = np.float32(rate * (1 - step / steps))
                back = output.T @ p
                output -= now * np.outer(p, hidden)
                bias -= now * 0.1 * p
                vectors[ids] -= (now * np.float32(gain)) * part[:, None] * back
                step += 1
    else:
        output[:] = 0
    odds = lambda q: float(np.log(max(q, 1e-6) / max(1 - q, 1e-6)))
    bias[1] += odds(prior) - (odds(share) if 0 < share < 1 else 0)
    return Model(vectors, output, bias)


def scores(column: pa.Array, table: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    """Each text's probability of label 1."""
    data, offsets = kit.text_bytes(column)
    out = np.zeros(len(offsets) - 1)
    for a, b in kit.chunks(offsets):
        total, count = np.full(b - a, float(table[1 << bits])), np.ones(b - a)
        for f, at in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits):
            sizes = np.diff(at)
            if len(f):
                full = np.flatnonzero(sizes)
                total[full] += np.add.reduceat(table[f].astype(np.float64), at[full])
            count += sizes
        out[a:b] = total / count
    return np.round(1 / (1 + np.exp(-np.clip(out + bias, -35, 35))), 9)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out=lambda i: kit.keep_out(i, 3, 1), per_class: int = PER_CLASS, bits: int = BITS) -> Model:
    """A model from the sampled labelled rows of `docs`; only their feature counts reach the driver."""
    sample, prior = labelled_sample(labels, label_col, id_col, held_out, per_class)
    rows = taught(docs, sample, lambda texts: [packed(*x) for x in bags(texts, bits)], id_col, text_col, SAMPLE_BYTES)
    out = learn([unpacked(x.as_buffer()) for x in rows["_set"]], rows["_label"].to_numpy().astype(float), prior, bits=bits)
    del rows
    kit.release()
    return out


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model.table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), table, bias, bits))], ["_id", "_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, _score double").select(F.col("_id").alias(id_col), F.col("_score").alias("score"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    out = score(docs, train(docs, labels, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)
    return out.select(id_col, kit.keep_out(F.col(id_col), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
