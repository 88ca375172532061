"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashed words, neighbouring pairs and pairs one word
apart that occur in it (lower case, ASCII punctuation parts words); presence
counts, not frequency, so a long text isn't diluted.  Learning runs on the
driver over a bounded sample of labelled rows (`per_class` of each label, the
smallest hashes of the id first, and of these as many as have `SAMPLE_BYTES` of
features together) with per-coordinate rates; L1 leaves few weights, and only
these are broadcast.  The intercept is moved from the
sample's odds to those of all labelled rows.

Defined results: null and empty texts get the intercept's score; null ids and
labels are never learnt from; an id with several labels counts with the
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
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stateforge.llm import kit

#: Feature space, sample bound and FTRL parameters.
BITS, PER_CLASS, SAMPLE_BYTES, EPOCHS = 20, 4000, 64 << 20, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.2


@dataclass
class Weights:
    """Non-zero weights by feature, and the intercept."""

    ids: np.ndarray
    values: np.ndarray
    bias: float
    bits: int = BITS

    def table(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.ids] = self.values
        return out


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) arrays of words, pairs and skip pairs; features repeat."""
    starts, ends, bounds = kit.word_spans(data, offsets, kit.PUNCTUATION)
    h = kit.word_hashes(kit.LOWER[data], starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    shift = np.uint64(64 - bits)
    yield text, (kit.salted(h, 1) >> shift).astype(np.int64)
    for gap in (1, 2):
        ok = kit.within(bounds, gap)
        yield text[: len(ok)][ok], (kit.salted(kit.grams(h, 0, gap), 1 + gap) >> shift).astype(np.int64)[ok]


def feature_sets(column: pa.Array, bits: int = BITS) -> list[np.ndarray]:
    """Each text's distinct features, sorted."""
    data, offsets = kit.text_bytes(column)
    out = []
    for a, b in kit.chunks(offsets):
        keys = np.concatenate([(t << bits) | f for t, f in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)])
        keys = np.unique(keys)
        cut = np.searchsorted(keys, np.arange(b - a + 1) << bits)
        out += [(keys[i:j] & ((1 << bits) - 1)).astype(np.uint32) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return out


def learn(sets: list[np.ndarray], labels: np.ndarray, prior: float, *, bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, seed: int = 7) -> Weights:
    """FTRL-proximal over the examples in a seeded order; `prior` is the share of label 1 among all labelled rows."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = bias = 0.0
    rng = np.random.default_rng(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs if 0 < labels.mean() < 1 else 0) if len(labels) else ():
        for k in rng.permutation(len(sets)):
            i = sets[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[k]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias
            nb += g * g
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
    ids = np.flatnonzero(np.abs(z) > l1)
    odds = lambda p: float(np.log(max(p, 1e-6) / max(1 - p, 1e-6)))
    share = float(labels.mean()) if len(labels) else 0.5
    return Weights(ids.astype(np.uint32), weights(ids).astype(np.float32), float(bias) + odds(prior) - odds(share) if 0 < share < 1 else odds(prior), bits)


def scores(column: pa.Array, table: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    """Each text's probability of label 1."""
    data, offsets = kit.text_bytes(column)
    out = np.zeros(len(offsets) - 1)
    for a, b in kit.chunks(offsets):
        found = []
        for t, f in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits):
            hit = np.flatnonzero(table[f])
            found.append((t[hit] << bits) | f[hit])
        keys = np.unique(np.concatenate(found))
        out[a:b] = np.bincount(keys >> bits, table[keys & ((1 << bits) - 1)].astype(float), b - a)
    return np.round(1 / (1 + np.exp(-np.clip(out + bias, -35, 35))), 9)


def labelled_sample(labels: DataFrame, label: str, id_col: str, held_out, per_class: int) -> tuple[DataFrame, float]:
    """At most `per_class` rows (id, label) of each label with the smallest hashes of the id, and the share of label 1 among all that may be learnt from."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg((F.max(label) > 0).cast("int").alias("_label"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    one = lambda v: known.where(F.col("_label") == v).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
    return one(0).unionByName(one(1)), counts.get(1, 0) / max(1, sum(counts.values()))


def taught(docs: DataFrame, sample: DataFrame, pack, id_col: str, text_col: str, most: int) -> pa.Table:
    """(_label, _set) of the sampled rows in the order of the hashes of their ids, as long as the sets have `most` bytes together (one row at least).

    `pack` gives each text of a column a binary set.  The sets are written first,
    so only what is within the bound comes to the driver.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pack(batch.column(2)), pa.binary())], ["_id", "_label", "_set"])

    sample = sample.select(F.col("_id").try_cast(kind).alias("_id"), "_label")
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_id", "_label", "_text")
    rows = found.mapInArrow(run, f"_id {kind}, _label int, _set binary").groupBy("_id").agg(F.max("_label").alias("_label"), F.min("_set").alias("_set"))
    rows = kit.written(rows.withColumn("_at", F.xxhash64("_id")), "sample")
    line = W.orderBy("_at", "_id").rowsBetween(W.unboundedPreceding, -1)  # of 2 * per_class rows at most
    inside = rows.select("_id", "_at", F.coalesce(F.sum(F.octet_length("_set")).over(line), F.lit(0)).alias("_before")).where(F.col("_before") < most)
    return rows.join(F.broadcast(inside.select("_id")), "_id").orderBy("_at", "_id").select("_label", "_set").toArrow()


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out=lambda i: kit.keep_out(i, 4, 2), per_class: int = PER_CLASS) -> Weights:
    """Weights from the sampled labelled rows of `docs`; only their feature sets reach the driver."""
    sample, prior = labelled_sample(labels, label_col, id_col, held_out, per_class)
    rows = taught(docs, sample, lambda texts: [x.tobytes() for x in feature_sets(texts)], id_col, text_col, SAMPLE_BYTES)
    out = learn([np.frombuffer(x.as_buffer(), np.uint32) for x in rows["_set"]], rows["_label"].to_numpy().astype(float), prior)
    del rows
    kit.release()
    return out


def score(docs: DataFrame, weights: Weights, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` columns (default: the id) and `score` of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(weights)
    keep = keep or (id_col,)
    inner = docs.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(keep)), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        table = w.table()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores(batch.column(batch.num_columns - 1), table, w.bias, w.bits))], names)

    names = [*(f"_{k}" for k in range(len(keep))), "_score"]
    out = inner.mapInArrow(run, ", ".join([*(f"_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)), "_score double"]))
    return out.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(keep)), F.col("_score").alias("score"))


def below(docs: DataFrame, weights: Weights, threshold: float, *, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose score is below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        table = w.table()
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(batch.schema.get_field_index(text_col)), table, w.bias, w.bits) < threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    w = train(docs, labels, id_col=id_col, text_col=text_col)
    out = score(docs, w, id_col=id_col, text_col=text_col)
    return out.select(id_col, kit.keep_out(F.col(id_col), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
