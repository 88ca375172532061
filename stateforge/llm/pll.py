"""LM scoring: masked pseudo-likelihood.

A bidirectional window network predicts every word from the words on both
sides of it and never sees the word itself; a document's score is the sum of
the log-probabilities of its words.

Words (lower case, A-Z) are counted over the whole corpus.  The network has
base * base tokens, the square root of the number of distinct words or more
(`base_of`), so it grows with the corpus: the most frequent words are three in
four of them, all others share the rest by hash.  A word of a shared token has
the probability of its token times count(word) / count(token), from the full
table of counts, so every word has a probability of its own.  That table stays
distributed: each group of texts asks for the counts of its own words.

The input is one table of vectors, weighted by place (2 to the left, 2 to the
right; beyond a text's ends stands a blank token), and tanh.  The output is a
softmax in two digits of the base: p(high | window) * p(low | window, high).
Output biases begin at the corpus counts.

Training reads every word of every document.  A hash of its id and text deals a
document to one of `ROUNDS` rounds and to a learner of about `LEARNER_WORDS`
words in it, and orders them there; each learner runs stochastic gradient descent
in numpy from the round's network, and the networks are averaged by words read,
by a tree of sums on the executors.  So how a table is partitioned changes no
more than the order of these sums.  What reaches the driver is the network:
in the order of the square root of the number of distinct words.

Defined results: null and empty texts have no words and score 0; repeated rows
are each scored (and learned from); columns beside id and text are ignored; an empty
table gives an empty result.  Scores are rounded to 6 digits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateforge.llm import kit

#: The least base, and what follows from it; larger corpora have more (`base_of`).
BASE, DIM, SIDE = 32, 16, 2
TOKENS = BASE * BASE
ROUNDS, BATCH, RATE, LEARNER_WORDS = 2, 1024, 0.3, 1 << 21
f4 = np.float32
ONES = np.ones(1 << 16, f4)
#: Rate of the vectors, which few words of a batch touch, against that of the rest.
GAIN = f4(8)
#: Bytes of text (about) that ask for the counts of their words together.
GROUP_BYTES = 1 << 24


def base_of(distinct: int) -> int:
    """The base for so many distinct words: its square is at least their square root."""
    return max(BASE, math.ceil(distinct**0.25))


def named_of(base: int) -> int:
    """How many words are tokens of their own."""
    return base * base * 3 // 4


class Vocabulary:
    """Tokens by word hash: the frequent words' hashes, sorted, and their tokens."""

    def __init__(self, hashes: np.ndarray, base: int = BASE):
        """`hashes`: most frequent first."""
        self.base, self.size, self.named = base, base * base, named_of(base)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def tokens(self, h: np.ndarray) -> np.ndarray:
        rest = (self.named + (h % np.uint64(self.size - self.named)).astype(np.int64)).astype(np.int32)
        if not len(self.sorted):
            return rest
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], rest).astype(np.int32)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the len+1 word offsets of the texts."""
    starts, ends, bounds = kit.word_spans(data, offsets)
    return kit.word_hashes(kit.LOWER[data], starts, ends), bounds


def laid_out(tokens: np.ndarray, bounds: np.ndarray, blank: int = TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """The texts' tokens in a row with SIDE blanks before, between and after them; and the tokens' places."""
    place = np.arange(len(tokens)) + SIDE * np.repeat(np.arange(1, len(bounds)), np.diff(bounds))
    row = np.full(len(tokens) + SIDE * len(bounds), blank, np.int32)
    row[place] = tokens
    return row, place


class Network:
    """Parameters as views of one flat vector."""

    @staticmethod
    def shapes(base: int) -> dict[str, tuple[int, ...]]:
        return {"vectors": (base * base + 1, DIM), "places": (2 * SIDE, DIM), "shift": (DIM,), "high": (DIM, base), "high_bias": (base,), "given": (base, DIM), "low": (DIM, base), "low_bias": (base, base)}

    def __init__(self, flat: np.ndarray, base: int = BASE):
        self.flat, self.base, self.blank, at = flat, base, base * base, 0
        for name, shape in self.shapes(base).items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def begin(cls, counts: np.ndarray, seed: int = 11) -> Network:
        """Small random vectors and the biases of the token counts."""
        base = math.isqrt(len(counts))
        net = cls(np.random.default_rng(seed).normal(0, 0.1, sum(int(np.prod(s)) for s in cls.shapes(base).values())).astype(f4), base)
        net.places[:] = 1 / SIDE
        net.shift[:] = 0
        p = (counts + 0.5).reshape(base, base)
        net.high_bias[:] = np.log(p.sum(axis=1) / p.sum())
        net.low_bias[:] = np.log(p / p.sum(axis=1, keepdims=True))
        return net

    def forward(self, row: np.ndarray, a: int, b: int):
        """What is computed for the targets row[a:b]: log-probabilities and all that learning needs."""
        around = self.vectors[row[a - SIDE : b + SIDE]]
        n = b - a
        x = np.broadcast_to(self.shift, (n, DIM)).copy()
        for k, o in enumerate((*range(-SIDE, 0), *range(1, SIDE + 1))):
            x += around[SIDE + o : SIDE + o + n] * self.places[k]
        target = np.minimum(row[a:b], self.blank - 1)
        hi, lo = target // self.base, target % self.base
        h = np.tanh(x)
        g = np.tanh(x + self.given[hi])
        at = np.arange(n)
        high = h @ self.high + self.high_bias
        low = g @ self.low + self.low_bias[hi]
        out = np.zeros(n, f4)
        for z, d in ((high, hi), (low, lo)):
            z -= np.ascontiguousarray(z.T).max(axis=0)[:, None]
            out += z[at, d]
            np.exp(z, out=z)
            total = z @ ONES[: z.shape[1]]
            out -= np.log(total)
            z /= total[:, None]
        return out, (around, hi, lo, h, g, high, low)

    def step(self, row: np.ndarray, a: int, b: int, rate: float) -> None:
        """One step of gradient descent on the mean loss of the targets row[a:b] that aren't blanks."""
        _, (around, hi, lo, h, g, high, low) = self.forward(row, a, b)
        n, at = b - a, np.arange(b - a)
        real = row[a:b] < self.blank
        scale = f4(rate / max(1, real.sum()))
        high[at, hi] -= 1
        low[at, lo] -= 1
        high *= real[:, None]
        low *= real[:, None]
        dx2 = (low @ self.low.T) * (1 - g * g)
        dx = (high @ self.high.T) * (1 - h * h) + dx2
        self.high -= scale * (h.T @ high)
        one = ONES[:n]  # sums as products: several times as fast as reductions of narrow rows
        self.high_bias -= scale * (one @ high)
        self.low -= scale * (g.T @ low)
        onehot = np.zeros((self.base, n), f4)
        onehot[hi, at] = 1
        self.given -= scale * GAIN * (onehot @ dx2)
        self.low_bias -= scale * (onehot @ low)
        self.shift -= scale * (one @ dx)
        back = np.zeros_like(around)
        for k, o in enumerate((*range(-SIDE, 0), *range(1, SIDE + 1))):
            back[SIDE + o : SIDE + o + n] += dx * self.places[k]
            self.places[k] -= scale * (one @ (dx * around[SIDE + o : SIDE + o + n]))
        seen = row[a - SIDE : b + SIDE]
        order = np.argsort(seen.astype(np.uint16) if self.blank < 1 << 16 else seen, kind="stable")
        ids = seen[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        self.vectors[ids[first]] -= scale * GAIN * np.add.reduceat(back[order], first, axis=0)


def learned(flat: np.ndarray, rows: Iterator[np.ndarray], rate: float = RATE, base: int = BASE) -> tuple[np.ndarray, int]:
    """The parameters after one pass over the laid out rows, and the number of words read."""
    net, words = Network(flat.copy(), base), 0
    for row in rows:
        for a in range(SIDE, len(row) - SIDE, BATCH):
            net.step(row, a, min(a + BATCH, len(row) - SIDE), rate)
        words += int((row < net.blank).sum())
    return net.flat, words


def scored(net: Network, row: np.ndarray, place: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of log-probabilities of each text's words."""
    each = np.zeros(len(row))
    for a in range(SIDE, len(row) - SIDE, 4 * BATCH):
        b = min(a + 4 * BATCH, len(row) - SIDE)
        each[a:b] = net.forward(row, a, b)[0]
    total = np.append(0.0, np.cumsum(each[place]))
    return total[bounds[1:]] - total[bounds[:-1]]


def vocabulary(docs: DataFrame, text_col: str = "text") -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """The tokens of the most frequent words, every token's count, and (h, n) of every word, from all words of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kit.text_bytes(batch.column(0))
            held = [word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0] for a, b in kit.chunks(offsets)]
            h, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    words = kit.written(docs.select(text_col).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    base = base_of(words.count())
    named = words.orderBy(F.desc("n"), "h").limit(named_of(base)).collect()
    top = Vocabulary(np.array([r[0] for r in named], np.int64).view(np.uint64), base)

    def by_token(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(top.size, np.int64)
        for batch in batches:
            np.add.at(total, top.tokens(batch.column(0).to_numpy().view(np.uint64)), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([kit.pack(total)], pa.binary())], ["counts"])

    counts = kit.tree_sum(words.mapInArrow(by_token, "counts binary"), "counts", "i8")
    return top, np.zeros(top.size, np.int64) if counts is None else counts, words


def train(docs: DataFrame, top: Vocabulary, counts: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Network:
    """The network after `rounds` rounds; each document is read in one of them."""
    sc = docs.sparkSession.sparkContext
    net = Network.begin(counts)
    learners = max(1, -(-int(counts.sum()) // (rounds * LEARNER_WORDS)))
    place = F.xxhash64(F.lit(rounds), F.col(id_col), F.col(text_col))
    dealt = docs.select(F.pmod(place, F.lit(rounds)).alias("turn"), F.pmod(F.shiftrightunsigned(place, 8), F.lit(learners)).alias("learner"), place.alias("place"), F.col(text_col).alias("text"))
    width = np.dtype(np.uint16 if top.size < 1 << 16 else np.int32)
    known = sc.broadcast(top)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as tokens: a third of what they take, before they are moved."""
        for batch in batches:
            data, offsets = kit.text_bytes(batch.column(2))
            for a, b in kit.chunks(offsets):
                h, bounds = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                packed = known.value.tokens(h).astype(width)
                out = [packed[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(out, pa.binary())], ["learner", "place", "tokens"])

    for turn in range(rounds):
        sent = sc.broadcast((top.base, net.flat))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            base, flat = sent.value
            rows = ((k, np.frombuffer(x.as_buffer(), width)) for batch in batches for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
            for _, mine in itertools.groupby(rows, key=lambda x: x[0]):
                texts = [x for _, x in mine]
                row = laid_out(np.concatenate(texts), np.append(0, np.cumsum([len(x) for x in texts])), base * base)[0]
                del texts
                learnt, words = learned(flat, iter([row]), base=base)
                yield pa.RecordBatch.from_arrays([pa.array([kit.pack(np.append(learnt.astype(np.float64) * words, words))], pa.binary())], ["net"])

        read = dealt.where(F.col("turn") == turn).select("learner", "place", "text").mapInArrow(tokens, "learner long, place long, tokens binary")
        read = read.repartition("learner").sortWithinPartitions("learner", "place")
        total = kit.tree_sum(read.select("learner", "tokens").mapInArrow(run, "net binary"), "net", "f8")
        if total is not None and total[-1] > 0:
            net = Network((total[:-1] / total[-1]).astype(f4), top.base)
    return net


def groups(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about GROUP_BYTES of text at most (a longer text is alone)."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + GROUP_BYTES, "right")))
            yield batch.slice(a, b - a)
            a = b


def counted(asked: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Of one group's rows: those of texts, and the sum of log count(word) over each one's words of shared tokens."""
    ask = asked.filter(pc.is_null(asked["n_words"]))
    if ask["n"].null_count:
        raise ValueError("the texts have changed since their words were counted")
    logs = np.log(ask["n"].to_numpy()[np.argsort(ask["h"].to_numpy())])
    texts = asked.filter(pc.is_valid(asked["n_words"]))
    at = [np.frombuffer(x.as_buffer(), np.int32) for chunk in texts["at"].chunks for x in chunk]
    text = np.repeat(np.arange(len(at)), [len(x) for x in at])
    return texts, np.bincount(text, logs[np.concatenate(at)] if len(text) else None, minlength=len(at))


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_likelihood, per_word) of every row, by the network trained on `docs` itself and the counts of all words.

    One pass over the texts gives a row a text, with the places of its words of
    shared tokens in its group's list of words, and a row for each of that list,
    which meets its count; then each group's rows come together.
    """
    top, counts, words = vocabulary(docs, text_col)
    net = train(docs, top, counts, id_col=id_col, text_col=text_col)
    sent = docs.sparkSession.sparkContext.broadcast((top, net.flat, np.log(np.maximum(counts, 1))))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat, log_counts = sent.value
        network = Network(flat, vocabulary.base)
        for batch in groups(batches, 2):
            data, offsets = kit.text_bytes(batch.column(2))
            total, n_words, n_shared, shared = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [np.zeros(0, np.int64)]
            for a, b in kit.chunks(offsets):
                h, bounds = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                tokens = vocabulary.tokens(h)
                row, place = laid_out(tokens, bounds, vocabulary.size)
                rest = tokens >= vocabulary.named
                text = np.repeat(np.arange(b - a), np.diff(bounds))[rest]
                total[a:b] = scored(network, row, place, bounds) - np.bincount(text, log_counts[tokens[rest]], minlength=b - a)
                n_words[a:b], n_shared[a:b] = np.diff(bounds), np.bincount(text, minlength=b - a)
                shared.append(h[rest].view(np.int64))
            ask, at = np.unique(np.concatenate(shared), return_inverse=True)
            uid = batch.column(0).to_numpy()
            ends = np.append(0, np.cumsum(4 * n_shared)).astype(np.int64)
            at = pa.Array.from_buffers(pa.large_binary(), len(uid), [None, pa.py_buffer(ends), pa.py_buffer(at.astype(np.int32))]).cast(pa.binary())
            names = ["g", "h", "_id", "n_words", "total", "at"]
            # What stands in for a text's word hash only deals the texts out evenly.
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uid), uid[0])), pa.array(kit.mix(uid.view(np.uint64)).view(np.int64)), batch.column(1), pa.array(n_words), pa.array(total), at], names)
            for a in range(0, len(ask), 1 << 16):
                h = ask[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), uid[0])), pa.array(h), pa.nulls(len(h), batch.column(1).type), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.float64()), pa.nulls(len(h), pa.binary())], names)

    def add(asked: pa.Table) -> pa.Table:
        texts, logs = counted(asked)
        n = texts["n_words"].to_numpy()
        total = texts["total"].to_numpy() + logs
        return pa.table([texts["_id"], pa.array(n), pa.array(np.round(total, 6)), pa.array(np.round(total / np.maximum(n, 1), 6))], ["_id", "n_words", "log_likelihood", "per_word"])

    asked = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"g long, h long, _id {kind}, n_words long, total double, at binary")
    found = asked.join(words.withColumnRenamed("h", "_h").hint("shuffle_hash"), F.col("h") == F.col("_h"), "left").drop("_h")
    return found.groupBy("g").applyInArrow(add, f"_id {kind}, n_words long, log_likelihood double, per_word double").withColumnRenamed("_id", id_col)
