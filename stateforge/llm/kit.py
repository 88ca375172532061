"""What the operators of this package share: shared storage, bounded broadcasts, byte-level text kernels.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, which in
UTF-8 is the same as the runs of such code points.  All kernels work on whole
Arrow columns with numpy, and never on a prefix of a text.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Shuffle partitions that one task writes at most (`written`).
GATHERED = 8
#: Bytes of text that a kernel handles at a time (a longer text is handled alone).
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C55
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: ASCII other than letters and digits: what parts words where punctuation should not count.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset (local tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, compact: bool = True) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: a cut of the lineage that survives lost executors.

    `compact` gathers what comes from a shuffle into fewer files: two a core, but
    never more than GATHERED shuffle partitions in one, so that a task's share grows
    with the size of these alone.  Not for what comes straight from a scan, whose
    tasks are heavy.
    """
    spark = df.sparkSession
    if compact:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // GATHERED)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """`df` kept on the executors (memory, then disk) for a few uses, to be unpersisted after them; what a lost executor held is computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, object]):
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def small_batches(spark: SparkSession, rows: int = 1000):
    """While it lasts, rows go to Python and into the cache by so many: where rows are texts or sets, a default batch of them is large in every buffer it passes."""
    return _settings(spark, dict.fromkeys(("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.inMemoryColumnarStorage.batchSize"), rows))


def hinted_broadcasts(spark: SparkSession):
    """While it lasts, only joins that are hinted so are broadcast: each broadcast is gathered and built on the driver, which in a job of many small joins adds up there."""
    return _settings(spark, dict.fromkeys(("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"), -1))


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, else as it is (a shuffle join, split on skew by AQE)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pack(vector: np.ndarray) -> bytes:
    """A vector as bytes, plane by plane: the high bytes of small numbers become one run of zeros, which any codec shortens."""
    return vector.view(np.uint8).reshape(len(vector), -1).T.tobytes()


def unpack(data, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    return np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T.copy().reshape(-1).view(kind)


def tree_sum(df: DataFrame, column: str, dtype: str, fan_in: int = 64, combine=np.add) -> np.ndarray | None:
    """The elementwise sum (or other ufunc) of equally long vectors as `pack` writes them, a row each; None of no rows.

    One job: the vectors are added up on the executors, about `fan_in` at a time
    and streaming, level by level, until one is left; that one reaches the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                one = unpack(x.as_buffer(), dtype)
                total = one if total is None else combine(total, one, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pack(total)], pa.binary())], [column])

    level, n = df.select(column), df.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan_in)
        level = level.repartition(n).mapInArrow(add, f"`{column}` binary")
    rows = level.collect()
    total = None
    for row in rows:
        one = unpack(row[0], dtype)
        total = one if total is None else combine(total, one)
    return total


def release() -> None:
    """Gives the memory of dropped tables and arrays back to the system: on the driver, or at the end of a task by its Python worker, which stays."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Filter:
    """A set of 64-bit hashes as a bit map of limited size: says yes for all members, and seldom for others.

    Sixteen bits a member, at most `LARGEST` (32 MB): beyond 16 million members
    it lets more others through, which costs speed and nothing else.
    """

    LARGEST = 28

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Filter:
        log2 = min(cls.LARGEST, max(13, int(df.count()).bit_length() + 4))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << (log2 - 3), np.uint8)
            for batch in batches:
                at = cls.places(batch.column(0).to_numpy(), log2)
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([pack(bits)], pa.binary())], ["bits"])

        bits = tree_sum(df.select(column).coalesce(256).mapInArrow(run, "bits binary"), "bits", "u1", combine=np.bitwise_or)
        return cls(np.zeros(1 << (log2 - 3), np.uint8) if bits is None else bits, log2)

    @staticmethod
    def places(h: np.ndarray, log2: int) -> np.ndarray:
        return (mix(h.view(U64)) >> U64(64 - log2)).astype(np.int64)

    def may_have(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h, self.log2)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


# ---------------------------------------------------------------- text kernels


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the len+1 offsets of its texts (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHUNK_BYTES together."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the len+1 offsets of each text's words."""
    dark = ~white[data]
    if not len(dark):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    opens, closes = dark.copy(), dark.copy()
    opens[1:] &= ~dark[:-1]
    closes[:-1] &= ~dark[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    opens[inner] = dark[inner]
    closes[inner - 1] = dark[inner - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        made = []
        for base in (_BASE, _BASE_INVERSE):
            x = np.full(size, base, U64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values over all bits."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span's bytes, mixed."""
    out = np.empty(len(starts), U64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + 2 * CHUNK_BYTES, "right")))
        at = int(starts[a])
        part = data[at : int(ends[b - 1])]
        up, down = powers(len(part) + 1)
        total = np.empty(len(part) + 1, U64)
        total[0] = 0
        np.cumsum((part.astype(U64) + U64(1)) * up[: len(part)], out=total[1:])
        s, e = starts[a:b] - at, ends[a:b] - at
        out[a:b] = (total[e] - total[s]) * down[s]
        a = b
    return mix(out)


def salted(h: np.ndarray, salt: int) -> np.ndarray:
    return mix(h ^ U64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def grams(h: np.ndarray, *gaps: int) -> np.ndarray:
    """Hashes of the tuples (h[i], h[i+gap], ...) for all i where every part exists."""
    reach = max(gaps)
    n = max(0, len(h) - reach)
    out = h[:n] * U64(0xA24BAED4963EE407)
    for k, gap in enumerate(gaps):
        out = mix(out + U64(k + 1)) + h[gap : gap + n] * U64(0x9FB21C651E98DF25)
    return mix(out)


def within(bounds: np.ndarray, reach: int) -> np.ndarray:
    """Which i of the `bounds[-1] - reach` first places have i + reach in the same text; bounds are word offsets."""
    n = max(0, int(bounds[-1]) - reach)
    ok = np.ones(n, bool)
    if reach:
        inner = bounds[1:-1]
        for back in range(1, reach + 1):
            at = inner - back
            ok[at[(at >= 0) & (at < n)]] = False
    return ok


def keep_out(doc_id, divisor: int, remainder: int):
    """Whether crc32 of the id as text leaves that remainder: the rows whose labels nobody learns from (null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor == remainder, F.lit(False))
