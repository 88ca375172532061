"""N-gram Jaccard join by a token-group matrix.

A document's set is its distinct `words`-word shingles (words in lower case,
A-Z only; with fewer words the whole sequence as one), as 64-bit hashes.  Two
documents link when 100 * intersection >= percent * union.  The join finds the
classes of linked documents exactly:

1. Documents with equal sets are one node.
2. Two nodes of n and m tokens that link have a = ceil(percent * (n + m) / (100 +
   percent)) tokens in common at least.  In one order of all tokens, rarest first,
   they so share `SHARED` (or a, if fewer) of each one's first n - a + SHARED, its
   prefix for that partner.  Rarity comes from a table of counters of fixed size;
   any common order is exact.  Only tokens that two prefixes share are kept, and
   only nodes that have enough of them; the sets of these are read once.
3. Hubs: of the nodes that share a token the one with the fewest tokens of its own
   is the hub, and each node is compared with the hub that most of its tokens name.
   Near copies of one text mostly link to it, and so are one part from here on.
4. Groups: nodes of a part of `GROUP` or more are groups of their own; the others
   go by the least of their shared prefix tokens.  What is larger than `GROUP`
   members or `TOKENS` tokens is cut by size and hash.
5. The matrix has a row of bits a group: the union of its members' tokens,
   hashed to columns.  A query is a node and each group of another part whose
   members' prefixes have enough of its prefix tokens; nodes of large parts ask
   only parts that are larger still, all others ask these and later groups.
   Tokens of the query that meet no bit bound the overlap from above; another group
   is opened only if the bound reaches what a link takes.
   In an opened group the same bound, both ways, leaves out members one by one.
6. A query's overlaps with the members left are counted at once, exactly, by the
   members' token lists; of the links that hold, those that join parts not joined
   yet are given.

Connected components of the links are the classes.  A family of m near copies
around one text costs a comparison a node with its hub, and no node asks its own
part; nodes that link to no hub but share prefixes with k members of their family
cost k / GROUP queries each.  How many links a class has isn't counted, as that
takes the pairs.  Nothing but counters and filters of fixed size reaches the driver.

Defined results: null and empty texts (and such without words) have an empty set, link with
nothing and are their own class; rows of equal text are one class; a class id
is the least document id in it, null only if all its ids are null; rows of one
id but different texts are different documents; other columns are ignored.
Equal 64-bit hashes of different shingles or sets would count as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stateforge.llm import graph, kit

#: Members of a group and queries that meet a copy of it together, tokens of either, counters (a power of 2), rows broadcast.
GROUP, TOGETHER, TOKENS, COUNTERS, BROADCAST_ROWS = 256, 512, 1 << 21, 21, 500_000
#: Rows that a worker unpacks at a time; prefix tokens that two linked nodes must share.
SLICE, SHARED = 1000, 4


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    data, offsets = kit.text_bytes(column)
    for a, b in kit.chunks(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, bounds = kit.word_spans(part, offsets[a : b + 1] - offsets[a])
        h = kit.word_hashes(kit.LOWER[part], starts, ends)
        g = kit.grams(h, *range(words))
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if j - i >= words:
                yield np.unique(g[i : j - words + 1])
            elif j > i:
                yield kit.grams(kit.salted(h[i:j], j - i), *range(j - i))
            else:
                yield np.zeros(0, np.uint64)


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix(tokens: np.ndarray, counters: np.ndarray, percent: int) -> np.ndarray:
    """The rarest tokens, rarest first: of those any linked set has min(SHARED, overlap) at least in its own prefix."""
    n = len(tokens)
    rarity = counters[(tokens >> np.uint64(64 - COUNTERS)).astype(np.int64)]
    return tokens[np.lexsort((tokens, rarity))[: n - -(-percent * n // 100) + SHARED]]


def added(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Sums of 16-bit counters, which stop at 65,535 in whatever order they are added."""
    return np.minimum(a.astype(np.uint32) + b, 0xFFFF).astype(np.uint16)


def common(n, m, percent: int):
    """How many tokens two linked sets of n and m (columns) have in common at least."""
    return F.ceil((n + m) * percent / (100 + percent))


def bits_of(tokens: np.ndarray) -> np.ndarray:
    """A row of the matrix: a bit map of 4 to 8 columns a token, by the tokens' top bits after mixing."""
    log2 = max(6, int(len(tokens)).bit_length() + 2)
    out = np.zeros(1 << log2, bool)
    out[(kit.salted(tokens, 5) >> np.uint64(64 - log2)).astype(np.int64)] = True
    return np.packbits(out)


def folded(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Bit maps at a common width, stacked: neighbouring columns of a wider one become one."""
    return np.stack([np.unpackbits(r).reshape(width, -1).max(axis=1) for r in rows])


def missing(some: np.ndarray, other: np.ndarray) -> int:
    """How many bits of one map the other has not, at the coarser width of the two."""
    width = min(len(some), len(other)) * 8
    x = folded([some, other], width)
    return int((x[0] > x[1]).sum())


class Group:
    """The members' token lists of an opened group, and which members and queries are joined so far."""

    def __init__(self, names: list[int], sets: list[np.ndarray], percent: int):
        self.names, self.percent, self.sizes = names, percent, np.array(list(map(len, sets)))
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.tokens, first = np.unique(flat[order], return_index=True)
        self.owner, self.bounds = owner[order], np.append(first, len(flat))
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def linked(self, query: np.ndarray) -> np.ndarray:
        """The members whose sets have 100 * intersection >= percent * union with the query's."""
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        lengths = self.bounds[at + 1] - self.bounds[at]
        hits = np.repeat(self.bounds[at] - np.append(0, np.cumsum(lengths))[:-1], lengths) + np.arange(lengths.sum())
        common = np.bincount(self.owner[hits], minlength=len(self.sizes))
        return np.flatnonzero((common > 0) & (100 * common >= self.percent * (len(query) + self.sizes - common)))

    def joined(self, name: int, query: np.ndarray) -> list[tuple[int, int]]:
        """The query's links that join parts which weren't joined before."""
        out = []
        for k in self.linked(query).tolist():
            a, b = self.root(name), self.root(self.names[k])
            if a != b:
                self.parent[a] = b
                out.append((name, self.names[k]))
        return out


def _scan(docs: DataFrame, words: int, emit, schema: str) -> DataFrame:
    """emit(ids, sets) -> columns, over Arrow batches of (id, text)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                yield pa.RecordBatch.from_arrays(emit(part.column(0), list(shingle_sets(part.column(1), words))), names)
        kit.release()

    return docs.mapInArrow(run, schema)


def _visits(members: DataFrame, queries: DataFrame) -> DataFrame:
    """(g, place, v, member, asks): which nodes meet where.

    The queries (g, v, n) of a group are dealt to as many places as they need, and
    its members (g, v) go to each.  Only ids are moved for this.
    """
    places = queries.groupBy("g").agg(F.ceil(F.greatest(F.count("v") / TOGETHER, F.sum("n") / TOKENS)).cast("int").alias("places"))
    left = members.join(places, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), "v", F.lit(True).alias("member"), F.lit(False).alias("asks"))
    right = queries.join(places, "g").select("g", F.pmod(F.xxhash64("v"), F.col("places")).cast("int").alias("place"), "v", F.lit(False).alias("member"), F.lit(True).alias("asks"))
    return left.unionByName(right).groupBy("g", "place", "v").agg(F.bool_or("member").alias("member"), F.bool_or("asks").alias("asks"))


def _meeting(rows: DataFrame, payload: str, settle, schema: str) -> DataFrame:
    """settle(rows of (v, member, asks, n, payload as array)) -> rows, for every place (g, place) of `rows`; a place is small, and places stream."""
    names = [x.split()[0] for x in schema.split(", ")]
    kind = np.uint8 if payload == "bits" else np.uint64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []

        def out() -> pa.RecordBatch:
            cols = list(zip(*settle(here, held), strict=True)) or [()] * len(names)
            types = [pa.bool_() if f.endswith("boolean") else pa.int32() if f.endswith(" int") else pa.int64() for f in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            for g, place, v, member, asks, n, x in zip(*(c.to_pylist() for c in batch.columns[:6]), batch.column(6), strict=True):
                if (g, place) != here:
                    if held:
                        yield out()
                    here, held = (g, place), []
                held.append((v, member, asks, n, np.frombuffer(x.as_buffer(), kind).copy()))
        if held:
            yield out()
        here, held = None, []
        kit.release()

    met = rows.select("g", "place", "v", "member", "asks", "n", payload).repartition("g", "place").sortWithinPartitions("g", "place", "v")
    return met.mapInArrow(run, schema)


def _screened(rows: DataFrame, percent: int) -> DataFrame:
    """The visits (g, place, v, member, asks, n, bits) that the pairwise bound leaves: members with a query that may link, and such queries."""

    def settle(here: tuple, held: list[tuple]) -> list[tuple]:
        members = [k for k, r in enumerate(held) if r[1]]
        width = min(len(r[4]) for r in held) * 8
        have = folded([r[4] for r in held], width).astype(bool)
        n = np.array([r[3] for r in held])
        wanted, asking = np.zeros(len(held), bool), np.zeros(len(held), bool)
        theirs, sizes = have[members], n[members]
        for k, r in enumerate(held):
            if not r[2]:
                continue
            most = np.minimum(n[k] - (have[k] & ~theirs).sum(axis=1), sizes - (theirs & ~have[k]).sum(axis=1))
            ok = (most > 0) & (100 * most >= percent * (n[k] + sizes - most))
            ok &= np.array(members) != k
            wanted[np.array(members)[ok]] = True
            asking[k] = ok.any()
        return [(*here, r[0], bool(wanted[k]), bool(asking[k])) for k, r in enumerate(held) if wanted[k] or asking[k]]

    return _meeting(rows, "bits", settle, "g long, place int, v long, member boolean, asks boolean")


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) links of the queries among visits (g, place, v, member, asks, n, tokens) with members of their place, as many as join different parts."""

    def settle(here: tuple, held: list[tuple]) -> list[tuple]:
        own = [r for r in held if r[1]]
        if not own:
            return []
        group = Group([r[0] for r in own], [r[4] for r in own], percent)
        return [link for v, _, asks, _, tokens in held if asks for link in group.joined(v, tokens)]

    return _meeting(rows, "tokens", settle, "a long, b long")


def _with_bits(sets: DataFrame) -> DataFrame:
    """(v, n, bits) of (v, n, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [bits_of(np.frombuffer(x.as_buffer(), np.uint64)).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bits, pa.binary())], ["v", "n", "bits"])

    return sets.select("v", "n", "tokens").mapInArrow(run, "v long, n long, bits binary")


def _bounded(pairs: DataFrame) -> DataFrame:
    """The (v, g, n) of pairs (v, g, n, need, bits, union) whose overlap bound allows a link of node v to a member of group g, for which it takes `need` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, need = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [missing(np.frombuffer(q.as_buffer(), np.uint8), np.frombuffer(u.as_buffer(), np.uint8)) <= n[k] - need[k] for k, (q, u) in enumerate(zip(batch.column(4), batch.column(5), strict=True))]
            yield batch.select([0, 1, 2]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "v long, g long, n long")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, with_node: bool = False) -> DataFrame:
    """(id, n_shingles, component_id[, node]) of every row; `node` names its set."""
    with kit.small_batches(docs.sparkSession, SLICE), kit.hinted_broadcasts(docs.sparkSession):
        return _joined(docs, id_col, text_col, words, percent, with_node)


def _joined(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, with_node: bool) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    # rarity of tokens: one table of counters a partition, added up
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, sets, n = np.zeros(1 << COUNTERS, np.uint32), [], 0

        def add() -> None:
            if n:
                counters[:] += np.bincount((np.concatenate(sets) >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS).astype(np.uint32)

        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                for tokens in shingle_sets(batch.column(0).slice(a, SLICE), words):
                    sets.append(tokens)
                    n += len(tokens)
                if n > 1 << 21:
                    add()
                    sets, n = [], 0
        add()
        yield pa.RecordBatch.from_arrays([pa.array([kit.pack(np.minimum(counters, 0xFFFF).astype(np.uint16))], pa.binary())], ["counters"])
        sets = []
        kit.release()

    counters = kit.tree_sum(texts.select("text").mapInArrow(count, "counters binary"), "counters", "u2", combine=added)
    counted = spark.sparkContext.broadcast(np.zeros(1 << COUNTERS, np.uint16) if counters is None else counters)
    del counters
    kit.release()

    # nodes: distinct sets
    def summary(ids: pa.Array, sets: list[np.ndarray]) -> list[pa.Array]:
        return [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64())]

    rows = kit.written(_scan(texts, words, summary, f"id {kind}, n long, v long").repartition("v"), "documents")
    nodes = kit.written(rows.where("n > 0").groupBy("v").agg(F.min("id").alias("id"), F.max("n").alias("n")), "nodes")

    # tokens in the prefixes of two nodes or more, and who has them
    def heads(only: kit.Filter | None):
        sent = spark.sparkContext.broadcast(only)

        def emit(ids: pa.Array, sets: list[np.ndarray]) -> list[pa.Array]:
            found, place, owner, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s in sets:
                head = prefix(s, counted.value, percent)
                at = np.flatnonzero(sent.value.may_have(head.view(np.int64))) if sent.value is not None else np.arange(len(head))
                if len(at):
                    found.append(head[at])
                    place.append(at)
                    owner.append(np.full(len(at), node_of(s)))
                    size.append(np.full(len(at), len(s)))
            return [pa.array(np.concatenate(x).view(np.int64)) for x in (found, owner, place, size)][: 2 if only is None else 4]

        return _scan(texts, words, emit, "token long, v long" if only is None else "token long, v long, at long, n long")

    shared = kit.kept(heads(None).groupBy("token").agg(F.min("v").alias("v"), F.max("v").alias("w")).where("v <> w").select("token"))
    posted = kit.kept(heads(kit.Filter.of(shared, "token")).distinct().join(shared.hint("shuffle_hash"), "token", "left_semi"))
    need = F.ceil(F.col("n") * percent / 100)
    enough = posted.groupBy("v").agg(F.count("token").alias("known"), F.max("n").alias("n")).where(F.col("known") >= F.least(F.lit(SHARED), need))
    alone = (F.least("n", F.col("n") - need + SHARED) - F.col("known")).alias("alone")
    postings = kit.written(posted.join(enough.select("v", alone).hint("shuffle_hash"), "v"), "postings")
    shared.unpersist()
    posted.unpersist()

    # the sets of these nodes, each read from the text of one document
    repeated = rows.groupBy("id", "v").count().where("count > 1").limit(1).count() > 0
    wanted = kit.kept(postings.select("v").distinct().join(nodes.select("v", "id"), "v"))
    wanting = spark.sparkContext.broadcast(kit.Filter.of(wanted, "v"))

    def tokens(ids: pa.Array, sets: list[np.ndarray]) -> list[pa.Array]:
        v = np.array([node_of(s) for s in sets], np.int64)
        hit = np.flatnonzero(wanting.value.may_have(v)) if len(v) else np.zeros(0, np.int64)
        return [ids.take(pa.array(hit)), pa.array(v[hit]), pa.array([len(sets[k]) for k in hit], pa.int64()), pa.array([sets[k].tobytes() for k in hit], pa.binary())]

    mine = kit.bounded_broadcast(wanted.select(F.col("v").alias("_v"), F.col("id").alias("_id")), BROADCAST_ROWS)
    found = _scan(texts, words, tokens, f"id {kind}, v long, n long, tokens binary")
    once = found.join(mine, (F.col("v") == F.col("_v")) & F.col("id").eqNullSafe(F.col("_id"))).select("v", "n", "tokens")
    sets = kit.kept(once.dropDuplicates(["v"]) if repeated else once)
    held = [wanted, sets]

    def links_at(visits: DataFrame) -> DataFrame:
        return _links(sets.join(kit.bounded_broadcast(visits, BROADCAST_ROWS), "v"), percent)

    # each node and the hub that most of its tokens name
    alike = lambda n, m: (n * 100 >= m * percent) & (m * 100 >= n * percent)
    hubs = postings.groupBy("token").agg(F.min(F.struct("alone", "v", "n")).alias("hub"))
    beside = postings.join(hubs.hint("shuffle_hash"), "token").select("v", "n", F.col("hub.v").alias("g"), F.col("hub.n").alias("m")).where((F.col("v") != F.col("g")) & alike(F.col("n"), F.col("m")))
    beside = beside.groupBy("v", "g").agg(F.count("n").alias("known"), F.max("n").alias("n"))
    calls = kit.written(beside.groupBy("v").agg(F.max_by(F.struct("g", "n"), F.struct("known", "g")).alias("x")).select("v", "x.g", "x.n"), "calls")
    parts = graph.components(links_at(_visits(calls.select("g", F.col("g").alias("v")).distinct(), calls)))
    parts = kit.kept(parts.select(F.col("node").alias("v"), F.col("root").alias("c")))
    held.append(parts)

    # groups: of a large part each (`part` orders these by size), else of nodes that share a token of their prefixes
    large = parts.groupBy("c").agg(F.count("v").alias("many")).where(F.col("many") >= GROUP)
    large = parts.join(large, "c").select("v", F.struct("many", "c").alias("part"))
    family = postings.groupBy("v").agg(F.min("token").alias("f"), F.max("n").alias("n")).join(large.hint("shuffle_hash"), "v", "left")
    family = kit.kept(family.select("v", "n", "part", F.coalesce(F.xxhash64("part"), F.col("f")).alias("f")))
    held.append(family)
    pieces = F.ceil(F.greatest(F.count("v") / GROUP, F.sum("n") / TOKENS))
    # of nodes / GROUP rows at most: broadcast while few, so that a large family needn't meet in one task
    many = kit.bounded_broadcast(family.groupBy("f").agg(pieces.alias("pieces")).where("pieces > 1"), BROADCAST_ROWS)
    cut = family.join(many, "f", "left").withColumn("step", F.when(F.col("pieces").isNull(), 0).otherwise(F.floor(F.log("n") * 100)))
    chunks = kit.bounded_broadcast(cut.where("pieces > 1").groupBy("f", "step").agg(pieces.alias("chunks")), BROADCAST_ROWS)
    cut = cut.join(chunks, ["f", "step"], "left")
    member = kit.written(cut.select("v", "n", "part", F.xxhash64("f", "step", F.pmod(F.xxhash64("v"), F.coalesce("chunks", F.lit(1)))).alias("g")), "member")

    # who asks whom (joins are hinted: one plan at every size, rather than broadcasts as long as a side is small)
    posted = postings.select("token", "v", "at").join(member.hint("shuffle_hash"), "v")
    having = posted.groupBy("token", F.col("g").alias("other")).agg(F.count("v").alias("owners"), F.max("part").alias("theirs"), F.min("n").alias("least"), F.max("n").alias("most"))
    largest = having.groupBy("token").agg(F.max("theirs").alias("top"))
    asking = posted.join(largest.hint("shuffle_hash"), "token").where("part IS NULL OR part < top")
    other_part = F.col("theirs").isNotNull() & (F.col("part").isNull() | (F.col("part") < F.col("theirs")))
    later = F.col("part").isNull() & F.col("theirs").isNull() & ((F.col("g") < F.col("other")) | ((F.col("g") == F.col("other")) & (F.col("owners") > 1)))
    takes = common(F.col("n"), F.greatest(F.col("least"), need), percent)
    fits = (F.col("most") * 100 >= F.col("n") * percent) & (F.col("least") * percent <= F.col("n") * 100) & (F.col("at") < F.col("n") - takes + SHARED)
    met = asking.drop("top").join(having.hint("shuffle_hash"), "token").where((other_part | later) & fits)
    met = met.groupBy("v", "g", F.col("other")).agg(F.count("token").alias("known"), F.min(takes).alias("need"), F.max("n").alias("n"))
    asked = met.where(F.col("known") >= F.least(F.lit(SHARED), F.col("need")))
    asked = kit.written(asked.select("v", F.col("other").alias("g"), "n", "need", (F.col("g") == F.col("other")).alias("own")), "asked")

    # the matrix: a row of bits a group that is asked
    bits = kit.kept(_with_bits(sets))
    held.append(bits)
    near = member.join(asked.where("not own").select("g").distinct(), "g", "left_semi").select("g", "v")

    def row_of(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_buffer(), np.uint8) for x in table["bits"]]
        union = np.packbits(folded(rows, min(map(len, rows)) * 8).max(axis=0))
        return pa.table({"g": table["g"][:1], "union": pa.array([union.tobytes()], pa.binary())})

    matrix = near.join(bits, "v").groupBy("g").applyInArrow(row_of, "g long, union binary")
    asks = asked.where("not own").select("v", "g", "need").join(bits, "v").join(matrix, "g")
    qualified = _bounded(asks.select("v", "g", "n", "need", "bits", "union"))
    qualified = kit.written(qualified.unionByName(asked.where("own").select("v", "g", "n")), "qualified")

    # opened groups: pairwise bounds, then sets
    opened = member.join(qualified.select("g").distinct(), "g", "left_semi").select("g", "v")
    visits = kit.kept(_screened(_visits(opened, qualified).join(bits, "v"), percent))
    held.append(visits)
    links = links_at(visits).unionByName(parts.select(F.col("v").alias("a"), F.col("c").alias("b")))
    whole = graph.components(links).select(F.col("node").alias("v"), F.col("root").alias("c"))
    for used in held:
        used.unpersist()

    named = nodes.select("v", "id").join(whole, "v", "left").select("v", "id", F.coalesce("c", "v").alias("c"))
    named = kit.written(named.join(named.groupBy("c").agg(F.min("id").alias("component_id")), "c").select("v", "component_id"), "named")
    out = rows.join(named, "v", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), *[F.col("v").alias("node")] * with_node)


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class, with all columns: that of the least id (of equal rows, and of equal sets under one id, any one).  Rows without words all stay."""
    classes = join(docs, id_col=id_col, text_col=text_col, words=words, percent=percent, with_node=True)
    kept = classes.where((F.col("n_shingles") > 0) & F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(F.col(id_col).alias("__class_id"), F.col("node").alias("__class_v")).agg(F.count("node").alias("__class_n"))
    kept = kit.written(kept, "kept")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(batch.schema.get_field_index(text_col)), words)
            yield batch.append_column("__class_node", pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()))

    rows = docs.mapInArrow(named, StructType([*docs.schema.fields, StructField("__class_node", LongType())]))
    wordless = rows.where(F.col("__class_node").isNull())
    found = rows.join(kept.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("__class_id")) & (F.col("__class_node") == F.col("__class_v")), "left_semi")
    if kept.where(F.col("__class_n") > 1).limit(1).count():
        found = found.dropDuplicates([id_col, "__class_node"])
    return found.unionByName(wordless).select(*docs.columns)
