"""Conversation structure repair: faults by windows, edits by a fold of native higher-order functions.

Rows of a conversation stand by turn (nulls first, then by role and text).  The
first fault of a row counts: blank (white space only), duplicate (role and text
seen earlier in the conversation), truncated (the last character that isn't
white is none of . ! ?).  The cheapest edits make the initials of the roles read
`(s?(ua)+)?`: keep (0), rerole to user or assistant (3), delete (4, the only
edit of blanks and duplicates), insert an empty user or assistant turn (3); an
undeleted truncated row adds 3.  Of equally cheap edits the ASCII-least string
of D, I, K, R wins.

The fold carries the cheapest (cost, audit) of the four states that a prefix
can end in (nothing yet, after s, u, a).  Two audits of one state and row differ
in inserts alone, so of equal costs neither is the start of the other, and the
least stays the least whatever follows.  What an audit says of a row depends on
the number of letters other than D before it alone: it is odd at the end just
if a system turn comes first, and user and assistant alternate otherwise.

A conversation of at most `ROWS` rows and `BYTES` bytes is one array of turns.
Of a longer one, however large, rows are numbered in value ranges, blocks of
`ROWS` rows (without texts) are folded from each of the four states, a fold over
the blocks joins these, and texts meet their edits by number; only its SHA-256,
which is sequential by definition, is fed line by line in one task.  Results are
the same either way.

Defined results: a null role or text is one space; a null turn comes first and
counts for no gap; a null id is a conversation of its own; an empty role has no
initial and fits nowhere; equal rows are duplicates of the first; a conversation without (present) rows has zeros, an empty audit
and the hash of the empty text; an empty table gives no rows; columns beside
the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stateforge.llm import kit
from stateforge.operators import prepare

#: Rows and bytes of a conversation that is folded as one array, and rows of a block of longer ones.
ROWS, BYTES = 1024, 8 << 20
#: Long conversations up to which their ids are broadcast.
FEW = 100_000
WHITE = " \t\n\v\f\r"
#: More than any edits cost.
FAR = 1 << 48
#: What each edit costs, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
STATE = "struct<cost: bigint, audit: string>"
FOUR = f"struct<s0: {STATE}, s1: {STATE}, s2: {STATE}, s3: {STATE}>"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost) of a table of conversations, damaged by crc32 of `conv_id:turn` modulo 20.

    0 loses the row (it stays, marked), 1 empties its text, 2 takes its . ! ? out,
    3 repeats it, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    out = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), (kind == 0).alias("lost"), kind.alias("_kind"))
    return out.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


# ---------------------------------------------------------------- expressions


def bound(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def put(state: Column, letter: Column | str, cost: Column | int) -> Column:
    """A state after one more edit."""
    letter, cost = (F.lit(x) if isinstance(x, str | int) else x for x in (letter, cost))
    return F.struct((state["cost"] + cost.cast("bigint")).alias("cost"), F.concat(state["audit"], letter).alias("audit"))


def settled(r: Column) -> Column:
    """Four states with what inserts reach: more than two at one place only come back to a state."""
    user = F.least(r["s2"], put(F.least(r["s0"], r["s1"], r["s3"]), "I", INSERT))
    return bound(user, lambda u: F.struct(r["s0"].alias("s0"), r["s1"].alias("s1"), u.alias("s2"), F.least(r["s3"], put(u, "I", INSERT)).alias("s3")))


def step(four: Column, row: Column) -> Column:
    """The states after one row more: (initial, drop: it must go, cut: it is truncated)."""
    stays, adds = ~row["drop"], F.when(row["cut"], CUT).otherwise(0)

    def moved(state: Column, wanted: str) -> Column:
        same = row["initial"] == wanted
        return F.when(stays, put(state, F.when(same, "K").otherwise("R"), adds + F.when(same, 0).otherwise(REROLE)))

    gone = lambda s: put(four[s], "D", DELETE)
    after = F.struct(
        gone("s0").alias("s0"),
        F.least(gone("s1"), F.when(stays & (row["initial"] == "s"), put(four["s0"], "K", adds))).alias("s1"),
        F.least(gone("s2"), moved(F.least(four["s0"], four["s1"], four["s3"]), "u")).alias("s2"),
        F.least(gone("s3"), moved(four["s2"], "a")).alias("s3"),
    )
    return bound(after, settled)


def states(*known: tuple[int, str] | None) -> Column:
    """Four states as literals; None can't be reached."""
    return F.struct(*(F.struct(F.lit(FAR if k is None else k[0]).cast("bigint").alias("cost"), F.lit("" if k is None else k[1]).alias("audit")).alias(f"s{i}") for i, k in enumerate(known))).cast(FOUR)


#: Where a conversation starts.
START = ((0, ""), None, (INSERT, "I"), (2 * INSERT, "II"))


def folded(rows: Column, start: Column) -> Column:
    return F.aggregate(rows, start, lambda four, row: step(four, row).cast(FOUR))


def edits(audit: Column, before: Column) -> Column:
    """An array with, for every row, the inserts before it, its own letter, and the letters other than D before both; inserts at the end come last, without a letter."""
    tokens = F.regexp_extract_all(audit, F.lit("I*[DKR]|I+\\z"), F.lit(0))
    kind = "array<struct<inserts: int, letter: string, before: int>>"
    none = F.struct(F.array().cast(kind).alias("done"), before.cast("int").alias("n"))

    def one(acc: Column, token: Column) -> Column:
        inserts = F.length(token) - F.length(F.ltrim(token, F.lit("I")))
        letter = F.ltrim(token, F.lit("I"))
        entry = F.struct(inserts.alias("inserts"), letter.alias("letter"), acc["n"].alias("before"))
        return F.struct(F.concat(acc["done"], F.array(entry)).cast(kind).alias("done"), (acc["n"] + inserts + letter.isin("K", "R").cast("int")).alias("n"))

    return F.aggregate(tokens, none, one, lambda acc: acc["done"])


def kept_letters(audit: Column) -> Column:
    return F.length(F.translate(audit, "D", ""))


def turned(edit: Column, odd: Column, role: Column, text: Column) -> Column:
    """The turns (role, text) that an edit leaves: its inserts, then the row if it stays."""
    name = lambda k: F.when((edit["before"] + k + odd) % 2 == 0, "user").otherwise("assistant")
    turn = lambda r, t: F.struct(r.alias("role"), t.alias("text"))
    new = F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda k: k < edit["inserts"]), lambda k: turn(name(k), F.lit("")))
    own = F.when(edit["letter"] == "K", F.array(turn(role, text))).when(edit["letter"] == "R", F.array(turn(name(edit["inserts"]), text))).otherwise(F.array().cast("array<struct<role: string, text: string>>"))
    return F.concat(new, own)


def line(turn: Column) -> Column:
    return F.concat(turn["role"], F.lit(":"), turn["text"])


def faulty(rows: DataFrame, again: Column) -> DataFrame:
    """Rows with their first fault (0 none, 1 blank, 2 duplicate, 3 truncated) and their role's initial."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(bare == "", 1).when(again, 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return rows.withColumn("fault", fault).withColumn("initial", F.left("role", F.lit(1)))


def short(row: Column) -> Column:
    """What the fold needs of a row."""
    return F.struct(row["initial"].alias("initial"), row["fault"].isin(1, 2).alias("drop"), (row["fault"] == 3).alias("cut"))


def illegal(initials: Column) -> Column:
    """Neighbours in a string of initials (a letter a row) other than su, ua and au."""
    return F.greatest(F.length(initials) - 1, F.lit(0)) - F.regexp_count(initials, F.lit("s(?=u)|u(?=a)|a(?=u)"))


def letter(initial: Column) -> Column:
    return F.when(initial.isin("s", "u", "a"), initial).otherwise("?")


# ---------------------------------------------------------------- conversations


def _rows(turns: DataFrame) -> DataFrame:
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lost = F.coalesce("lost", F.lit(False)) if "lost" in turns.columns else F.lit(False)
    return turns.select("conv_id", "turn", own("role").alias("role"), own("text").alias("text"), (~lost).alias("there"))


def _short(rows: DataFrame) -> DataFrame:
    """A row for each conversation, as one array of its turns: audit, counts, and what is left of the turns.

    Conversations are dealt out once, for the window and the array alike.
    """
    seen = W.partitionBy("conv_id", "role", "text").orderBy(F.col("there").desc(), F.col("turn").asc_nulls_first())
    marked = faulty(rows.repartition("conv_id"), F.row_number().over(seen) > 1)
    turn = F.struct("turn", "role", "text", "fault", "initial")
    out = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("there"), turn))).alias("_rows"))
    at = F.col("_rows")
    out = out.withColumn("_four", folded(F.transform(at, short), states(*START)))
    best = F.least(F.col("_four.s0"), F.col("_four.s3"))
    out = out.select("conv_id", "_rows", best["cost"].alias("cost"), best["audit"].alias("audit")).withColumn("_edits", edits(F.col("audit"), F.lit(0)))
    known = F.filter(F.transform(at, lambda r: r["turn"]), lambda t: t.isNotNull())
    count = lambda k: F.size(F.filter(at, lambda r: r["fault"] == k)).cast("long")
    left = F.flatten(F.zip_with("_edits", at, lambda e, r: turned(e, kept_letters(F.col("audit")) % 2, r["role"], r["text"])))
    return out.select(
        "conv_id",
        F.when(F.size(known) > 0, F.array_max(known) - F.array_min(known) + 1 - F.size(F.array_distinct(known))).otherwise(0).cast("long").alias("gaps"),
        count(1).alias("blank"),
        count(2).alias("duplicate"),
        count(3).alias("truncated"),
        illegal(F.array_join(F.transform(at, lambda r: letter(r["initial"])), "")).cast("long").alias("illegal"),
        "cost",
        "audit",
        left.alias("repaired"),
    )


def _long(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The same for conversations of any length: a row for each without its turns, and (conv_id, block, place, turns) of the repaired ones in order.

    Equal rows are combined before they are shuffled; all but the first are duplicates.
    """
    rows = rows.where("there").groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("_n"))
    first = rows.groupBy(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "text"))).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text"))
    rows = rows.join(first, same).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    rows = faulty(rows, (F.col("_k") > 1) | ~F.col("turn").eqNullSafe(F.col("_first.turn"))).select("conv_id", "turn", "role", "text", "_k", "fault", "initial")
    start = F.left("text", F.lit(64))
    rows = prepare.ranked(rows, [F.col("conv_id"), F.col("turn"), F.col("role"), start, F.col("_k")], "_at", within=[F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"), F.col("_k")])
    rows = kit.written(rows.withColumn("block", F.floor(F.col("_at") / size)), "turns", compact=False)
    blocks = rows.groupBy("conv_id", "block").agg(F.min("_at").alias("_from"), F.sort_array(F.collect_list(F.struct("_at", "fault", "initial"))).alias("_rows"))
    small = F.transform("_rows", short)
    basis = [states(*((0, "") if i == k else None for i in range(4))) for k in range(4)]
    blocks = blocks.select("conv_id", "block", "_from", F.array(*(folded(small, b) for b in basis)).alias("_to"), F.array_join(F.transform("_rows", lambda r: letter(r["initial"])), "").alias("_letters"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "_from", "_to", "_letters"))).alias("_blocks"))
    path = "struct<cost: bigint, audit: string, path: array<int>>"
    carried = "struct<" + ", ".join(f"s{i}: {path}" for i in range(4)) + ">"

    def joined(acc: Column, block: Column) -> Column:
        def to(t: int) -> Column:
            return F.least(*(F.struct((acc[f"s{s}"]["cost"] + block["_to"][s][f"s{t}"]["cost"]).alias("cost"), F.concat(acc[f"s{s}"]["audit"], block["_to"][s][f"s{t}"]["audit"]).alias("audit"), F.concat(acc[f"s{s}"]["path"], F.array(F.lit(s))).alias("path")) for s in range(4)))

        return F.struct(*(to(t).alias(f"s{t}") for t in range(4))).cast(carried)

    begin = F.struct(*(F.struct(F.lit(FAR if k is None else k[0]).cast("bigint").alias("cost"), F.lit("" if k is None else k[1]).alias("audit"), F.array().cast("array<int>").alias("path")).alias(f"s{i}") for i, k in enumerate(START))).cast(carried)
    whole = whole.withColumn("_four", F.aggregate("_blocks", begin, joined))
    end0, end3 = (F.struct(F.col(f"_four.s{k}.cost").alias("cost"), F.col(f"_four.s{k}.audit").alias("audit"), F.concat(F.col(f"_four.s{k}.path"), F.array(F.lit(k))).alias("path")) for k in (0, 3))
    whole = whole.withColumn("_best", F.least(end0, end3)).withColumn("audit", F.col("_best.audit"))
    letters = F.array_join(F.transform("_blocks", lambda b: b["_letters"]), "")
    whole = kit.written(whole.select("conv_id", F.col("_best.cost").alias("cost"), "audit", illegal(letters).cast("long").alias("illegal"), F.col("_best.path").alias("_path"), "_blocks"), "audits", compact=False)
    lead = F.element_at("_path", 1)  # inserts before all rows belong to the state that the first block starts in
    pieces = whole.select("conv_id", (kept_letters(F.col("audit")) % 2).alias("_odd"), lead.alias("_lead"), F.posexplode("_blocks").alias("_i", "_b"), "_path").select(
        "conv_id", "_odd", "_i", F.col("_b.block").alias("block"), F.col("_b._from").alias("_from"),
        F.concat(F.when(F.col("_i") == 0, F.when(F.col("_lead") == 2, "I").when(F.col("_lead") == 3, "II").otherwise("")).otherwise(""), _of_state(F.col("_b._to")[F.col("_path")[F.col("_i")]], F.col("_path")[F.col("_i") + 1])["audit"]).alias("_piece"),
    )
    ahead = W.partitionBy("conv_id").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum(kept_letters(F.col("_piece"))).over(ahead), F.lit(0)))
    placed = pieces.select("conv_id", "block", "_odd", "_from", F.posexplode(edits(F.col("_piece"), F.col("_before"))).alias("place", "_edit")).withColumn("_key", F.when(F.col("_edit.letter") != "", F.col("_from") + F.col("place")))
    met = placed.join(rows.select("_at", "role", "text"), F.col("_key") == F.col("_at"), "left")
    left = met.select("conv_id", "block", "place", turned(F.col("_edit"), F.col("_odd"), F.col("role"), F.col("text")).alias("turns")).where(F.size("turns") > 0)
    counted = rows.groupBy("conv_id").agg(*(F.count_if(F.col("fault") == k).alias(name) for k, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))))
    spread = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    out = whole.select("conv_id", "cost", "audit", "illegal")
    for other in (counted, spread):
        out = out.join(other.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    return out, left


def _of_state(four: Column, k: Column) -> Column:
    return F.when(k == 0, four["s0"]).when(k == 1, four["s1"]).when(k == 2, four["s2"]).otherwise(four["s3"])


def _digests(left: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of turns in order, fed to the hash one after another."""
    kind = left.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, digest = (), None
        for batch in batches:
            for conv, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if digest is None or conv != known:
                    if digest is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([known.as_py()], batch.column(0).type), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])
                    known, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(text.encode())
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([known.as_py()], known.type), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    lines = left.select("conv_id", "block", "place", F.array_join(F.transform("turns", line), "\n").alias("_text"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place").select("conv_id", "_text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def _parts(turns: DataFrame, size: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of short conversations, and those of long ones if there are any."""
    rows = _rows(turns)
    long = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).where((F.col("n") > size) | (F.col("b") > most)).select("_c")
    long = kit.written(long, "long")
    if not long.limit(1).count():
        return rows, None
    long, same = kit.bounded_broadcast(long, FEW), F.col("conv_id").eqNullSafe(F.col("_c"))
    return rows.join(long, same, "left_anti"), rows.join(long, same, "left_semi")


def repair(turns: DataFrame, *, size: int = ROWS, most: int = BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Rows whose `lost` (if there is such a column) is true are no longer there, but their conversation is.
    """
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    few, many = _parts(turns, size, most)
    out = _short(few).withColumn("repaired_sha256", F.sha2(F.array_join(F.transform("repaired", line), "\n"), 256)).select("conv_id", *names)
    if many is None:
        return out
    whole, left = _long(many, size)
    digests = _digests(left).withColumnRenamed("conv_id", "_c")
    long = whole.join(digests, F.col("conv_id").eqNullSafe(F.col("_c")), "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
    gone = many.select("conv_id").distinct().join(whole.select(F.col("conv_id").alias("_c")), F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
    zeros = {n: F.lit("") if n == "audit" else F.sha2(F.lit(""), 256) if n == "repaired_sha256" else F.lit(0).cast("long") for n in names}
    return out.unionByName(long.select("conv_id", *names)).unionByName(gone.select("conv_id", *(c.alias(n) for n, c in zeros.items())))


def repaired_turns(turns: DataFrame, *, size: int = ROWS, most: int = BYTES) -> DataFrame:
    """(conv_id, block, place, role, text) of what repair leaves, in the order of (block, place)."""
    few, many = _parts(turns, size, most)
    out = _short(few).select("conv_id", F.lit(0).cast("long").alias("block"), F.posexplode("repaired").alias("place", "_turn"))
    if many is not None:
        left = _long(many, size)[1]
        out = out.unionByName(left.select("conv_id", "block", F.posexplode("turns").alias("_j", "_turn"), F.col("place").alias("_p")).select("conv_id", "block", (F.col("_p") * 4 + F.col("_j")).cast("int").alias("place"), "_turn"))
    return out.select("conv_id", "block", "place", "_turn.role", "_turn.text")
