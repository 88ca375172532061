"""Archives, conversation repair and periodic runs: against brute force, SQL and broken, empty, repeated and clashing input."""

import hashlib
import io
import itertools
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stateforge.llm import conversation, queries, runs, warc
from tests.conftest import DATA

NO_TEXT = hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("name", ["op11_warc", "op12_conversation"])
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name])


# ---------------------------------------------------------------- conversations


def brute(rows):
    """The contract by itself: every string of edits by cost, then by ASCII order, until one gives a legal sequence."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
        seen.add((role, text))

    def kind(letters):
        return {"": 0, "s": 1}.get(letters, 2 if letters[-1] == "u" else 3)

    states = {"": (0, "")}  # by the end of the legal initials so far

    def spread(states):
        """Inserts, as many as help."""
        changed = True
        while changed:
            changed = False
            for letters, (cost, audit) in list(states.items()):
                new = letters + "u" if letters in ("", "s") or letters[-1] == "a" else letters + "a"
                new = {2: "u", 3: "ua"}[kind(new)]
                if new not in states or (cost + 3, audit + "I") < states[new]:
                    states[new] = (cost + 3, audit + "I")
                    changed = True
        return states

    states = spread(states)
    for (_, role, _text), fault in zip(rows, faults, strict=True):
        after = {}

        def offer(letters, cost, audit):
            if letters not in after or (cost, audit) < after[letters]:
                after[letters] = (cost, audit)

        for letters, (cost, audit) in states.items():
            offer(letters, cost + 4, audit + "D")
            if fault in (1, 2):
                continue
            extra = 3 if fault == 3 else 0
            wanted = "u" if letters in ("", "s") or letters[-1] == "a" else "a"
            if role[:1] == "s" and letters == "":
                offer("s", cost + extra, audit + "K")
            new = "u" if wanted == "u" else "ua"
            offer(new, cost + extra + (0 if role[:1] == wanted else 3), audit + ("K" if role[:1] == wanted else "R"))
        states = spread(after)
    cost, audit = min(states[k] for k in states if k in ("", "ua"))
    # apply the audit
    out, i, letters = [], 0, ""
    for e in audit:
        wanted = "u" if letters in ("", "s") or letters[-1:] == "a" else "a"
        name = {"u": "user", "a": "assistant"}[wanted]
        if e == "I":
            out.append((name, ""))
            letters += wanted
            continue
        _, role, text = rows[i]
        i += 1
        if e == "K":
            out.append((role, text))
            letters += role[0]
        elif e == "R":
            out.append((name, text))
            letters += wanted
    assert re.fullmatch("(s?(ua)+)?", letters) and i == len(rows)
    known = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def least_of_all(rows):
    """The cheapest audit by trying every edit of every row with up to two inserts between (few rows only)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("drop" if not bare or (role, text) in seen else "cut" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    choices = [[("D", "", 4)] if f == "drop" else [("D", "", 4), ("K", r[1][:1] or "?", 3 * (f == "cut")), ("R", "u", 3 + 3 * (f == "cut")), ("R", "a", 3 + 3 * (f == "cut"))] for r, f in zip(rows, faults, strict=True)]
    inserts = [((), "")] + [(x, "I" * len(x)) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    for edits in itertools.product(*choices):
        for between in itertools.product(inserts, repeat=len(rows) + 1):
            letters = "".join("".join(b[0]) + e[1] for b, e in zip(between, edits, strict=False)) + "".join(between[-1][0])
            if re.fullmatch("(s?(ua)+)?", letters):
                audit = "".join(b[1] + e[0] for b, e in zip(between, edits, strict=False)) + between[-1][1]
                found = sum(e[2] for e in edits) + 3 * audit.count("I"), audit
                best = found if best is None else min(best, found)
    return best


def some_turns(rng, n):
    texts = ["Fine.", "Fine.", "Cut off", "", " \n", "What? ", "Ends in ", "Ja!\t\n", "é。"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", " ", "user2", "Ünknown"]
    return [(rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts) + rng.choice(["", "", str(rng.randint(0, 3)) + "."])) for _ in range(n)]


def test_brute_force_agrees_with_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        rows = some_turns(rng, rng.randint(0, 2))
        got = brute(rows)
        assert (got[5], got[6]) == least_of_all(rows)


SCHEMA = "conv_id long, turn long, role string, text string, fault int, _rows string, block int, lost boolean"


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(8)
    return {c: some_turns(rng, rng.choice([0, 1, 2, 3, 5, 8, 13, 40])) for c in [None, *range(120)]}


@pytest.mark.parametrize("size", [1024, 4, 1])
def test_repair(spark, turns, size):
    data = [(c, t, r, x, 1, "x", 2, False) for c, rows in turns.items() for t, r, x in rows]
    data += [(c, 3, "user", "Gone.", 1, "x", 2, True) for c, rows in turns.items() if not rows or (c or 0) % 7 == 0]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in conversation.repair(df, size=size).collect()}
    assert got == {c: brute(rows) for c, rows in turns.items() if rows or any(d[0] == c for d in data)}
    left = conversation.repaired_turns(df, size=size).collect()
    by = {}
    for r in sorted(left, key=lambda r: (r.block, r.place)):
        by.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in by.items()} == {c: row[-1] for c, row in got.items() if row[-1] != NO_TEXT}


def test_damage_and_nulls(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2, 3) for t in [None, *range(30)] for r, x in [("user", "A. b"), (None, None)]]
    got = sorted(map(str, conversation.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        row = Row(conv_id=c, turn=t, role="user" if kind == 4 else r, text="" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x, lost=kind == 0)
        want += [str(row)] * (2 if kind == 3 else 1)
    assert got == sorted(want)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation.repair(conversation.damaged(none)).count() == 0
    nulls = conversation.repair(spark.createDataFrame([(None, None, None, None)] * 3, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in nulls] == [(None, 0, 3, 0, 0, 2, 12, "DDD", NO_TEXT)]


def test_one_long_conversation_of_equal_turns(spark):
    df = spark.range(5000).select(F.lit(1).alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    (row,) = conversation.repair(df, size=64).collect()
    assert (row.duplicate, row.cost, row.audit) == (4999, 4999 * 4 + 3, "K" + "D" * 4999 + "I")


# ---------------------------------------------------------------- runs


def all_runs(w):
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p) and not any(all(w[k] == w[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng, n, letters):
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 5:
            a, p = rng.randrange(n), rng.randint(1, 20)
            for i in range(a + p, rng.randint(a, n)):
                w[i] = w[i - p]
    return w


def test_runs_are_all_found():
    rng = random.Random(2)
    for _ in range(1500):
        w = periodic(rng, rng.randint(12, 110), rng.choice([1, 2, 2, 3, 6, 30]))
        assert runs.runs(np.array(w, np.int64)) == all_runs(w)


def test_runs_in_pieces_of_the_grid(monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 40)
    rng = random.Random(4)
    for _ in range(200):
        w = periodic(rng, rng.randint(12, 150), rng.choice([1, 2, 3, 30]))
        assert runs.runs(np.array(w, np.int64)) == all_runs(w)


def described(doc_id, text):
    """A row of the contract, plainly."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_detect(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "a b " * 400, " a\x85 b\x1cc " * 9, "x" * 100_000, "né è " * 30 + "tail"]
    texts += [" ".join(f"w{k}" for k in periodic(rng, rng.randint(1, 160), rng.choice([1, 2, 5, 40]))) for _ in range(150)]
    rows = [(i, t, 1, 2, "x", 3) for i, t in enumerate(texts)] + [(7, texts[6], 1, 2, "x", 3)] * 2 + [(None, texts[6], 1, 2, "x", 3), (None, None, 1, 2, "x", 3)]
    schema = "doc_id long, text string, _id int, start int, runs string, n_runs int"
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = sorted(map(repr, map(tuple, runs.detect(df, damage=True).drop("runs", "collapsed").collect())))
    assert got == sorted(repr((i, *described(i, t))) for i, t, *_ in rows)
    plain = {r.doc_id: r for r in runs.detect(df).collect() if r.doc_id is not None}
    assert plain[6].collapsed == "a b" and [tuple(x) for x in plain[6].runs] == [(0, 800, 2)]
    assert runs.detect(spark.createDataFrame([], schema)).count() == 0


def test_long_texts_stay_quick():
    rng = random.Random(1)
    assert runs.runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert len(runs.runs(np.arange(120_000) // 12)) == 10_000
    assert runs.runs(np.array([rng.randrange(60) for _ in range(200_000)])) == []


def test_documents_by_definition(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where(F.length("text") < 1500)
    want = sorted(repr((r.doc_id, *described(r.doc_id, r.text))) for r in docs.collect())
    assert sorted(repr(tuple(r)) for r in runs.detect(docs, damage=True).drop("runs", "collapsed").collect()) == want


# ---------------------------------------------------------------- archives

PAGES = "page_id long, url string, html string, id long, digest string, size int, n int"


def pages(spark):
    long, other = "<p>" + "é" * 80, "<p>" + "x" * 200
    rows = [(1, "http://b.org/1", long), (2, "http://a.org/x y", long), (None, "http://a.org/", long), (3, None, ""), (4, "u", None), (5, "u", "short"), (6, "u", "short")]
    rows += [(9, "b", other), (9, "a", other), (9, None, other), (9, "a", other), (12, "z", other)] + [(None, "q", "y" * 150)] * 3 + [(7, "h\r\nX: y", "a\r\n\r\nb" * 50), (8, "u v", "z" * 99), (10, "u", "z" * 100), (11, "u", "z" * 100)]
    rows += [(100 + i, f"http://h{i % 3}.net/{i}", "w " * (i * 40)) for i in range(60)]
    return rows, spark.createDataFrame([(*r, 1, "d", 2, 3) for r in rows], PAGES).repartition(4)


def expected(rows):
    out = []
    by = {}
    for i, url, html in rows:
        by.setdefault(html or "", []).append((i is None, i or 0, url is not None, url or "", i))
    for html, found in by.items():
        data = html.encode()
        for k, x in enumerate(sorted(found)):
            again = k > 0 and len(data) >= 100
            out.append((x[4], len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", sorted(found)[0][4] if again else None))
    return sorted(out, key=repr)


def test_archives_round_trip(spark):
    rows, df = pages(spark)
    assert sorted(map(tuple, warc.packed(df).collect()), key=repr) == expected(rows)
    assert warc.packed(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_archives_are_zip_files(spark, tmp_path, monkeypatch, wide):
    monkeypatch.setattr(warc, "MEMBER", 400)
    monkeypatch.setattr(warc, "ARCHIVE", 5000)
    rows, df = pages(spark)
    found = warc.write_archives(df, f"file://{tmp_path}/a", wide=wide)
    files = [r.archive.removeprefix("file://") for r in found.collect()]
    assert found.agg(F.sum("records")).head()[0] == len(rows)
    payloads = [r.payload for r in warc.records(warc.entries(found), with_payload=True).collect()]
    assert len(payloads) == len(rows)
    assert sorted({p.decode() for p in payloads if p}) == sorted({r[2] for r in rows if r[2]})
    for name in files:
        with zipfile.ZipFile(name) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        with open(name, "rb") as f:
            size = f.seek(0, 2)
            assert [m.name for m in warc.directory(f, size)] == zipfile.ZipFile(name).namelist()
            for m in warc.directory(f, size):
                warc.located(f, m)
                assert warc.read_at(f, m.start, m.size) == zipfile.ZipFile(name).read(m.name)
    assert warc.entries(warc.archived(spark, [f"file://{n}" for n in files])).count() == len(rows)


def test_foreign_archives_and_broken_ones():
    """Archives of the standard library's writer, with comments, prefixes of members and compressed members."""
    made = io.BytesIO()
    record = warc.record(5, "http://a", hashlib.sha256(b"hi").hexdigest(), 2, b"hi")
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("archive/one.warc", record)
        z.writestr("indexes/index.cdx", warc.cdxj("http://a", 0, len(record), "one.warc", "d"))
        z.writestr("pages/pages.jsonl", "{}", zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 not the end"
    data = made.getvalue()
    ((at, n, _),) = warc.indexed(io.BytesIO(data), len(data))
    assert warc.parsed(data[at : at + n])[2] == b"hi"
    for bad in (b"", b"PK", data[:-40], data.replace(b"PK\x01\x02", b"PK\x01\x03", 1), data.replace(b"one.warc\"", b"two.warc\"")):
        with pytest.raises(warc.Broken):
            list(warc.indexed(io.BytesIO(bad), len(bad)))
    packed = next(m for m in warc.directory(io.BytesIO(data), len(data)) if m.name.startswith("pages"))
    with pytest.raises(warc.Broken, match="byte ranges"):
        warc.located(io.BytesIO(data), packed)
    with pytest.raises(warc.Broken):
        warc.parsed(b"not a record")
