"""The thin queries of this package, by name: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stateforge.llm import bpe, conversation, jaccard, media, mixing, pll, quality, runs, secrets, substring, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("shard")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, 5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents")).drop("found")


def op5_pll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pll.score(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored(table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.packed(table(spark, sf_dir, "pages"))


def op12_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair(conversation.damaged(table(spark, sf_dir, "conversations")))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.detect(table(spark, sf_dir, "documents"), damage=True).drop("runs", "collapsed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_topk, op3_quality, op4_secrets, op5_pll, op6_bpe, op7_jaccard, op8_toxicity, op9_media, op10_substring, op11_warc, op12_conversation, op13_periodic)}

def _repair_sql() -> str:
    """The repair as a recursion over rows: a state is its cost, in 12 digits, and its audit, so that the least string is the cheapest."""
    put = lambda s, letter, cost: f"lpad(CAST(CAST(left({s}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({s}, 13) || {letter}"
    moved = lambda s, wanted: f"CASE WHEN fault IN (0, 3) THEN {put(s, f"CASE WHEN initial = '{wanted}' THEN 'K' ELSE 'R' END", f"CASE WHEN fault = 3 THEN 3 ELSE 0 END + CASE WHEN initial = '{wanted}' THEN 0 ELSE 3 END")} END"
    kept = f"CASE WHEN fault IN (0, 3) AND initial = 's' THEN {put('s0', "'K'", 'CASE WHEN fault = 3 THEN 3 ELSE 0 END')} END"
    gone = lambda s: put(s, "'D'", 4)
    name = lambda k: f"CASE WHEN (e.b + {k} + e.odd) % 2 = 0 THEN 'user' ELSE 'assistant' END"
    return f"""
WITH RECURSIVE key AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(generate_series(1, len(k)), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), generate_series(1, 8)), lambda x, j: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind FROM key),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(generate_series(1, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
f AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial, CASE WHEN bare = '' THEN 1 WHEN again THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM seen),
nb AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n, list(struct_pack(r := role, t := text) ORDER BY i) AS turns FROM nb GROUP BY conv_id),
c AS (SELECT o.conv_id, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON o.conv_id IS NOT DISTINCT FROM n.conv_id),
w(conv_id, n, i, s0, s1, s2, s3) AS (
  SELECT conv_id, n, 0, repeat('0', 12), '100000000000', repeat('0', 11) || '3I', repeat('0', 11) || '6II' FROM c
  UNION ALL
  SELECT conv_id, n, i, r0, r1, c2, least(r3, {put("c2", "'I'", 3)}) FROM (
    SELECT *, least(r2, {put("least(r0, r1, r3)", "'I'", 3)}) AS c2 FROM (
      SELECT w.conv_id, w.n, f.i, {gone("s0")} AS r0, least({gone("s1")}, {kept}) AS r1, least({gone("s2")}, {moved("least(s0, s1, s3)", "u")}) AS r2, least({gone("s3")}, {moved("s2", "a")}) AS r3
      FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1))),
best AS (SELECT conv_id, CAST(left(least(s0, s3), 12) AS BIGINT) AS cost, substr(least(s0, s3), 13) AS audit FROM w WHERE i = n),
tok AS (SELECT conv_id, len(replace(audit, 'D', '')) % 2 AS odd, regexp_extract_all(audit, 'I*[DKR]|I+$') AS toks FROM best),
e AS (SELECT conv_id, odd, i, toks[i] AS tok, len(replace(toks[i], 'D', '')) - CASE WHEN right(toks[i], 1) IN ('K', 'R') THEN 1 ELSE 0 END AS ins, coalesce(CAST(list_sum(list_transform(toks[1:i - 1], lambda t: len(replace(t, 'D', '')))) AS BIGINT), 0) AS b FROM (SELECT *, unnest(generate_series(1, len(toks))) AS i FROM tok)),
line AS (SELECT e.conv_id, e.i, list_concat(CASE WHEN e.ins > 0 THEN [{name("0")} || ':'] ELSE [] END, CASE WHEN e.ins > 1 THEN [{name("1")} || ':'] ELSE [] END, CASE right(e.tok, 1) WHEN 'K' THEN [n.turns[e.i].r || ':' || n.turns[e.i].t] WHEN 'R' THEN [{name("e.ins")} || ':' || n.turns[e.i].t] ELSE [] END) AS lines FROM e JOIN n ON e.conv_id IS NOT DISTINCT FROM n.conv_id),
text AS (SELECT conv_id, sha256(array_to_string(flatten(list(lines ORDER BY i)), chr(10))) AS repaired_sha256 FROM line GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM best LEFT JOIN n ON best.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN text ON best.conv_id IS NOT DISTINCT FROM text.conv_id"""


#: DuckDB equivalents.  The other queries have none: learnt models (3, 5, 8), a compressor (4), merges (6), container bytes (9), seeded draws (1) and hash-cut sentences (10) are held against brute force in the tests.
ORACLE_SQL: dict[str, str] = {
    "op2_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS z FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(CAST(list_sum(list_transform(generate_series(1, least(len(q.z), len(c.z))), lambda i: q.z[i] * c.z[i])) AS BIGINT), 0) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5""",
    "op7_jaccard": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda t: t <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (n + m - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, component_id FROM s JOIN c USING (doc_id)""",
    "op11_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
r AS (SELECT page_id, n, sha256(html) AS d, row_number() OVER w AS k, first_value(page_id) OVER w AS f FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS FIRST))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND k > 1 THEN f END AS refers_to FROM r""",
    "op12_conversation": _repair_sql(),
}
