"""One query for each operator, over whole tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"), words=3, radius=2).withColumnRenamed("id", "doc_id")


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), 8).withColumnRenamed("id", "doc_id")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import overlaps

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = overlaps(docs, table(spark, sf_dir, "benchmark"))
    words, spans, items = marked.columns[-3:]
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return marked.select(
        "doc_id", F.col(words).alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size(items) >= 2).alias("contaminated"),
    )


OP2_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) AS v FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT k, doc_id, CAST(octet_length(encode(d.t)) + 1 AS BIGINT) AS size, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(d.t)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda a, b: xor(a // 256, tab.t[1 + xor(a % 256, b)]), 4294967295)) AS text_crc32
    FROM d, tab),
j AS (SELECT k, n, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT AS key,
    0::BIGINT AS b, 0::BIGINT AS j FROM d, (SELECT unnest([8, 9]) AS n)
  UNION ALL SELECT k, n, nk, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / ((nk // 8589934592)::DOUBLE + 1.0))) AS BIGINT)
    FROM (SELECT *, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nk
    FROM j WHERE j < n)),
s AS (SELECT k, max(b) FILTER (n = 8) AS shard, max(b) FILTER (n = 9) AS grown_shard FROM j GROUP BY k)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY ((coalesce(doc_id, text_crc32) % 2147483648) * 2654435761) % 4294967296,
    doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard
    FROM c JOIN s USING (k)
"""


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark),
bl AS (SELECT item_id, ws, least(8, len(ws)) AS k FROM b WHERE len(ws) > 0),
bp AS (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM bl),
win AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, k, array_to_string(ws[p:p + k - 1], ' ') AS gram FROM bp),
dp AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM w, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k),
hits AS (SELECT dp.doc_id, dp.p, dp.k, win.item FROM dp JOIN win ON win.k = dp.k AND win.gram = array_to_string(dp.ws[dp.p:dp.p + dp.k - 1], ' ')),
hw AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item) AS n, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS d FROM hits GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(hi.n, 0) AS n_items,
    coalesce(hi.d, sha256('')) AS items_sha256, coalesce(hi.n, 0) >= 2 AS contaminated
FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import shared_path
    from .tokencount import count_tokens, read_vocabulary, write_tokens

    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, read_vocabulary(TOKENIZER), END_OF_DOCUMENT)
    return count_tokens(spark, path, END_OF_DOCUMENT)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import shared_path
    from .warc import assemble, read_warc, write_warc

    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path, revisit_bytes=0)
    whole = assemble(read_warc(spark, path, payloads=False))
    field = lambda k: F.try_element_at("metadata.fields", F.lit(k)).cast("long")
    return whole.select(
        field("page-id").alias("page_id"), F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"), field("refers-to-page").alias("refers_to"),
    )


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
bits AS (SELECT page_id, n, d, array_to_string(list_transform(range(1, 41), lambda i: right('000' || bin(strpos('0123456789abcdef', d[i]) - 1), 4)), '') AS s
    FROM h),
b32 AS (SELECT page_id, n, d, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(1, 6), lambda j: CAST(s[5 * i + j] AS INT) * (1 << (5 - j)))) AS INT), 1)), '') AS digest
    FROM bits),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM b32)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM m
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "quality_evidence", "host_posterior", "path_posterior", "quality_score", (F.col("quality_score") >= 0.5).alias("kept"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    net = fit_toxicity(docs, table(spark, sf_dir, "labels"), usable=~held)
    return docs.select("doc_id", held.alias("held_out"), toxicity(docs, net).alias("score")).select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    rows = mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3).rows
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + s % 3] AS weight, 3 * size AS cap, CAST(3 * size AS DOUBLE) / [5, 2, 1][1 + s % 3] AS stop FROM s),
u AS (SELECT *, CAST(sum(size) OVER () - coalesce(sum(cap) OVER (ORDER BY stop, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(weight) OVER (ORDER BY stop, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS unit
    FROM w),
one AS (SELECT unit FROM u WHERE unit <= stop ORDER BY stop, s LIMIT 1),
t AS (SELECT source, size AS source_size, coalesce(least(CAST(cap AS DOUBLE), one.unit * weight), 0.0) AS target FROM u LEFT JOIN one ON true),
m AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words, ((coalesce(doc_id, size) % 2147483648) * 2654435761 + 97531) % 4294967296 AS mix
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY mix, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
    FROM m),
k AS (SELECT s.source, s.s, CASE WHEN s.size = 0 THEN 0 ELSE words // s.size * CAST(ceil(s.size / 2048) AS BIGINT) + CAST(ceil(words % s.size / 2048) AS BIGINT) END AS slots
      FROM s JOIN (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words FROM t) t ON s.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "first",
    length(bin(CAST(sum(slots) OVER () AS BIGINT) - 1)) AS bits FROM k),
j AS (SELECT source, bits, unnest(range(CAST("first" AS BIGINT), CAST("first" + slots AS BIGINT))) AS j FROM f WHERE slots > 0),
v AS (SELECT source, CAST('0b' || reverse(lpad(bin(j), CAST(bits AS INT), '0')) AS BIGINT) AS position FROM j),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) - 1 AS "rank" FROM v),
z AS (SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size + greatest(0, least(a + size, words % source_size) - a) END AS BIGINT) AS taken
    FROM r)
SELECT z.doc_id, z.size, z.source_size, z.target, z.taken, p.position
FROM z LEFT JOIN p ON z.source IS NOT DISTINCT FROM p.source AND p."rank" = a // 2048 AND z.taken > 0
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM d),
g AS (SELECT k, p, array_to_string(ws[p:p + 2], ' ') AS gram FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3)),
rp AS (SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY k, gram) AS c FROM g) WHERE c > 1),
rw AS (SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest(range(p, p + 3)) AS q FROM rp) GROUP BY k),
m AS (SELECT w.k, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    len(ls) AS n_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN rw USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 
       coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) AS symbol_share, 
       coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_line_share, 
       coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeat_share, 
       coalesce(100 * word_chars // nullif(n_words, 0), 0) AS word_length FROM m),
sv AS (SELECT lang, source, 'symbol_share' AS rule, 20 AS spread, symbol_share AS v FROM b WHERE NOT base_failed
       UNION ALL SELECT lang, source, 'dup_line_share', 100, dup_line_share FROM b WHERE NOT base_failed
       UNION ALL SELECT lang, source, 'repeat_share', 60, repeat_share FROM b WHERE NOT base_failed
       UNION ALL SELECT lang, source, 'word_length', 100, word_length FROM b WHERE NOT base_failed),
st AS (SELECT lang, source, rule, spread, CAST(v - v % CAST(pow(10, greatest(0, length(CAST(v AS VARCHAR)) - 4)) AS BIGINT) AS BIGINT) AS bin
    FROM sv),
qa AS (SELECT lang, source, rule, spread, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3, count(*) AS n FROM st GROUP BY ALL),
qb AS (SELECT lang, rule, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3, count(*) AS n FROM st GROUP BY ALL),
qc AS (SELECT rule, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM st GROUP BY ALL),
q AS (SELECT qa.lang, qa.source, qa.rule, qa.spread, CASE WHEN qa.n >= 50 THEN qa.q1 WHEN qb.n >= 50 THEN qb.q1 ELSE qc.q1 END AS q1,
    CASE WHEN qa.n >= 50 THEN qa.q3 WHEN qb.n >= 50 THEN qb.q3 ELSE qc.q3 END AS q3
    FROM qa JOIN qb ON qa.lang IS NOT DISTINCT FROM qb.lang AND qa.rule = qb.rule
    JOIN qc ON qa.rule = qc.rule),
l AS (SELECT lang, source, max(CASE WHEN rule = 'symbol_share' THEN q3 + 3 * greatest(q3 - q1, spread) END) AS hs,
    max(CASE WHEN rule = 'dup_line_share' THEN q3 + 3 * greatest(q3 - q1, spread) END) AS hd, max(CASE WHEN rule = 'repeat_share' THEN q3 + 3 * greatest(q3 - q1, spread) END) AS hr,
    max(CASE WHEN rule = 'word_length' THEN q3 + 3 * greatest(q3 - q1, spread) END) AS hw, max(CASE WHEN rule = 'word_length' THEN q1 - 3 * greatest(q3 - q1, spread) END) AS lw
    FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(symbol_share <= hs AND dup_line_share <= hd AND repeat_share <= hr AND word_length <= hw AND word_length >= lw,
    true) AS kept
FROM b LEFT JOIN l ON b.lang IS NOT DISTINCT FROM l.lang AND b.source IS NOT DISTINCT FROM l.source
"""


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, scan, spell

    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    live = F.size(F.filter("found", lambda s: s["live"])).cast("long")
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(spell(F.col("base")), 256).alias("base_sha256"), spell(F.col("found")).alias("spans"), live.alias("n_live"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {q: globals()[f"{q.split('_')[0].upper()}_SQL"] for q in queries() if f"{q.split('_')[0].upper()}_SQL" in globals()}
