"""The registered queries of the llm operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import classlm, decontaminate, divergence, extract, langid, lengths, lexical, licenses, packing, sharding, simhash, topk, toxicity
from plumbline.llm.common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_counts(read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.predict(read(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_simhash": op2_simhash,
        "op3_token_counts": op3_token_counts,
        "op4_class_lm": op4_class_lm,
        "op5_topk": op5_topk,
        "op6_html_text": op6_html_text,
        "op7_license_scan": op7_license_scan,
        "op8_langid": op8_langid,
        "op9_decontamination": op9_decontamination,
        "op10_packing": op10_packing,
        "op11_ranked_search": op11_ranked_search,
        "op12_divergence": op12_divergence,
        "op13_sharding": op13_sharding,
    }


#: Whole results; the other operators train models, pack or read markup, which SQL does not express.
TOPK = """WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, a.n, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.n <> b.n WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


SEARCH = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, row_number() OVER () AS i, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, r, len(w) AS n, unnest(w) AS term FROM d),
p AS (SELECT doc_id, r, n, term, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
u AS (SELECT item_id, i, unnest(w) AS term FROM q),
x AS (SELECT item_id, i, doc_id, r, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM u JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, i, doc_id, r),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""

DIVERGENCE = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS n,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
u AS (SELECT lang, source, n, unnest(w) AS t FROM d),
k AS (SELECT lang, t, count(*) AS c FROM u GROUP BY lang, t HAVING count(DISTINCT n) >= 3),
l AS (SELECT lang, count(*) AS v, CAST(sum(c) AS BIGINT) AS total FROM k GROUP BY lang),
c AS (SELECT u.lang, source, t, count(*) AS c FROM u SEMI JOIN k ON u.lang = k.lang AND u.t = k.t GROUP BY u.lang, source, t),
s AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS total FROM c GROUP BY lang, source),
w AS (SELECT g.lang, g.source, k.t, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (coalesce(s.total, 0) + v) AS p, 1 + (1000000000 * (k.c + 1)) // (l.total + v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value FROM w a JOIN w b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', t, ((p - q) * (p - q)) // q FROM w WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200"""

SHARDING = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size FROM documents),
g AS (SELECT t, CAST(sum(size) AS BIGINT) AS w, min(doc_id) AS f FROM d GROUP BY t),
h AS (SELECT *, row_number() OVER b AS i, sum(w) OVER b - w AS before, sum(w) OVER () AS s FROM g WINDOW b AS (ORDER BY w DESC, f ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, i < 40 AND bool_and(w * (41 - i) >= s - before) OVER (ORDER BY i) AS alone FROM h),
r AS (SELECT t, CAST(sum(w) OVER (ORDER BY f) AS BIGINT) AS e FROM a WHERE NOT alone),
p AS (SELECT list(e) AS ends, max(e) AS total, (SELECT CAST(count(*) AS INTEGER) FROM a WHERE alone) AS giants FROM r),
search AS (SELECT CAST(1 AS BIGINT) AS lo, total AS hi FROM p UNION ALL
  SELECT CASE WHEN ok THEN lo ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT lo, hi, mid, list_reduce(list_prepend(CAST(0 AS BIGINT), range(40 - giants)), lambda b, x: coalesce(list_max(list_filter(ends, lambda e: e <= b + mid)), b)) = total AS ok
    FROM (SELECT lo, hi, (lo + hi) // 2 AS mid FROM search WHERE lo < hi), p)),
best AS (SELECT min(hi) AS capacity FROM search),
walk AS (SELECT giants AS shard, CAST(0 AS BIGINT) AS b FROM p UNION ALL
  SELECT shard + 1, list_max(list_filter(ends, lambda e: e <= b + capacity)) FROM walk, p, best WHERE b < total),
placed AS (SELECT t, CAST(i - 1 AS INTEGER) AS shard, CAST(0 AS BIGINT) AS e FROM a WHERE alone UNION ALL
  SELECT t, (SELECT max(shard) FROM walk WHERE b < e), e FROM r),
tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
sums AS (SELECT t, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) AS text_crc32 FROM g, tab)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY e, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN placed USING (t) JOIN sums USING (t)"""


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": TOPK, "op11_ranked_search": SEARCH, "op12_divergence": DIVERGENCE, "op13_sharding": SHARDING}
