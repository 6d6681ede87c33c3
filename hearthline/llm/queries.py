"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontam, doubling, itq, langid, lpf, mixing, packing, ranked, secrets, simhash, tokenfile, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op2_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score_documents(_table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf.digest(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.digest(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages")).drop("score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_itq_near_dedup, op3_packing, op4_lm_scoring, op5_repeats, op6_simhash, op7_decontamination, op8_substring_dedup, op9_url_filter, op10_language_id, op11_token_files, op12_ranked_search, op13_tokenizer_alignment)}


_WORDS = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id WHERE r.c < l.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept FROM v JOIN c ON c.vec_id = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

OP7 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM b, UNNEST(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw), dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, UNNEST(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON bw.k = dw.k AND bw.g = dw.g),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM h, UNNEST(range(i, i + k)) AS t(j) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) q GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(s.n, 0) AS n_items, sha256(coalesce(s.items, '')) AS items_sha256, p.n IS NOT NULL AS contaminated FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id"""

OP8 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, UNNEST(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
f AS (SELECT h, min(doc_id) AS m FROM x GROUP BY h), g AS (SELECT DISTINCT doc_id, j FROM (SELECT x.doc_id, x.i FROM x JOIN f ON f.h = x.h WHERE x.doc_id > f.m) q, UNNEST(range(i, i + 50)) AS t(j)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), k AS (SELECT d.doc_id, string_agg(d.w[j], ' ' ORDER BY j) AS t FROM d, UNNEST(range(1, len(d.w) + 1)) AS u(j) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = d.doc_id AND g.j = u.j) GROUP BY d.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""

_ORDERS = "\n".join(
    f"""p{k} AS (SELECT g.gram, (s.a + 4.0 * g.pa) / (c.a + 4.0) AS pa, (s.b + 4.0 * g.pb) / (c.b + 4.0) AS pb FROM {f'p{k - 1}' if k else 'start'} g
JOIN (SELECT substr(gram, {5 - k}, {k + 1}) AS s, sum(a) AS a, sum(b) AS b FROM counts GROUP BY 1) s ON s.s = substr(g.gram, {5 - k}, {k + 1})
JOIN (SELECT substr(gram, {5 - k}, {k}) AS c, sum(a) AS a, sum(b) AS b FROM counts GROUP BY 1) c ON c.c = substr(g.gram, {5 - k}, {k})),"""
    for k in range(5)
)
OP9 = rf"""WITH u AS (SELECT page_id, {_LOWER.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT *, host || path AS address, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u),
w AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS action FROM r),
ad AS (SELECT address, count(*) AS n, max(action) AS action, substr(md5(address), 1, 1) < '4' AS held FROM w WHERE address <> '' GROUP BY address),
gr AS (SELECT ad.*, substr(chr(1) || chr(1) || chr(1) || chr(1) || address || chr(2), i, 5) AS gram FROM ad, UNNEST(range(1, length(address) + 2)) AS t(i)),
counts AS (SELECT gram, CAST(sum(CASE WHEN action = 'allow' AND NOT held THEN n ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN action = 'block' AND NOT held THEN n ELSE 0 END) AS DOUBLE) AS b FROM gr GROUP BY gram),
start AS (SELECT gram, 1 / 96.0::DOUBLE AS pa, 1 / 96.0::DOUBLE AS pb FROM counts),
{_ORDERS}
sc AS (SELECT gr.address, round(sum(ln(p4.pa / p4.pb)) / count(*), 6) AS score FROM gr JOIN p4 ON p4.gram = gr.gram GROUP BY gr.address),
bins AS (SELECT CAST(floor(sc.score * 100) AS BIGINT) AS bin, sum(CASE WHEN action = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN action = 'block' THEN n ELSE 0 END) AS b FROM ad JOIN sc ON sc.address = ad.address WHERE held AND action IS NOT NULL GROUP BY 1),
cost AS (SELECT bin, round(coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / CAST((SELECT sum(a) FROM bins) AS DOUBLE) + coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) / CAST((SELECT sum(b) FROM bins) AS DOUBLE), 6) AS cost FROM bins),
th AS (SELECT CASE WHEN (SELECT coalesce(sum(a), 0) = 0 OR coalesce(sum(b), 0) = 0 FROM bins) THEN 0.0 ELSE (SELECT bin / 100.0 FROM cost ORDER BY cost, abs(bin), bin LIMIT 1) END AS least)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN sc.score >= th.least THEN 'allow' ELSE 'block' END) AS verdict FROM w LEFT JOIN sc ON sc.address = w.address CROSS JOIN th"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP12 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERMS}') AS w FROM documents),
h AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0), s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS l FROM h),
tf AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM d) q GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY t, s.n),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERMS}') AS w FROM benchmark),
q AS (SELECT i, t, CAST(count(*) AS BIGINT) AS times FROM (SELECT i, unnest(w) AS t FROM i) x GROUP BY i, t),
e AS (SELECT q.i, h.doc_id, h.r, CAST(sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * h.n * s.n) // s.l)))) AS BIGINT) AS score
  FROM q JOIN tf ON tf.t = q.t JOIN w ON w.t = q.t JOIN h ON h.r = tf.r, s GROUP BY q.i, h.doc_id, h.r),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank FROM e WHERE score > 0)
SELECT i.item_id, k.rank, k.doc_id, k.score FROM k JOIN i ON i.i = k.i WHERE k.rank <= 10"""

ORACLE_SQL: dict[str, str] = {"op2_itq_near_dedup": OP2, "op7_decontamination": OP7, "op8_substring_dedup": OP8, "op9_url_filter": OP9, "op12_ranked_search": OP12}
