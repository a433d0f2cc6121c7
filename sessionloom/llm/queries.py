"""The corpus queries: each operator applied to its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, fingerprints, jaccard, language, licenses, packing, pii, quality, sharding, toxicity, urls, whitening
from .common import table

#: (verdict, host, path prefix)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: A host label that starts so is a kind of site to be kept out, once one of its pages is reported.
REPORTED_LABELS = r"(^|\.)(adult|ads|casino|cheap|free|malware|phish|spam)-"


def url_rules(spark: SparkSession) -> DataFrame:
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("verdict", "host", "path"), rule)]) for rule in URL_RULES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def reported_sites(pages: DataFrame) -> DataFrame:
    """The list that stands for a real one: the sites of every fourth page (by a hash of its id) whose host has such a label.

    Other pages of these sites, under any scheme, port, subdomain or path, are found by the list only."""
    host = urls.host_of(F.col("url"))
    site = F.regexp_extract(urls.canonical(F.col("url")), "^[^/?]*", 0)
    sample = F.md5(F.col("page_id").cast("string").cast("binary")) < "4"
    return pages.where(sample & host.rlike(REPORTED_LABELS)).select(F.concat(F.lit("http://"), site).alias("url")).distinct()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_rules(table(spark, sf_dir, "documents"))
    return rows.withColumn("dup_5gram_chars", F.col("dup_ngram_chars")[0]).drop("dup_ngram_chars")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, url_rules(spark), reported_sites(pages))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language.learn(language.sample_of(docs.where(F.coalesce(~held_out, F.lit(False)))))
    return language.identify(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).withColumn("spans", F.array_join("spans", ","))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("n_candidates")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), k=4, percent=85)


def damaged(rows: DataFrame) -> DataFrame:
    """The turns of ``conversations`` as the contract damages them: dropped, emptied, without ends of sentences, repeated or said by the user."""
    def told(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    times = F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair_digest(damaged(rows), rows)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_windows", "first_word")


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_packing, op3_url_filter, op4_license_scan, op5_personal_data, op6_fingerprints,
    op7_language_id, op8_sharding, op9_bpe, op10_jaccard_join, op11_conversation_repair, op12_whitening, op13_toxicity)}

ORACLE: dict[str, str] = {}

ORACLE["op3_url_filter"] = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM p),
c AS (
  SELECT page_id, host, path,
         regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') ||
         CASE WHEN len(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) > 0
              THEN '?' || array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&')
              ELSE '' END AS canon FROM q),
sites AS (SELECT DISTINCT regexp_extract(canon, '^[^/?]*') AS site FROM c WHERE canon <> '' AND md5(CAST(page_id AS VARCHAR)) < '4'
          AND regexp_matches(host, '(^|\.)(adult|ads|casino|cheap|free|malware|phish|spam)-')),
listed AS (SELECT DISTINCT canon FROM (SELECT DISTINCT canon, regexp_extract(canon, '^[^/?]*') AS h FROM c) JOIN sites ON h = site OR ends_with(h, '.' || site)),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT DISTINCT host, path FROM c),
best AS (
  SELECT u.host, u.path, max({'l': length(rhost || rpath), 'h': length(rhost), 'v': verdict, 'r': rhost || rpath}) AS b
  FROM u JOIN rules ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath) GROUP BY ALL)
SELECT page_id, c.host AS host, c.path AS path, b.r AS rule,
       coalesce(b.v, CASE WHEN c.host <> '' AND listed.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best ON c.host = best.host AND c.path = best.path LEFT JOIN listed ON c.canon = listed.canon
"""

_LIMITS = ", ".join(f"({n}, {most})" for n, most in quality.NGRAM_LIMITS.items())
ORACLE["op1_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w0 AS (SELECT rid, unnest(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS word,
              generate_subscripts(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) AS pos FROM d),
w AS (SELECT rid, pos, word, length(word) AS chars, {", ".join(f"lead(word, {k}) OVER r AS w{k}" for k in range(1, 10))} FROM w0 WINDOW r AS (PARTITION BY rid ORDER BY pos)),
ns(n, most) AS (VALUES (3, NULL), {_LIMITS}),
g AS (SELECT rid, pos, chars, n, most, CASE WHEN CASE n {" ".join(f"WHEN {n} THEN w{n - 1}" for n in (3, *quality.NGRAM_LIMITS))} END IS NOT NULL
        THEN count(*) OVER (PARTITION BY rid, n, word, w1, w2, {", ".join(f"CASE WHEN n > {k} THEN w{k} END" for k in range(3, 10))},
                            CASE n {" ".join(f"WHEN {n} THEN w{n - 1} IS NULL" for n in (3, *quality.NGRAM_LIMITS))} END) > 1 ELSE false END AS twice FROM w CROSS JOIN ns),
c AS (SELECT rid, n, most, chars, {"CASE n " + " ".join(f"WHEN {n} THEN bool_or(twice) OVER (PARTITION BY rid, n ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, *quality.NGRAM_LIMITS)) + " END"} AS inside FROM g),
s AS (SELECT rid, n, most, count(*) FILTER (inside) AS words_in, coalesce(sum(chars) FILTER (inside), 0) AS chars_in, sum(chars) AS chars FROM c GROUP BY ALL),
v AS (SELECT rid, max(words_in) FILTER (n = 3) AS repeat, bool_or(chars_in > most * chars) AS over, max(chars_in) FILTER (n = 5) AS dup5 FROM s GROUP BY rid),
l0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT rid, line, count(*) AS k, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
l AS (SELECT rid, sum(k - 1) AS dup_lines, coalesce(sum(k * chars) FILTER (k > 1), 0) AS dup_chars FROM l1 GROUP BY rid),
n AS (SELECT rid, count(*) AS n_words, sum(chars) AS word_chars FROM w GROUP BY rid),
a AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup_lines, 0) AS n_dup_lines, coalesce(repeat, 0) AS n_repeat_words,
        coalesce(dup_chars, 0) AS dup_line_chars, coalesce(over, false) AS over, coalesce(dup5, 0) AS dup5
      FROM d LEFT JOIN n USING (rid) LEFT JOIN v USING (rid) LEFT JOIN l USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT over AND dup_line_chars <= {quality.LINE_LIMIT} * word_chars AS kept,
       dup_line_chars::BIGINT AS dup_line_chars, dup5::BIGINT AS dup_5gram_chars
FROM a
"""

ORACLE["op10_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
t AS (SELECT rid, unnest(s) AS x FROM g),
n AS (SELECT rid, doc_id, len(s) AS n FROM g),
shared AS (SELECT x.rid AS a, y.rid AS b, count(*) AS k FROM t x JOIN t y ON x.x = y.x AND x.rid < y.rid GROUP BY ALL),
link AS (SELECT p.doc_id AS u, q.doc_id AS v FROM shared JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
both_ways AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach(u, v) AS (SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u),
comp AS (SELECT u, least(u, min(v)) AS c FROM reach GROUP BY u)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id FROM n LEFT JOIN comp ON doc_id = u
"""
