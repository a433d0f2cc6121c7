"""URL filter: a blocked Bloom filter ahead of an exact hash join.

A list holds entries of two kinds: ``prefix`` entries (a host and a path prefix,
which fit the host and all its subdomains) and ``exact`` entries (one canonical
URL; one of a host alone lists the whole site, its subdomains included).  Each
entry is a key; each URL has a few keys under which it could be listed: every
suffix of its host with every path prefix of a listed length, its canonical
form, and every suffix of its canonical host.  Keys are tested against the Bloom
filter, one 64-bit block a key, and only keys that pass go into the hash join
with the list, which removes false positives.  Everything is SQL functions and
joins.

The filter's words lie in arrays of SEGMENT; it is broadcast, and MAX_FILTER_MB
bounds it whatever the list's length: a longer list makes the filter fuller, and
more false positives go into the exact join.

Distinct (host, path, canonical) triples are judged once, however often they
occur, and joined back to the rows.  A null URL, or one without ``://``, has an
empty host and path and no keys.  The longest prefix entry wins (of equal ones
the longer host, then block before allow); without one, a listed canonical URL
or site gives ``block``; else ``allow``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each entry, and bits set by each entry in its block.
BITS_PER_ENTRY, BITS_SET = 16, 4
#: Words in a row of the filter, and the most MB that the whole filter may have.
SEGMENT, MAX_FILTER_MB = 4096, 64
#: Distinct lengths of listed path prefixes; beyond, the list is refused.
MAX_LENGTHS = 2048
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def canonical(url: Column) -> Column:
    """Host without ``www.``/``m.`` and default port, path without trailing slash, query without tracking, sorted."""
    rest = _rest(url)
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)=")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _block_and_mask(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a key and the bits it sets there."""
    h = F.xxhash64(key)
    g = F.xxhash64(F.lit(1), key)
    mask = F.lit(0).cast("long")
    for i in range(BITS_SET):
        bit = F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(h, F.lit(blocks)), mask


def bloom_filter(keys: DataFrame, key: str, entries: int) -> tuple[DataFrame, int]:
    """Rows (segment, words) of a blocked Bloom filter of ``keys``, and the number of its blocks (a word each)."""
    blocks = min(max(64, entries * BITS_PER_ENTRY // 64), int(MAX_FILTER_MB * (1 << 17)))
    at, mask = _block_and_mask(F.col(key), blocks)
    words = keys.select(at.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))
    every = keys.sparkSession.range(blocks).withColumnRenamed("id", "block").join(words, "block", "left")
    held = F.array_sort(F.collect_list(F.struct("block", F.coalesce("word", F.lit(0).cast("long")).alias("word"))))  # SEGMENT words
    return every.groupBy((F.col("block") / SEGMENT).cast("int").alias("segment")).agg(held["word"].alias("words")), blocks


def might_hold(candidates: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``candidates`` whose key passes the filter (a few false ones among them)."""
    at, mask = _block_and_mask(F.col(key), blocks)
    word = F.get(F.col("words"), (F.col("_block") % SEGMENT).cast("int"))
    return (candidates.withColumn("_block", at).withColumn("_mask", mask).withColumn("segment", (F.col("_block") / SEGMENT).cast("int"))
            .join(F.broadcast(bloom), "segment")  # MAX_FILTER_MB at most
            .where(word.bitwiseAND(F.col("_mask")) == F.col("_mask")).drop("_block", "_mask", "segment", "words"))


def entries_of(rules: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """key, rule, host_length, verdict of every entry of the list."""
    entries = rules.select(F.concat(F.lit("prefix "), "host", "path").alias("key"), F.concat("host", "path").alias("rule"),
                           F.length("host").alias("host_length"), F.col("verdict"))
    if listed is not None:
        exact = listed.select(F.concat(F.lit("exact "), canonical(F.col("url"))).alias("key")).where("key != 'exact '").distinct()
        entries = entries.unionByName(exact.select(
            "key", F.lit(None).cast("string").alias("rule"), F.lit(-1).alias("host_length"), F.lit("block").alias("verdict")))
    return entries


def candidate_keys(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """``urls`` (host, path, canonical) with each key under which one could be listed; ``lengths`` are those of listed paths."""
    path_prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"),
                                         lambda n: n <= F.length("path")),
                                lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(_suffixes(F.col("host")), lambda s: F.transform(path_prefixes, lambda p: F.concat(F.lit("prefix "), s, p))))
    site = F.regexp_extract("canonical", "^[^/?]*", 0)
    exact = F.transform(F.array_union(F.array("canonical"), _suffixes(site)), lambda c: F.concat(F.lit("exact "), c))
    return urls.withColumn("key", F.explode(F.concat(keys, exact)))


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None,
                page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``.

    rules: verdict (``allow``/``block``), host, path.  listed: url, URLs to block; one without path and query blocks its site.
    """
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().limit(MAX_LENGTHS + 1).collect())
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"rules have paths of more than {MAX_LENGTHS} lengths")
    entries = entries_of(rules, listed)
    bloom, blocks = bloom_filter(entries, "key", entries.count())
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    urls = rows.select("host", "path", "canonical").where("host != ''").distinct()
    hits = might_hold(candidate_keys(urls, lengths), "key", bloom, blocks).join(entries, "key")
    best = hits.groupBy("host", "path", "canonical").agg(F.max(F.struct(
        F.coalesce(F.length("rule"), F.lit(-1)).alias("rule_length"), "host_length", "verdict", "rule")).alias("best"))
    return rows.join(best, ["host", "path", "canonical"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
