"""N-gram Jaccard join: documents whose word n-gram sets are alike, and the groups they form.

Sets of hashed n-grams are ordered rare first, by the counts of a sketch whose
size grows with the number of rows up to a bound; any order gives right results,
a better one fewer candidates.  Two
sets as alike as asked for share an n-gram among the first of each (its prefix),
so rows (n-gram, set) of the prefixes are brought together by n-gram.  Texts
with equal sets are one class and take part once.

Candidates are cut down by length, by position (what can still be shared after
a common n-gram) and by a suffix filter (counts of n-grams by hash range bound
the difference from below); those left are verified against the whole sets,
once a pair.  A group of thousands isn't compared pair by pair: first each
prefix n-gram's sets are only held against the one with that n-gram foremost;
then, where an n-gram's sets aren't all connected yet, pairs from different
components are, in blocks.  So no link between different components is lost.

Null text, empty text and text without words have an empty set, linked with
nothing; fewer words than an n-gram make one n-gram of all.  Rows without an id
get no component.  Rows that repeat an id count as one document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, settle, small_batches

NGRAM, PERCENT = 5, 80
#: Counters of the frequency sketch: 16 a row between these bounds (4 to 64 million), dealt out in ranges; it is broadcast with a byte a counter.
SKETCH_BITS, MOST_SKETCH_BITS, RANGE_BITS = 22, 26, 16
#: Hash ranges whose counts the suffix filter compares.
SUFFIX_RANGES = 32
#: Up to so many sets of one prefix n-gram are paired by a join; more are compared in a task, so many at once.
FEW, BLOCK = 64, 2048
#: Bits of the filter that picks the documents whose sets are needed: 16 for each between these bounds (1 to 64 MB).
PICK_BITS, MOST_PICK_BITS = 23, 29
#: Sets of one prefix n-gram, by the sketch, that may meet in a task; those of a more frequent one are dealt to several.
HOT = 50_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_B = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the word k-grams of a text."""
    return _grams(_lowered(text), k)


def _grams(lowered: bytes, k: int) -> np.ndarray:
    words = lowered.split()
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(words))
    rolled = one[:len(words) - n + 1].copy()
    for j in range(1, n):
        rolled = rolled * _B + one[j:len(words) - n + 1 + j]
    return np.unique(_mix(rolled + np.uint64(n)))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _class_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers."""
    return int(_mix(s).sum().view(np.int64)), int(np.bitwise_xor.reduce(_mix(s + _B)).view(np.int64))


def _ranges(s: np.ndarray) -> bytes:
    counts = np.bincount((s >> np.uint64(64 - (SUFFIX_RANGES.bit_length() - 1))).astype(np.int64), minlength=SUFFIX_RANGES)
    return np.minimum(counts, 65535).astype("<u2").tobytes()


_SURVEY = "kind int, doc_id long, n long, a long, b long, ranges binary, part int, counts binary"


def _survey(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
                            ("ranges", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
        sketch = np.zeros(1 << bits, np.uint32)
        mask = np.uint64((1 << bits) - 1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingles(text, k)
                if len(s):
                    np.add.at(sketch, (s & mask).astype(np.int64), 1)
                    rows.append((0, doc_id, len(s), *_class_of(s), _ranges(s), None, None))
                else:
                    rows.append((0, doc_id, 0, None, None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, schema.types)], schema=schema)
        parts = [(1, None, None, None, None, None, p, zlib.compress(x.astype("<u4").tobytes(), 1))
                 for p, x in enumerate(sketch.reshape(-1, 1 << RANGE_BITS)) if x.any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), schema.types)], schema=schema)
    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counts of each range of the sketch, and gives their logarithms in a byte each."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(zlib.decompress(counts), "<u4").astype(np.uint64)
            total[part] = total[part] + x if part in total else x
    rows = [(p, np.minimum(8 * np.log2(1 + x.astype(float)), 255).astype(np.uint8).tobytes()) for p, x in total.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "logs"])


def _shares(logs: np.ndarray, hot: int) -> np.ndarray:
    """Logarithms as the sketch has them -> to how many tasks the sets of such an n-gram are dealt."""
    return np.ceil(np.exp2(logs / 8.0) / hot).astype(np.int64)


def _prefixes(k: int, percent: int, logs, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(logs.value, np.uint8)
        mask, shares = np.uint64(len(table) - 1), _shares(np.arange(256), hot)
        seen: set[tuple[int, int]] = set()  # classes that this task has given rows of
        for batch in batches:
            tokens, classes, sizes, places, parts = [], [], [], [], []
            for text in batch.column(0).to_pylist():
                s = shingles(text, k)
                if not len(s) or (c := _class_of(s)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(c)
                p = prefix_length(len(s), percent)
                key = table[(s & mask).astype(np.int64)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
                first = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
                first = first[np.argsort(key[first], kind="stable")]
                tokens.append(s[first].view(np.int64))
                classes.append(np.full(p, c[0], np.int64))
                sizes.append(np.full(p, len(s), np.int32))
                places.append(np.arange(p, dtype=np.int32))
                dealt = shares[table[(s[first] & mask).astype(np.int64)]]
                parts.append(np.where(dealt > 1, (c[1] & 0xFFFFFFFF) % dealt, -1).astype(np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (tokens, classes, sizes, places, parts)],
                                                 names=["token", "a", "n", "pos", "part"])
    return run


def _least_shared(n: Column, m: Column, percent: int) -> Column:
    """The fewest n-grams that sets of these sizes must share."""
    return F.ceil((n + m) * percent / F.lit(100 + percent))


def _within(n: Column, m: Column, pos: Column, qos: Column, percent: int) -> Column:
    """The length filter, and the position filter for an n-gram at these places."""
    length = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    most = F.least(pos, qos) + 1 + F.least(n - pos - 1, m - qos - 1)
    return length & (most >= _least_shared(n, m, percent))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Counts of n-grams by hash range -> the fewest n-grams that are in one set only."""
    return np.abs(x.astype(np.int32) - y.astype(np.int32)).sum(-1)


def suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that the counts by hash range allow."""
    @F.arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.bool_())
        a, b = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, SUFFIX_RANGES) for c in (x, y))
        both = n.to_numpy(zero_copy_only=False) + m.to_numpy(zero_copy_only=False)
        return pa.array(_apart(a, b) <= both - 2 * -(-percent * both // (100 + percent)))

    left = classes.select(F.col("rep").alias("u"), F.col("n").alias("_n"), F.col("ranges").alias("_x"))
    right = classes.select(F.col("rep").alias("v"), F.col("n").alias("_m"), F.col("ranges").alias("_y"))
    return pairs.join(left, "u").join(right, "v").where(near("_x", "_y", "_n", "_m")).select("u", "v").distinct()


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of ids that link: their texts' whole sets are compared."""
    wanted = settle(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct())
    size = 1 << min(MOST_PICK_BITS, max(PICK_BITS, int(16 * wanted.count()).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    words = wanted.select((slot / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit"))
    bits = np.zeros(size // 64, np.int64)
    for w, bit in words.groupBy("w").agg(F.bit_or("bit")).toLocalIterator():
        bits[w] = bit
    held = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            picked = np.flatnonzero((held.value[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1))
            texts = [_lowered(batch.column(1)[int(i)].as_py()) for i in picked]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(picked)), pa.array(
                [zlib.compress(t, 1) if t.strip() else None for t in texts], pa.binary())], names=["doc_id", "t"])

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        grams = lru_cache(8)(lambda packed: _grams(zlib.decompress(packed), k))  # rows of one v follow one another
        out = []
        for i in range(len(x)):
            a, b = (grams(c[i].as_py()) for c in (x, y))
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    # Packed texts, as sets of hashes are three times their size and can't be packed.
    made = docs.where("doc_id is not null").select("doc_id", "text", slot.alias("slot")).mapInArrow(texts_of, "doc_id long, t binary")
    texts = settle(made.where("t is not null").join(wanted, "doc_id").select("doc_id", "t"))
    left = texts.select(F.col("doc_id").alias("u"), F.col("t").alias("_x"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("t").alias("_y"))
    found = settle(pairs.join(left, "u").join(right, "v").where(alike("_x", "_y")).select("u", "v").distinct())
    release(docs.sparkSession, texts, wanted)
    return found


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of ``links`` (u, v).

    Large-star and small-star in turn, until every link leads to the smallest node."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if not large:
            both = both.where("v < u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else \
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    def told(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = settle(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = told(edges)
    while was[0]:
        edges = settle(star(star(edges, True), False))
        now = told(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _across(percent: int):
    """Pairs of different components in two blocks of one n-gram's sets, if it is the first that they share."""
    def run(table: pa.Table) -> pa.Table:
        sides = [table.filter(pa.compute.field("side") == k) for k in (0, 1)]
        same = bool(table.num_rows) and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        cols = []
        for t in sides if not same else (sides[0], sides[0]):
            c = {name: t.column(name).to_numpy() for name in ("rep", "comp", "n", "pos")}
            c["ranges"] = np.frombuffer(b"".join(t.column("ranges").to_pylist()), "<u2").reshape(-1, SUFFIX_RANGES)
            c["before"] = t.column("before").to_pylist()
            cols.append(c)
        x, y = cols
        holders: dict[int, list[int]] = {}
        for j, tokens in enumerate(y["before"]):
            for t in tokens:
                holders.setdefault(t, []).append(j)
        us, vs = [], []
        for i in range(len(x["rep"])):
            n, pos = x["n"][i], x["pos"][i]
            both = y["n"] + n
            least = -(-percent * both // (100 + percent))
            ok = (y["comp"] != x["comp"][i]) & (np.minimum(y["n"], n) * 100 >= np.maximum(y["n"], n) * percent)
            ok &= 1 + np.minimum(y["n"] - y["pos"] - 1, n - pos - 1) >= least
            if same:
                ok[:i + 1] = False
            for t in x["before"][i]:
                if t in holders:
                    ok[holders[t]] = False
            at = np.flatnonzero(ok)
            if len(at):
                at = at[_apart(y["ranges"][at], x["ranges"][i]) <= both[at] - 2 * least[at]]
                us += [x["rep"][i]] * len(at)
                vs.append(y["rep"][at])
        v = np.concatenate(vs) if vs else np.zeros(0, np.int64)
        u = np.array(us, np.int64)
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})
    return run


def across(postings: DataFrame, comps: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (u, v) between components that still share a prefix n-gram."""
    held = postings.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    mixed = held.groupBy("token").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.count(F.lit(1)).alias("_m")).where("_a != _b")
    left = settle(held.join(mixed.select("token", "_m"), "token").select("token", "rep", "comp", "n", "pos", "_m"))
    few = _among_few(left, percent)
    rest = settle(suffix_filter(few, classes, percent).union(_among_many(left, classes, percent)).distinct())
    release(postings.sparkSession, left)
    return rest


def _among_few(left: DataFrame, percent: int) -> DataFrame:
    """Pairs from n-grams with few sets, by a join; the position filter counts all n-grams that a pair shares there.

    Those that it may share among many-set n-grams count as shared."""
    many = left.groupBy("rep").agg(F.count_if(F.col("_m") > FEW).alias("many"))
    rows = left.where(F.col("_m") <= FEW).join(many, "rep")
    x = rows.select("token", *[F.col(c).alias(f"x_{c}") for c in ("rep", "comp", "n", "pos", "many")])
    y = rows.select("token", *[F.col(c).alias(f"y_{c}") for c in ("rep", "comp", "n", "pos", "many")])
    n, m = F.col("x_n"), F.col("y_n")
    met = x.join(y, "token").where((F.col("x_rep") > F.col("y_rep")) & (F.col("x_comp") != F.col("y_comp"))
                                   & (F.least(n, m) * 100 >= F.greatest(n, m) * percent))
    pairs = met.groupBy(F.col("x_rep").alias("u"), F.col("y_rep").alias("v")).agg(
        F.count(F.lit(1)).alias("c"), F.max("x_n").alias("x_n"), F.max("y_n").alias("y_n"), F.max("x_pos").alias("x_pos"), F.max("y_pos").alias("y_pos"),
        F.max(F.least("x_many", "y_many")).alias("many"))
    most = F.col("c") + F.col("many") + F.least(n - F.col("x_pos") - 1, m - F.col("y_pos") - 1)
    return pairs.where(most >= _least_shared(n, m, percent)).select("u", "v")


def _among_many(left: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs from n-grams with many sets, compared block by block in tasks."""
    large = left.where(F.col("_m") > FEW)
    mine = left.join(large.select("rep").distinct(), "rep").groupBy("rep").agg(F.collect_list(F.struct("token", "pos")).alias("prefix"))
    rows = (large.join(mine, "rep").join(classes.select("rep", "ranges"), "rep")
            .withColumn("before", F.transform(F.filter("prefix", lambda t: t["pos"] < F.col("pos")), lambda t: t["token"])))
    blocks = F.ceil(F.col("_m") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(
        F.least(o, F.col("_block")).alias("i"), F.greatest(o, F.col("_block")).alias("j"), (F.col("_block") > o).cast("int").alias("side")))
    dealt = (rows.withColumn("_blocks", blocks).withColumn("_block", block).withColumn("o", F.explode(others))
             .select("token", "o.i", "o.j", "o.side", "rep", "comp", "n", "pos", "before", "ranges"))
    return dealt.groupBy("token", "i", "j").applyInArrow(_across(percent), "u long, v long")


def _met(tokens: DataFrame, hot: bool) -> DataFrame:
    """token, a, n, pos of the sets that share their prefix n-gram with another, and ``_hub``, the one with it foremost.

    Rows of a frequent n-gram are dealt to parts from 0 on (others are in part -1); what parts say of it is added up beside
    them (``hot``: there are such)."""
    together = W.partitionBy("token", "part")
    hub = F.struct("pos", (-F.col("n")).alias("m"), "a")
    met = (tokens.withColumn("_least", F.min("a").over(together)).withColumn("_most", F.max("a").over(together))
           .withColumn("_hub", F.min(hub).over(together)))
    if hot:
        split = met.withColumn("_p", F.max("part").over(together)).where("_p >= 0")  # as a window's result it isn't tested before the exchange, which serves both
        said = (split.groupBy("token", "part").agg(F.first("_least").alias("l"), F.first("_most").alias("m"), F.first("_hub").alias("h"))
                .groupBy("token").agg(F.min("l").alias("l"), F.max("m").alias("m"), F.min("h").alias("h"), F.collect_list("part").alias("parts"))
                .where(F.size("parts") > 1).select("token", F.explode("parts").alias("part"), "l", "m", "h"))  # a row a part
        met = met.join(said, ["token", "part"], "left").withColumns({
            "_least": F.coalesce("l", "_least"), "_most": F.coalesce("m", "_most"), "_hub": F.coalesce("h", "_hub")})
    # A set's part is told by the n-gram and the set; with it, equal rows are together already.
    return met.where("_least != _most").select("token", "part", "a", "n", "pos", "_hub").distinct().drop("part")


def jaccard_groups(docs: DataFrame, k: int = NGRAM, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the smallest id that links of ``percent`` or more lead to."""
    with small_batches(docs.sparkSession):
        return _groups(docs, k, percent, doc_id, text)


def _groups(docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch_bits = min(MOST_SKETCH_BITS, max(SKETCH_BITS, int(16 * docs.count()).bit_length()))
    survey = settle(docs.mapInArrow(_survey(k, sketch_bits), _SURVEY))
    summed = settle(survey.where("kind = 1").select("part", "counts").repartition("part").mapInArrow(_add_up, "part int, logs binary"))
    rows = settle(survey.where("kind = 0").select("doc_id", "n", "a", "b", "ranges"))
    release(spark, survey)
    classes = settle(rows.where("n > 0 and doc_id is not null").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.min("ranges").alias("ranges")))

    logs = bytearray(1 << sketch_bits)
    for part, some in summed.toLocalIterator():  # a byte for each of the sketch's counters
        logs[part << RANGE_BITS:(part + 1) << RANGE_BITS] = some
    release(spark, summed)
    tokens = docs.where("doc_id is not null").select("text").mapInArrow(
        _prefixes(k, percent, spark.sparkContext.broadcast(bytes(logs)), HOT), "token long, a long, n int, pos int, part int")
    met = _met(tokens, bool(_shares(np.frombuffer(logs, np.uint8).max(), HOT) > 1))
    ids = classes.select("a", "n", "rep")
    postings = settle(met.join(ids, ["a", "n"]).select("token", "rep", "n", "pos", "_hub"))

    hub = ids.select(F.col("a").alias("_ha"), F.col("n").alias("_hn"), F.col("rep").alias("_hub_rep"))
    stars = (postings.where(_within(F.col("n"), -F.col("_hub.m"), F.col("pos"), F.col("_hub.pos"), percent))
             .select("rep", F.col("_hub.a").alias("_ha"), (-F.col("_hub.m")).alias("_hn")).distinct()
             .join(hub, ["_ha", "_hn"]).where("rep != _hub_rep")
             .select(F.greatest("rep", "_hub_rep").alias("u"), F.least("rep", "_hub_rep").alias("v")).distinct())
    links = verify(settle(suffix_filter(stars, classes, percent)), docs, k, percent)
    comps = components(links)
    rest = across(postings.select("token", "rep", "n", "pos"), comps, classes, percent)
    release(spark, postings)
    if not rest.isEmpty():
        comps = components(links.union(verify(rest, docs, k, percent)))
    named = classes.join(comps, classes["rep"] == comps["node"], "left").select("a", "b", "n", F.coalesce("component", "rep").alias("component_id"))
    keys = rows.drop("ranges")
    return (keys.join(named, ["a", "b", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, k: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their group; rows without an id stay.

    Of rows that repeat an id the one with the least text stays.  The columns' names don't matter, as a row is held as one struct."""
    first = jaccard_groups(docs, k, percent).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    least = rows.join(first, "id").withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("row.text"))).where("place = 1")
    return least.select("row").unionByName(rows.where("id is null").select("row")).select("row.*")
