"""Sharding by balanced label propagation.

Equal texts are one node, so that they stay together; nodes are linked through
hubs, the long lines that two or more of them share, and a node may have many
hubs.  Every node starts on the shard its hash falls on.  In each round hubs
count their nodes' shards, the counts are joined back to the nodes, and a node
adds up the shares of its hubs' other nodes on each shard: it asks for the shard
with the largest sum if that is more than where it is, in every second round or
so, as two neighbours would change places otherwise.  Quotas decide who moves:
the driver gets the weights asked for by pair of shards, in cells of gain and
hash, cuts the flows down until no shard is over its quota, and only whole cells
that fit go.  At the end shards over their count give up rows, unlinked ones
first, then those linked by lines only, to shards under it, so that counts are
at most one apart.

Nodes and hubs are known by 64 bits: should two texts share them, they only stay
together.  A node of more rows than a quarter of a shard is split beforehand.  Null and
empty texts are linked with nothing.  Repeated rows are rows of their own; hot
nodes and hubs are joined by broadcast (HOT_KEYS at most), the others by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rank_within, settle

SHARDS, ROUNDS = 8, 5
#: Characters of a line that links texts, and the share by which shards may differ while nodes move.
LINE, SLACK = 40, 0.05
#: Keys with more than one in so many of all rows are joined by broadcast.
HOT_KEYS = 10_000
#: Cells of the moves asked for: by gain, and by hash within a gain.
GAINS, CELLS = 16, 64


def join_hot(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` with the row of ``table`` of their key; column ``n`` of it tells how many rows have that key, of ``total``.

    Keys with more than one in HOT_KEYS of all rows are HOT_KEYS at most, and are broadcast; only the others are shuffled,
    if there are more keys at all.  ``table`` is read twice or more, so it should be a settled one."""
    if table.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
        return rows.join(F.broadcast(table), key)
    is_hot = F.col(n) > total / HOT_KEYS
    hot = table.where(is_hot)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(~is_hot), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def links_of(docs: DataFrame, node: str, text: str, line: int = LINE) -> DataFrame:
    """node, hub, n: which nodes have which lines of ``line`` characters or more, for lines that n > 1 nodes have."""
    lines = F.filter(F.array_distinct(F.transform(F.split(text, "\n"), F.trim)), lambda x: F.length(x) >= line)
    hub = F.transform(lines, lambda x: F.xxhash64(x))
    members = settle(docs.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.explode(hub).alias("hub")).distinct())
    hubs = settle(members.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return join_hot(members, hubs, "hub", "n", members.count())


def hub_counts(links: DataFrame, nodes: DataFrame, shards: int) -> DataFrame:
    """hub, n, counts: how many of a hub's nodes are on each shard."""
    held = F.array(*[F.count_if(F.col("shard") == k) for k in range(shards)])
    return links.join(nodes.select("node", "shard"), "node").groupBy("hub", "n").agg(held.alias("counts"))


def cut_edges(links: DataFrame, nodes: DataFrame, shards: int = SHARDS) -> float:
    """Pairs of nodes that share a hub but not a shard; those of a hub of n nodes weigh 1 / (n - 1) each, as in the votes."""
    within = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c * c)
    cut = (F.col("n") * F.col("n") - within) / 2 / (F.col("n") - 1)
    return hub_counts(links, nodes, shards).agg(F.coalesce(F.sum(cut), F.lit(0.0)).alias("cut")).first()["cut"]


def flows(asked: dict[tuple[int, int], float], load: list[float], most: list[float]) -> dict[tuple[int, int], float]:
    """What may go from shard to shard of what is asked for, so that no shard gets more than it may hold."""
    go = dict(asked)
    for _ in range(200):
        into = [sum(x for (_, j), x in go.items() if j == k) for k in range(len(load))]
        out = [sum(x for (i, _), x in go.items() if i == k) for k in range(len(load))]
        over = [load[k] + into[k] - out[k] - most[k] for k in range(len(load))]
        full = [k for k in range(len(load)) if over[k] > 1e-6 and into[k] > 0]
        if not full:
            return go
        for (i, j), x in go.items():
            if j in full:
                go[i, j] = x * max(0.0, 1 - over[j] / into[j])
    return {pair: 0.0 for pair in asked}


def propagate(links: DataFrame, nodes: DataFrame, load: list[int], most: list[float], shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Move linked nodes (node, w rows, shard) towards the shards of those they share hubs with; no shard grows over ``most`` rows.

    ``load`` are the rows that each shard has at the start, unlinked ones included."""
    total, load = links.count(), list(load)
    for turn in range(rounds):
        votes = settle(hub_counts(links, nodes, shards))
        placed = links.drop("n").join(nodes, "node")
        others = F.array(*[(F.col("counts")[k] - F.when(F.col("shard") == k, 1).otherwise(0)) / (F.col("n") - 1) for k in range(shards)])
        met = join_hot(placed, votes, "hub", "n", total).select("node", "w", "shard", others.alias("o"))
        score = F.array(*[F.round(F.sum(F.col("o")[k]), 6) for k in range(shards)])
        scored = met.groupBy("node", "w", "shard").agg(score.alias("score"))
        best = F.array_max("score")
        gain = best - F.col("score")[F.col("shard")]
        want = F.array_position("score", best).cast("int") - 1
        rank = (GAINS - 1 - F.least(F.lit(GAINS - 1), F.floor(F.log2(1 + 8 * gain)))) * CELLS + F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(CELLS))
        # each second node may ask, so that two neighbours don't change places
        may = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(2)) == 0
        asks = settle(scored.where((gain > 0) & may).select("node", "w", "shard", want.alias("want"), rank.cast("int").alias("rank")))
        cells: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in asks.groupBy("shard", "want", "rank").agg(F.sum("w").alias("w")).collect():  # GAINS x CELLS a pair of shards at most
            cells.setdefault((r["shard"], r["want"]), []).append((r["rank"], r["w"]))
        allowed = flows({pair: float(sum(w for _, w in held)) for pair, held in cells.items()}, load, most)
        upto, moved = [[0] * shards for _ in range(shards)], 0
        for (i, j), held in cells.items():
            gone = 0
            for cell, w in sorted(held):
                if gone + w > allowed[i, j] + 1e-6:
                    break
                gone, upto[i][j] = gone + w, cell + 1
            load[i], load[j], moved = load[i] - gone, load[j] + gone, moved + gone
        if not moved:
            continue
        bound = F.array(*[F.array(*[F.lit(v) for v in row]) for row in upto])
        going = asks.where(F.col("rank") < bound[F.col("shard")][F.col("want")]).select("node", "want")
        nodes = settle(nodes.join(going, "node", "left").withColumn("shard", F.coalesce("want", "shard")).drop("want"))
    return nodes


def placed_nodes(rows: DataFrame, docs: DataFrame, n: int, shards: int, rounds: int) -> DataFrame:
    """node, w, shard, kind (0: several rows, 1: linked by lines, 2: alone) of every node of ``rows``."""
    start = F.pmod(F.xxhash64("node", F.lit("shard")), F.lit(shards)).cast("int")
    nodes = settle(rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("w")).withColumn("shard", start))
    links = settle(links_of(docs, "node", "text"))
    linked = settle(nodes.join(links.select("node").distinct(), "node"))
    sums = {r[0]: r[1] for r in nodes.groupBy("shard").agg(F.sum("w")).collect()}  # a row a shard
    load, most = [sums.get(k, 0) for k in range(shards)], [(1 + SLACK) * n / shards] * shards
    moved = propagate(links, linked, load, most, shards, rounds)
    at = moved.select("node", F.col("shard").alias("_to"))
    return settle(nodes.join(at, "node", "left").select(
        "node", "w", F.coalesce("_to", "shard").alias("shard"), F.when(F.col("w") > 1, 0).when(F.col("_to").isNotNull(), 1).otherwise(2).alias("kind")))


def node_of(docs: DataFrame, n: int, shards: int) -> DataFrame:
    """``docs`` (doc_id, text, ...) with their node: equal texts share one, if that is less than a quarter of a shard's rows; none for null and empty texts."""
    t = F.col("text")
    same = F.when(t != "", F.xxhash64(t, F.octet_length(t)))
    most = max(1, n // (4 * shards))
    docs = docs.withColumn("node", same)
    large = docs.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)  # 4 x shards at most
    part = F.pmod(F.xxhash64("doc_id", F.lit("split")), F.ceil(F.col("_n") / most))
    return docs.join(F.broadcast(large), "node", "left").withColumn("node", F.when(F.col("_n").isNull(), F.col("node")).otherwise(F.xxhash64("node", part))).drop("_n")


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null) of each row of ``docs``."""
    t = F.col("text")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    n = docs.count()
    quotas = [n // shards + (k < n % shards) for k in range(shards)]
    docs = node_of(docs, n, shards)
    rows = settle(docs.select("doc_id", (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
                              F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"), "node"))
    nodes = placed_nodes(rows, docs, n, shards, rounds)
    alone = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int")
    every = settle(join_hot(rows.where("node is not null"), nodes, "node", "w", n).drop("w", "node").unionByName(
        rows.where("node is null").select("doc_id", "size", "text_crc32", alone.alias("shard"), F.lit(2).alias("kind"))))

    held = {(r[0], r[1]): r[2] for r in every.groupBy("shard", "kind").count().collect()}  # 3 rows a shard
    count_of = [sum(held.get((k, kind), 0) for kind in range(3)) for k in range(shards)]
    ranked = rank_within(every, ["shard", "kind"], ["doc_id", "size", "text_crc32"], "_rank", rows=n)

    def by_shard(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values])[F.col("shard")]

    ahead = [by_shard([sum(held.get((k, less), 0) for less in range(kind)) for k in range(shards)]) for kind in range(3)]
    place = F.col("_rank") + F.array(*ahead)[F.col("kind")]
    spare_from, at = [], 0
    for k in range(shards):
        spare_from.append(at)
        at += max(0, count_of[k] - quotas[k])
    spare = F.when(place >= by_shard(quotas), by_shard(spare_from) + place - by_shard(quotas))
    out = ranked.select("*", place.alias("_place"), spare.alias("_spare"))
    to, slot, at = F.col("shard"), F.col("_place"), 0
    for k in range(shards):
        gap = max(0, quotas[k] - count_of[k])
        here = (F.col("_spare") >= at) & (F.col("_spare") < at + gap)
        to = F.when(here, k).otherwise(to)
        slot = F.when(here, F.col("_spare") - at + count_of[k]).otherwise(slot)
        at += gap
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), to.cast("int").alias("shard"),
                      slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
