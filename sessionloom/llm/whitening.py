"""Whitening of embeddings by the covariance of their distinct vectors.

Entries are counted in 1/256, as whole numbers, and equal vectors become one
with its count.  The fit gives each distinct vector the weight 1, or its count.
Sums are exact; the covariance is a centred matrix product of each task's
vectors, summed by cells; its unit eigenvectors are found on the driver, where
nothing grows but with the dimensions (MAX_DIMS at most, else an error).  Each
distinct vector is whitened once and joined back to its rows.

A vector of more than a thousandth of all rows is dealt to as many tasks as it
has thousandths, in the join back; there are fewer than a thousand such vectors,
and their list is broadcast.

Rows whose vector is null or has null or non-finite entries are left out.  A
shorter vector counts as ending in zeros; entries beyond a long's range are held
at its ends.  A component without variance gives 0, and so does ``explained``
where no component has any.  Of d dimensions there are d components at most.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

MAX_DIMS = 2048
SCALE = 256


def whole(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and the whole numbers x of each row that stays, without the zeros at their end, which a shorter vector leaves out."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v"), F.coalesce(finite, F.lit(False)).alias("finite")).where("v is not null and finite")
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))
    last = F.coalesce(F.array_max(F.transform("x", lambda c, i: F.when(c != 0, i + 1))), F.lit(0))
    return rows.withColumn("x", F.when(F.get("x", F.size("x") - 1) != 0, F.col("x")).otherwise(F.slice("x", F.lit(1), last)))


def _key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.sha2(F.col("x").cast("string").cast("binary"), 256))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """key, x and times (the number of rows) of each distinct vector."""
    return _key(rows.groupBy("x").agg(F.count(F.lit(1)).alias("times")))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The vectors of a batch as rows of d whole numbers; shorter ones end in zeros."""
    x = batch.column("x")
    flat, ends = x.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))
    lengths = np.diff(ends, prepend=0)
    if (lengths == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(lengths), d), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
    return out


def _fits(bound: float) -> bool:
    return bound < 2 ** 62


def _largest(x: np.ndarray) -> int:
    return max((abs(int(x.max())), abs(int(x.min()))), default=0) if x.size else 0


def _weights(batch: pa.RecordBatch, counts: bool) -> np.ndarray:
    return batch.column("times").to_numpy(zero_copy_only=False) if counts else np.ones(batch.num_rows, np.int64)


def sums(vectors: DataFrame, d: int, counts: bool) -> list[int]:
    """The exact sum of each dimension."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            x, w = _matrix(batch, d), _weights(batch, counts)
            if not _fits(float(_largest(x)) * float(w.sum())):
                x = x.astype(object)
            total = [a + int(b) for a, b in zip(total, (x * w[:, None]).sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    parts = vectors.select("x", "times").mapInArrow(each, "i int, s decimal(38,0)")
    found = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect()}  # d rows
    return [found[i] for i in range(d)]


def covariance(vectors: DataFrame, mean: np.ndarray, n: int, counts: bool) -> np.ndarray:
    """Divisor n; each task centres its vectors and multiplies them, and cells are summed over tasks."""
    d = len(mean)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            centred = _matrix(batch, d) - mean
            total += (centred * _weights(batch, counts)[:, None]).T @ centred
        for i in range(d):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, i, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(total[i])], names=["i", "j", "v"])

    cells = vectors.select("x", "times").mapInArrow(each, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # d * d rows
    out = np.zeros((d, d))
    out[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    return (out + out.T) / (2 * n)


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues, falling, with their unit eigenvectors as columns; an eigenvalue that is rounding only is 0."""
    values, columns = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:k]
    e = values[order]
    return np.where(e > abs(np.trace(v)) * len(v) * np.finfo(float).eps, e, 0.0), columns[:, order]


def _whitened(vectors: DataFrame, d: int, n: int, s: list[int], e: np.ndarray, columns: np.ndarray) -> DataFrame:
    mean = np.array([t / n for t in s])
    scale = np.divide(1.0, np.sqrt(e), out=np.zeros_like(e), where=e > 0)
    exact = np.array(s, object)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, d)
            far = float(n) * _largest(x) + max((abs(t) for t in s), default=0)
            apart = n * x - exact.astype(np.int64) if _fits(far * far * max(1, d)) else n * x.astype(object) - exact
            deviation = [Decimal(int(t)) for t in (apart * apart).sum(1)]
            w = (x - mean) @ columns * scale
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("times"), pa.array(deviation, pa.decimal128(38, 0)), pa.array(w.tolist(), pa.list_(pa.float64()))],
                                             names=["key", "times", "deviation", "w"])

    return vectors.mapInArrow(each, "key string, times long, deviation decimal(38,0), w array<double>")


def _identity_error(white: DataFrame, k: int, n: int, counts: bool) -> float:
    """The greatest absolute entry of the whitened vectors' centred covariance minus the identity."""
    weight = F.col("times") if counts else F.lit(1)
    means = white.agg(*[(F.sum(F.get("w", F.lit(a)) * weight) / n).alias(f"m{a}") for a in range(k)]).first()
    cells = [(a, b) for a in range(k) for b in range(a, k)]
    centred = [F.get("w", F.lit(a)) - F.lit(means[a]) for a in range(k)]
    row = white.agg(*[(F.sum(centred[a] * centred[b] * weight) / n).alias(f"c{a}_{b}") for a, b in cells]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(row, cells))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 4, weights: str = "one") -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained and identity_error: for each row that stays, up to ``k`` rows.

    ``weights`` is ``one`` (each distinct vector once) or ``count``."""
    if weights not in ("one", "count"):
        raise ValueError("weights are one or count")
    counts, rows = weights == "count", whole(vectors, vec_id, embedding)
    fit = settle(distinct_vectors(rows), "whitening-distinct")
    told = fit.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("vectors"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("d")).first()
    d, n = told["d"], told["rows"] if counts else told["vectors"]
    if d > MAX_DIMS:
        raise ValueError(f"vectors of {d} dimensions; at most {MAX_DIMS}")
    k = min(k, d)
    if not n or not k:
        return rows.select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"),
                           *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")]).where(F.lit(False))
    s = sums(fit, d, counts)
    v = covariance(fit, np.array([t / n for t in s]), n, counts)
    e, columns = components(v, k)
    white = settle(_whitened(fit, d, n, s, e, columns), "whitening-vectors")
    error, total = _identity_error(white, k, n, counts), float(np.trace(v))
    share = [float(x / total) if total > 0 else 0.0 for x in e]

    # Vectors of more than a thousandth of the rows: fewer than a thousand.
    hot = F.broadcast(white.where(F.col("times") * 1000 > told["rows"]).select("key", F.ceil(F.col("times") * 1000 / told["rows"]).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = _key(rows).select("vec_id", "key").join(hot, "key", "left").select("vec_id", "key", F.pmod(F.monotonically_increasing_id(), parts).cast("int").alias("part"))
    copies = white.join(hot, "key", "left").select("key", "deviation", "w", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    out = dealt.join(copies, ["key", "part"]).select("vec_id", "deviation", F.posexplode("w").alias("c", "whitened"))
    return out.select("vec_id", (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(F.array(*[F.lit(x) for x in share]), F.col("c")).alias("explained"), F.lit(error).alias("identity_error"))
