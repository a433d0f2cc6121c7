"""Document fingerprints from prefix polynomial hashes.

The prefix hashes of a text modulo two primes answer whether any two spans are
equal, and binary search over them finds longest common extensions.  A
fingerprint holds the text's length, the hash of the whole text and the smallest
hashes of all its spans of WINDOW characters, so that two fingerprints say how
alike their texts are: the share of common spans.  A text of less than two such
spans' length also keeps those of SHORT characters, by which two short texts are
compared.

Null text is an empty text.  Equal texts have equal fingerprints.  Of rows with
equal ids the lesser text comes first; null ids come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_udf

WINDOW, SHORT, KEPT = 24, 6, 64
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525077)
#: Rows in a bucket of neighbouring ids, and the most buckets whose bounds the driver holds.
BUCKET_ROWS, MAX_BUCKETS = 500, 20_000


class _Powers:
    """Powers of the bases and of their inverses, as far as the longest text needs."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def reach(self, n: int) -> None:
        for k, (p, b) in enumerate(zip(PRIMES, BASES)):
            for table, base in ((self.up, b), (self.down, pow(b, -1, p))):
                while len(table[k]) < n:
                    t = table[k]
                    table[k] = np.concatenate([t, t * np.uint64(pow(base, len(t), p)) % np.uint64(p)])


_powers = _Powers()


class PrefixHash:
    """Prefix hashes of a text; ``head``, another one, gives those of its first ``keep`` characters."""

    def __init__(self, text: str, head: PrefixHash | None = None, keep: int = 0):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = keep + len(codes)
        _powers.reach(self.n + 1)
        self.sums = []
        for k, p in enumerate(PRIMES):
            terms = codes * _powers.up[k][keep:self.n] % np.uint64(p)
            if head is None:
                sums = np.zeros(self.n + 1, np.uint64)
                np.cumsum(terms, out=sums[1:])
                sums %= np.uint64(p)
            else:
                old = head.sums[k][:keep + 1]
                sums = np.concatenate([old, (np.cumsum(terms) + old[-1]) % np.uint64(p)])
            self.sums.append(sums)

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """The hash of characters i to j (exclusive): equal for equal spans of any texts."""
        return tuple((int(s[j]) - int(s[i])) * int(_powers.down[k][i]) % PRIMES[k] for k, s in enumerate(self.sums))

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """How many characters from i on equal those of ``other`` from j on."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def windows(self, start: int = 0, width: int = WINDOW) -> np.ndarray:
        """Hashes of all spans of ``width`` characters from ``start`` on; of the whole text if it is shorter."""
        w = min(width, self.n)
        if not self.n:
            return np.zeros(0, np.uint64)
        out = np.zeros(max(0, self.n - w + 1 - start), np.uint64)
        for k, (p, s) in enumerate(zip(PRIMES, self.sums)):
            q = np.uint64(p)
            part = (s[w + start:] + q - s[start:self.n - w + 1]) % q * _powers.down[k][start:self.n - w + 1] % q
            out = out << np.uint64(31) | part
        return out


def smallest(hashes: np.ndarray, k: int = KEPT) -> np.ndarray:
    """The k smallest distinct ones, in order."""
    part = np.unique(np.partition(hashes, 4 * k)[:4 * k]) if len(hashes) > 8 * k else np.unique(hashes)
    if len(part) < k and len(hashes) > 8 * k:
        part = np.unique(hashes)
    return part[:k]


def fingerprint(h: PrefixHash, least: np.ndarray) -> str:
    a, b = h.span(0, h.n)
    short = f":{_told(smallest(h.windows(width=SHORT)))}" if h.n < 2 * WINDOW else ""
    return f"{h.n:x}:{a << 31 | b:016x}:{_told(least)}{short}"


def _told(hashes: np.ndarray) -> str:
    return ",".join([f"{x:016x}" for x in hashes.tolist()])


def likeness(a: str, b: str) -> float:
    """The share of common spans that two fingerprints tell, 0 to 1."""
    if a == b:
        return 1.0
    parts = [f.split(":")[2:] for f in (a, b)]
    x, y = (set(p[min(map(len, parts)) - 1].split(",")) - {""} for p in parts)  # short spans if both have them
    least = sorted(x | y)[:KEPT]
    return sum(v in x and v in y for v in least) / len(least) if least else 0.0


def fingerprint_of(text: Column) -> Column:
    """The fingerprint of a text column."""
    def row(t):
        h = PrefixHash(t or "")
        return (fingerprint(h, smallest(h.windows())),)
    return text_udf("f:string", row)(text).getField("f")


def _compare(text: str, h: PrefixHash, least: np.ndarray, f: str, after: str, g: PrefixHash, next_f: str) -> tuple:
    half = h.n // 2
    keep, more = h.n - half, after[:half]
    edited = PrefixHash(more, h, keep)
    shared = max(0, keep - WINDOW + 1)
    if edited.n >= WINDOW and h.n >= WINDOW:
        windows = np.concatenate([h.windows()[:shared], edited.windows(shared)])
    else:
        windows = edited.windows()
    edited_f = fingerprint(edited, smallest(windows))
    sha = hashlib.sha256((text[:keep] + more).encode("utf-8", "surrogatepass")).hexdigest()
    return (h.n, sha, f, edited_f, likeness(f, edited_f), likeness(f, next_f), h.extension(0, edited, 0), h.extension(0, g, 0))


_FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
           ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_edited", pa.int64()), ("common_next", pa.int64())]
_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, common_edited long, common_next long")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, own rows before the head of the next bucket: compares each with the one after it."""
    schema = pa.schema([("doc_id", pa.int64()), *_FIELDS])
    held = None  # (bucket, doc_id, text, prefix hashes, least spans, fingerprint), waits for the row after it
    for batch in batches:
        out = []
        for bucket, head, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "head", "doc_id", "text"))):
            if head and (held is None or held[0] != bucket):
                continue  # this bucket's last row has met its head already
            text = text or ""
            h = PrefixHash(text)
            least = smallest(h.windows())
            f = fingerprint(h, least)
            if held is not None:
                out.append((held[1], *_compare(*held[2:], text, h, f)))
            held = None if head else (bucket, doc_id, text, h, least, f)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(schema), schema.types)], schema=schema)


def compare_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document are.

    The next document is that of the next smaller id, after the last the first.
    The edited text has the last half of the text replaced by the next one's start.
    Ids are dealt to buckets of neighbours; the first row of each bucket also goes
    to the bucket before it, so that texts are shuffled once.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = rows.select("doc_id")
    buckets = int(min(MAX_BUCKETS, max(1, ids.count() // BUCKET_ROWS)))
    bounds = np.unique(np.array(ids.stat.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.2 / buckets)
                                if buckets > 1 else [], np.float64)).astype(np.int64)
    lowest = np.iinfo(np.int64).min

    @F.arrow_udf("int")
    def bucket_of(i: pa.Array) -> pa.Array:
        # the largest ids are in bucket 0
        return pa.array(len(bounds) - np.searchsorted(bounds, i.fill_null(lowest).to_numpy(zero_copy_only=False), "right"), pa.int32())

    heads = sorted((r[0], r[1]) for r in ids.withColumn("b", bucket_of("doc_id")).groupBy("b").agg(
        F.max(F.coalesce("doc_id", F.lit(lowest)))).collect())  # a row a bucket, MAX_BUCKETS at most
    before = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}
    sought = np.array(sorted(before), np.int64)
    targets = np.array([before[int(k)] for k in sought], np.int32)

    @F.arrow_udf("int")
    def head_for(i: pa.Array) -> pa.Array:
        v = i.fill_null(lowest).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(sought, v), len(sought) - 1)
        hit = sought[at] == v
        return pa.array(targets[at], mask=~hit)

    if not heads:
        return rows.sparkSession.createDataFrame([], _SCHEMA)
    def place(bucket, head):
        return F.struct(bucket.alias("bucket"), F.lit(head).alias("head"))

    to = head_for("doc_id")
    placed = rows.select("doc_id", "text", bucket_of("doc_id").alias("_b"), to.alias("_to")).select(
        "doc_id", "text", F.explode(F.when(F.col("_to").isNull(), F.array(place(F.col("_b"), False)))
                                    .otherwise(F.array(place(F.col("_b"), False), place(F.col("_to"), True)))).alias("p"))
    return (placed.select("p.bucket", "p.head", "doc_id", "text").repartition("bucket")
            .sortWithinPartitions("bucket", "head", F.desc_nulls_last("doc_id"), "text")
            .mapInArrow(_stream, _SCHEMA))
