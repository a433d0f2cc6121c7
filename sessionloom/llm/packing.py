"""Packing documents into sequences of fixed length by cutting-stock column generation.

Each document becomes token ids and is cut into whole sequences and one rest.
The rests' lengths, rounded up to units, form a histogram: a cutting-stock
problem with as many rows as there are lengths, whatever the number of
documents.  A linear program over patterns (which lengths share a sequence) is
grown column by column: a knapsack program over the dual prices finds the
pattern that would help most, until none does.  Pattern counts are rounded down,
what is left over is packed first-fit, and the patterns' places are dealt to the
documents by their rank among those of their length.

Null text is an empty text; a document always has its closing id, so each row
gives at least one piece.  Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import json
import os
import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import rank_within, settle, text_udf

CAPACITY, END_ID = 2048, 1
#: Lengths are rounded up to this many tokens for the plan, so the plan has CAPACITY / UNIT rows at most.
UNIT = 8
#: Columns that the linear program may enter; it warns if it ends there, with a plan that is whole but not the best.
MAX_COLUMNS = 20_000
#: Fixed value: how byte-level vocabularies cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Ids:
    """The ids that a tokenizers byte-level BPE file gives, little-endian 32-bit.

    tiktoken, with the file's own vocabulary as ranks, encodes ordinary text
    several times faster; a text that holds an added token's string, or that
    tiktoken's pattern search refuses (hundreds of thousands of spaces in a row
    outgrow its stack), goes to the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.added}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ask(self, text: str) -> list[int]:
        if self.tokenizer is None:  # rarely needed, and large
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def of(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return np.array(self._ask(text), "<u4").tobytes()
        try:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            ids = self._ask(text)
        return np.asarray(ids, "<u4").tobytes()


_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def cut(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: whole sequences and one rest of each row of ``docs``."""
    def row(t, ids):
        made = ids.of(t or "") + END_ID.to_bytes(4, "little")
        return len(made) // 4, [zlib.crc32(made[i:i + 4 * capacity]) for i in range(0, len(made), 4 * capacity)]

    made = text_udf("doc_tokens:long,crcs:array<long>", row, lambda: ids_of(path))
    start = F.col("pos").cast("long") * capacity
    return (docs.select(F.col(doc_id).alias("doc_id"), made(F.col(text)).alias("t"))
            .select("doc_id", F.col("t.doc_tokens").alias("doc_tokens"), F.posexplode("t.crcs").alias("pos", "ids_crc32"))
            .select("doc_id", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - start).alias("length"),
                    "ids_crc32", "doc_tokens"))


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of the highest price; prices[i] is that of length i, -inf if there is none."""
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        tried = value[c - 1::-1] + prices[1:c + 1]
        k = int(tried.argmax())
        if tried[k] > value[c - 1]:
            value[c], choice[c] = tried[k], k + 1
        else:
            value[c] = value[c - 1]
    pattern, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if choice[c] == 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= choice[c]
    return float(value[capacity]), pattern


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, {length: pieces in each}) for a histogram of lengths of 1 to ``capacity``."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    if not len(lengths):
        return []
    need = np.array([histogram[int(k)] for k in lengths], float)
    m = len(lengths)
    columns = [np.zeros(m) for _ in range(m)]
    for i, k in enumerate(lengths):
        columns[i][i] = capacity // k
    inverse = np.diag(1 / np.array([c[i] for i, c in enumerate(columns)]))
    x = inverse @ need
    cost = np.ones(m)  # 0 for surplus columns, which let a pattern make more than is needed
    for _ in range(MAX_COLUMNS):
        duals = cost @ inverse
        if duals.min() < -1e-9:
            entering, price = np.zeros(m), 0.0
            entering[int(duals.argmin())] = -1.0
        else:
            prices = np.full(capacity + 1, -np.inf)
            prices[lengths] = duals
            worth, pattern = best_pattern(prices, capacity)
            if worth <= 1 + 1e-7:
                break
            entering, price = pattern[lengths].astype(float), 1.0
        way = inverse @ entering
        up = way > 1e-10
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / way[up]
        r = int(ratio.argmin())
        step = ratio[r]
        x -= step * way
        x[r] = step
        np.maximum(x, 0, out=x)
        inverse[r] /= way[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(way[others], inverse[r])
        columns[r], cost[r] = entering, price
    else:
        warnings.warn(f"packing: the linear program ended after {MAX_COLUMNS} columns, short of its best plan", stacklevel=2)
    out, left = [], need.astype(np.int64)
    for n, column, price in sorted(zip(x, columns, cost), key=lambda v: -v[0]):
        if not price:
            continue
        used = np.flatnonzero(column)
        n = min(int(n + 1e-6), int((left[used] // column[used].astype(np.int64)).min()))
        if n > 0:
            out.append((n, {int(lengths[i]): int(column[i]) for i in used}))
            left[used] -= n * column[used].astype(np.int64)
    bins: list[tuple[int, dict[int, int]]] = []  # first fit, longest first
    for i in range(m - 1, -1, -1):
        k = int(lengths[i])
        for _ in range(int(left[i])):
            for b, (room, held) in enumerate(bins):
                if room >= k:
                    held[k] = held.get(k, 0) + 1
                    bins[b] = (room - k, held)
                    break
            else:
                bins.append((capacity - k, {k: 1}))
    return out + [(1, held) for _, held in bins]


def places(patterns: list[tuple[int, dict[int, int]]], histogram: dict[int, int], units: int):
    """Where the pieces of each length go: arrays (from, sequence, spread) over length offset plus rank, and the offsets."""
    offset = np.concatenate([[0], np.cumsum([histogram.get(k, 0) for k in range(units + 1)])]).astype(np.int64)
    at, base, rows = offset.copy(), 0, []
    for n, held in patterns:
        for k, copies in held.items():
            rows.append((at[k], base, n))
            at[k] += copies * n
        base += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)), offset


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    pieces = settle(cut(docs, path, doc_id, text, capacity)).withColumn("_class", F.ceil(F.col("length") / UNIT).cast("int"))
    units = capacity // UNIT
    histogram = {r[0]: r[1] for r in pieces.groupBy("_class").count().collect()}  # at most ``units`` rows
    if not histogram:
        return pieces.drop("_class").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    (starts, sequence, spread), offset = places(plan(histogram, units), histogram, units)

    @F.arrow_udf("long")
    def sequence_of(kind: pa.Array, rank: pa.Array) -> pa.Array:
        g = offset[kind.to_numpy(zero_copy_only=False)] + rank.to_numpy(zero_copy_only=False)
        i = np.searchsorted(starts, g, "right") - 1
        return pa.array(sequence[i] + (g - starts[i]) % spread[i])

    ranked = rank_within(pieces, ["_class"], ["doc_id", "start", "ids_crc32"], "_rank", rows=sum(histogram.values()))
    before = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "_rank").rowsBetween(W.unboundedPreceding, -1)
    return (ranked.withColumn("sequence_id", sequence_of("_class", "_rank"))
            .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
