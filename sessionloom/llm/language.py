"""Language identification by compression.

Each language has a zstandard dictionary of raw text.  A text is folded (letters
in lower case, ASCII signs and digits to spaces), cut into blocks, and each block
is compressed with every dictionary; the language whose total is the smallest
wins.  Blocks keep a long text from explaining itself, so that each part of it is
held against the dictionaries.  Whole compressed bytes don't tell texts of a few
words apart: under SHORT bytes the cost is a code length instead, the bits that
an ideal coder with the dictionary's bytes and their contexts would need.  The
score is the share by which the best total undercuts the second; narrow scores
can be rejected.

Null text and text without a letter are ``und`` with score 0.  Equal totals go to
the language first in order.  A table without labelled rows learns nothing, and
then all is ``und``.
"""

from __future__ import annotations

import math
import zlib
import warnings
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_udf

#: Bounds of the labelled sample that the dictionaries are made of: rows a language, bytes a row and a dictionary, languages.
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES, MAX_LANGUAGES = 400, 8192, 112_640, 64
BLOCK, LEVEL = 4096, 9
#: Folded texts under so many bytes are judged by code length, from contexts of fewer than CONTEXT bytes.
SHORT, CONTEXT = 128, 3
#: Scores under this are rejected where a verdict is asked for.
MARGIN = 0.01
UNKNOWN = "und"
_FOLD = bytes(32 if i < 128 and not chr(i).isalpha() else i for i in range(256))


def fold(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


def sample_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """At most SAMPLE_ROWS labelled rows a language, chosen by a hash of the id, those of 64 to SAMPLE_BYTES bytes first.

    Of more than MAX_LANGUAGES labels those with the most rows are taken, with a
    warning.  Rows without an id aren't learned from; rows that repeat one count
    once.  Rows are counted first, so that only those whose hash is small enough
    for a few times SAMPLE_ROWS are ranked: no task ranks a whole language."""
    key = F.xxhash64(F.col("doc_id"), F.lit(7))
    rows = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
            .where("doc_id is not null and lang is not null and text is not null"))
    keys = rows.select("lang", "doc_id", (~F.octet_length("text").between(64, SAMPLE_BYTES)).alias("odd"), key.alias("key"))
    counts = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("odd").alias("n_odd")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        warnings.warn(f"language: only the {MAX_LANGUAGES} most frequent labels are learned", stacklevel=2)
    shares = [(r["lang"], odd, min(1.0, 4 * SAMPLE_ROWS / n)) for r in counts[:MAX_LANGUAGES]
              for odd, n in ((True, r["n_odd"]), (False, r["n"] - r["n_odd"])) if n]
    if not shares:
        return rows.where("false")
    least = F.array(*[F.struct(F.lit(k).alias("lang"), F.lit(odd).alias("odd"), F.lit(int(2**63 * (2 * p - 1)) if p < 1 else 2**63 - 1).alias("top")) for k, odd, p in shares])
    bounds = docs.sparkSession.range(1).select(F.inline(least))  # two rows a language
    order = W.partitionBy("lang").orderBy("odd", "key", "doc_id")
    chosen = (keys.join(F.broadcast(bounds), ["lang", "odd"]).where("key <= top").withColumn("_r", F.row_number().over(order))
              .where(F.col("_r") <= SAMPLE_ROWS).select("lang", "doc_id").distinct())
    return (rows.join(F.broadcast(chosen), ["lang", "doc_id"])  # SAMPLE_ROWS a language
            .groupBy("lang", "doc_id").agg(F.min(F.left("text", F.lit(SAMPLE_BYTES))).alias("text")).select("doc_id", "text", "lang"))


def _dictionary(rows: pa.Table) -> pa.Table:
    """The raw dictionary of one language's sample."""
    found = {(zlib.crc32(str(doc_id).encode()), fold(text)) for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist())}
    parts, size = [], 0
    for _, part in sorted(found):
        if size >= DICT_BYTES:
            break
        parts.append(part)
        size += len(part) + 1
    return pa.table({"lang": [rows.column("lang")[0].as_py()], "raw": pa.array([b" ".join(parts)[:DICT_BYTES]], pa.binary())})


def learn(sample: DataFrame) -> dict[str, bytes]:
    """Language -> raw dictionary, made in tasks, a language each; the sample is bounded, as ``sample_of`` says.

    The driver gets DICT_BYTES a language."""
    made = sample.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang").groupBy("lang").applyInArrow(_dictionary, "lang string, raw binary")
    return {lang: bytes(raw) for lang, raw in sorted((r["lang"], r["raw"]) for r in made.collect()) if len(raw) >= 8}


class Contexts:
    """How often each span of 1 to CONTEXT bytes occurs in a dictionary."""

    def __init__(self, raw: bytes):
        self.length = len(raw)
        self.counts = [Counter(raw[i:i + n] for i in range(len(raw) - n + 1)) for n in range(1, CONTEXT + 1)]

    def bits(self, folded: bytes) -> float:
        """The code length of a text between spaces; each context's guess is mixed with that of the next shorter one."""
        text, out = b" " + folded + b" ", 0.0
        for i in range(1, len(text)):
            p = 1 / 256
            for n in range(min(CONTEXT, i + 1)):
                seen = self.counts[n - 1][text[i - n:i]] if n else self.length
                p = (self.counts[n][text[i - n:i + 1]] + 4 * p) / (seen + 4)
            out -= math.log2(p)
        return out


_made: dict[int, list] = {}


def _coders(model: dict[str, bytes]) -> list:
    key = hash(tuple(model.items()))
    if key not in _made:
        _made.clear()
        for lang, raw in model.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            _made.setdefault(key, []).append((lang, zstandard.ZstdCompressor(
                level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False), Contexts(raw)))
    return _made.get(key, [])


def classify(text: str | None, coders: list) -> tuple[str, float]:
    if not text or not coders or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    folded = fold(text)
    if len(folded) < SHORT:
        totals = sorted((contexts.bits(folded), k) for k, (_, _, contexts) in enumerate(coders))
    else:
        blocks = [folded[i:i + BLOCK] for i in range(0, len(folded), BLOCK)]
        totals = sorted((sum(len(c.compress(b)) for b in blocks), k) for k, (_, c, _) in enumerate(coders))
    best = totals[0]
    margin = 1.0 - best[0] / totals[1][0] if len(totals) > 1 else 1.0
    return coders[best[1]][0], margin


def language(text: Column, model: dict[str, bytes]) -> Column:
    """struct<lang_pred:string,score:double> for a text column; the model is a few hundred KB."""
    return text_udf("lang_pred:string,score:double", classify, lambda: _coders(model))(text)


def identify(docs: DataFrame, model: dict[str, bytes], doc_id: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score and ``accepted`` (a language whose margin isn't too narrow) for each row; other columns aren't carried."""
    return (docs.select(F.col(doc_id).alias("doc_id"), language(F.col(text), model).alias("l")).select("doc_id", "l.*")
            .withColumn("accepted", is_clear(F.col("lang_pred"), F.col("score"), margin)))


def is_clear(lang_pred: Column, score: Column, margin: float = MARGIN) -> Column:
    """False for rejected texts: no language, or a margin that is too narrow."""
    return (lang_pred != UNKNOWN) & (score >= margin)


def keep_known(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is clear."""
    found = language(F.col(text), model)
    return docs.where(is_clear(found.getField("lang_pred"), found.getField("score"), margin))
