"""Quality rules: how much of a text lies inside repeated n-grams and lines.

Words are hashed once; hashes of 2, 3, ... words roll on from those of one word
less.  Sorting the hashes of one length shows which n-grams occur twice or more;
a word is covered if any such n-gram holds it, and coverage is measured in
characters of covered words against characters of all words.  Lengths are tried
upwards and the search ends at the first length without a repeat, since no
longer n-gram can repeat then.

A text of null, or without words, has no words and fails the base rule.  Every
row gives one row; order and repeated rows don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_udf

#: Largest share of a text's word characters inside repeated n-grams of so many words.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of a text's word characters in lines that occur twice or more.
LINE_LIMIT = 0.20
MIN_WORDS = 50
BASE_WINDOW = 3
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = ("n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,"
          "base_failed:boolean,kept:boolean,dup_line_chars:long,dup_ngram_chars:array<long>")


def covered(hashes: np.ndarray, n: int) -> np.ndarray | None:
    """Which words lie in an n-gram (given by the hash at its first word) found twice or more; None if none do."""
    if len(hashes) < 2:
        return None
    s = np.sort(hashes)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return None
    at = np.searchsorted(twice, hashes)
    at[at == len(twice)] = 0
    starts = twice[at] == hashes
    edges = np.zeros(len(hashes) + n, np.int32)
    edges[:len(hashes)] += starts
    edges[n:] -= starts
    return np.cumsum(edges)[:len(hashes) + n - 1] > 0


def measure(text: str | None, limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # at ASCII white space only
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))

    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    dup_line_chars = 0
    if len(seen) < len(lines):
        dup_line_chars = sum(k * (len(x) - sum(map(x.count, SPACES))) for x, k in seen.items() if k > 1)

    n_repeat, dup_chars, lengths = 0, [0] * len(limits), None
    top = max(BASE_WINDOW, *limits) if limits else BASE_WINDOW
    rolled = one = np.fromiter(map(hash, words), np.int64, n_words).view(np.uint64)
    for n in range(2, top + 1):
        if len(rolled) < 2:
            break
        rolled = rolled[:-1] * _BASE + one[n - 1:]
        if n != BASE_WINDOW and n not in limits:
            continue
        inside = covered(rolled, n)
        if inside is None:
            break
        if n == BASE_WINDOW:
            n_repeat = int(inside.sum())
        if n in limits:
            if lengths is None:
                lengths = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n_words)
            dup_chars[list(limits).index(n)] = int(lengths[inside].sum())

    base_failed = n_words < MIN_WORDS or 100 * n_repeat > 50 * n_words
    kept = not base_failed and dup_line_chars <= line_limit * word_chars and all(
        c <= most * word_chars for c, most in zip(dup_chars, limits.values()))
    return (n_words, word_chars, n_symbols, len(lines) - len(seen), n_repeat, base_failed, kept,
            dup_line_chars, dup_chars)


def quality(text: Column, limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> Column:
    """A struct of ``SCHEMA`` for a text column."""
    return text_udf(SCHEMA, lambda t: measure(t, limits, line_limit))(text)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row with the id and the columns of ``SCHEMA`` for each row of ``docs``; other columns aren't carried."""
    return (docs.select(F.col(doc_id).alias("doc_id"), quality(F.col(text)).alias("q"))
            .select("doc_id", "q.*"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text the rules keep."""
    return docs.where(quality(F.col(text)).getField("kept"))
