"""Byte-pair encoding with a priority queue, and decoding by concatenation.

A text is cut into chunks at white space; normal form, lower case and the split
into pieces never look past a chunk, so chunks are encoded one by one and kept
in a bounded memory of recent ones.  A piece is a doubly linked list of symbols; a heap holds
the rank of every mergeable neighbour pair; the lowest rank is merged first, and
entries whose symbols have changed meanwhile are skipped.  Decoding joins the
vocabulary's strings, as the vocabulary's own decoder settings say.

Python's tables of letters, of lower case and of normal forms are of other
Unicode versions than the tokenizers library's.  Each code point beyond ASCII is
held against the library's once per worker; a chunk with one that differs is
normalized and split by the library itself, and merged here.

Null text is empty text: no ids.  Strings of added tokens in a text become
their ids before anything else is done to it.  A vocabulary file with settings
that this module doesn't follow is refused.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import text_udf

#: Chunks kept by a worker; twice as many at most.
REMEMBERED = 250_000
#: White space of the vocabulary's patterns; Python's str.split also cuts at \x1c-\x1f.
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_PY_ONLY = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return [chr(b if b in plain else next(more)) for b in range(256)]


def _parts(spec: dict | None, name: str) -> list[dict]:
    """The members of a sequence in a vocabulary file, or the one thing there is."""
    return spec[name] if spec and spec["type"] == "Sequence" else [spec] if spec else []


def _refuse(spec: dict, path: str) -> None:
    """An error for settings of a vocabulary file that ``Encoder`` doesn't follow."""
    model = spec["model"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k["type"] for k in _parts(spec["normalizer"], "normalizers")
            if k["type"] not in ("NFC", "Lowercase") and (k["type"], k.get("pattern"), k.get("content")) != ("Replace", {"Regex": r"\s+"}, " ")]
    before = _parts(spec["pre_tokenizer"], "pretokenizers")
    if [k["type"] for k in before] != ["Split", "ByteLevel"] or before[0]["behavior"] != "Removed" or not before[0]["invert"] \
            or before[1].get("add_prefix_space") or before[1].get("use_regex"):
        odd.append("pre_tokenizer")
    odd += [t["content"] for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
    odd += [k for k in ("decoder", "post_processor") if spec.get(k)]
    if model["type"] != "BPE" or odd:
        raise ValueError(f"{path} has settings that aren't followed here: {model['type']} {odd}")


class Encoder:
    """Encodes with the vocabulary file of a tokenizers BPE model with byte-level letters and word ends."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        _refuse(spec, path)
        self.strings = {i: s for s, i in [*self.vocab.items(), *added.items()]}
        self.added = added
        self.added_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        kinds = _parts(spec["normalizer"], "normalizers")
        self.nfc = any(k["type"] == "NFC" for k in kinds)
        self.lower = any(k["type"] == "Lowercase" for k in kinds)
        split = next(p for p in _parts(spec["pre_tokenizer"], "pretokenizers") if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.added_starts = tuple({s[0] for s in added})
        self.library = normalizers.Sequence([normalizers.NFC()] * self.nfc + [normalizers.Lowercase()] * self.lower)
        self.library_split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        #: Code points that this process and the library see alike.
        self.alike = set(map(chr, range(128)))
        letters = byte_letters()
        self.first = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.end) for c in letters]
        if None in self.first or None in self.last:
            raise ValueError(f"{path} lacks a letter for some byte")
        #: (left id, right id) in one number -> rank; the rank -> id of both together
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(self.vocab[a] << 20 | self.vocab[b], rank)
            self.made.append(self.vocab[a + b])
        top = max(self.strings) + 1
        self.shown = [self.strings.get(i, "") for i in range(top)]
        self.digits = [str(i) for i in range(top)]
        self.limit = remembered
        self.recent: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.words: dict[str, tuple[str, str]] = {}
        self.old_words: dict[str, tuple[str, str]] = {}

    def _sees_alike(self, c: str) -> bool:
        """Whether the library normalizes a code point and splits around it as this process does."""
        if "\ud800" <= c <= "\udfff":
            return True  # never in a text that Spark holds
        if unicodedata.category(c) == "Cn" or self.library.normalize_str(c) != self._normal(c):
            return False
        around = [f"{x}{c}{x}" for x in "a1!"]
        return all([p for p, _ in self.library_split.pre_tokenize_str(s)] == self.pieces.findall(s) for s in around)

    def _odd(self, chunk: str) -> bool:
        """Whether a chunk has a code point that the library sees otherwise."""
        for c in set(chunk) - self.alike:
            if not self._sees_alike(c):
                return True
            self.alike.add(c)
        return False

    def _normal(self, chunk: str) -> str:
        low = unicodedata.normalize("NFC", chunk) if self.nfc and not chunk.isascii() else chunk
        if self.lower:
            # letter by letter if need be: str.lower() has a rule for sigma at a word's end
            low = "".join(map(str.lower, low)) if "Σ" in low else low.lower()
        return low

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece."""
        raw = piece.encode("utf-8", "replace")
        n = len(raw)
        first, get, made = self.first, self.ranks.get, self.made
        ids = [first[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        # ranks[i]: of the pair that starts at symbol i, -1 if it has none
        ranks = [get(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]
        heap = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        if not heap:
            return ids
        ranks.append(-1)
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            x = heappop(heap)
            i = x & 0xFFFFFFFF
            r = x >> 32
            if ranks[i] != r:  # stale: the pair that was queued isn't there any more
                continue
            j = after[i]
            new = ids[i] = made[r]
            ids[j] = ranks[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                q = ranks[i] = get(new << 20 | ids[k], -1)
                if q >= 0:
                    heappush(heap, q << 32 | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                q = ranks[h] = get(ids[h] << 20 | new, -1)
                if q >= 0:
                    heappush(heap, q << 32 | h)
        return [x for x in ids if x >= 0]

    def _word(self, piece: str) -> tuple[str, str]:
        """The ids of a piece in decimal and its decoded text, both joined by spaces."""
        if (found := self.words.get(piece)) is None:
            if (found := self.old_words.get(piece)) is None:
                ids = self.merge(piece)
                digits, shown = self.digits, self.shown
                found = " ".join([digits[i] for i in ids]), " ".join([shown[i] for i in ids])
            if len(self.words) >= self.limit:
                self.old_words, self.words = self.words, {}
            if len(piece) <= 64:
                self.words[piece] = found
        return found

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """The same for a text without white space and added tokens."""
        if (found := self.older.get(chunk)) is None:
            if not chunk.isascii() and self._odd(chunk):
                pieces = [p for p, _ in self.library_split.pre_tokenize_str(self.library.normalize_str(chunk))]
            else:
                low = self._normal(chunk)
                pieces = [low] if low.isalpha() else self.pieces.findall(low)
            said = [self._word(p) for p in pieces]
            found = said[0] if len(said) == 1 else (" ".join([x[0] for x in said]), " ".join([x[1] for x in said]))
        if len(self.recent) >= self.limit:
            self.older, self.recent = self.recent, {}
        if len(chunk) <= 64:
            self.recent[chunk] = found
        return found

    def parts(self, text: str) -> list[tuple[str, str]]:
        """(ids in decimal, decoded text) of each chunk of a whole text."""
        out = []
        chunk = self._chunk
        held = self.added_pattern.split(text) if any(c in text for c in self.added_starts) else [text]
        for k, part in enumerate(held):
            if k % 2:
                out.append((str(self.added[part]), part))
                continue
            if _PY_ONLY.search(part):
                chunks = [c for c in _SPACE.split(part) if c]
            else:
                chunks = part.split()
            for c in chunks:
                out.append(self.recent.get(c) or chunk(c))
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _ in self.parts(text or "") for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, joined by spaces where the vocabulary names no decoder."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _digest(text: str | None, enc: Encoder) -> tuple[int, str, str]:
    parts = [p for p in enc.parts(text or "") if p[0]]
    ids = " ".join([p[0] for p in parts])
    decoded = " ".join([p[1] for p in parts])
    return (ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())


def encode(text: Column, path: str) -> Column:
    """struct<ids:array<long>,decoded:string> for a text column."""
    def row(t, enc):
        ids = enc.encode(t)
        return ids, enc.decode(ids)
    return text_udf("ids:array<long>,decoded:string", row, lambda: encoder(path))(text)


def digest(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs``."""
    made = text_udf("n_tokens:long,ids_sha256:string,decoded_sha256:string", _digest, lambda: encoder(path))
    return docs.select(F.col(doc_id).alias("doc_id"), made(F.col(text)).alias("b")).select("doc_id", "b.*")
