"""Personal data: candidate spans, boosted trees and calibrated thresholds.

Generators of high recall propose spans, which may overlap: exact formats (the
base spans, which stay) and looser ones.  Gradient-boosted trees score each
looser candidate by its format and its surroundings; a threshold for each kind,
calibrated on held-out examples to a wanted precision, selects; of overlapping
selections the best score stays.  The trees are trained on examples that a
seeded rule writes, TRAIN_EXAMPLES of them; an example is a sentence with all
its candidates.

Null text is an empty text without spans.  Positions are code points, ends
exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_udf

KINDS = ("email", "ip", "card", "phone")
TRAIN_EXAMPLES, PRECISION = 6000, 0.98
TREES, DEPTH, BINS, RATE = 60, 4, 16, 0.3

SCHEMA = "n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string,n_candidates:long"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that starts inside a run of digits would have to match from its start too.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The exact formats: leftmost, non-overlapping for each kind."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    if "." in text:
        for m in _IP.finditer(text):
            if all(_small(p) for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# Looser generators.  None takes more than linear time, as stretches are bounded by the formats themselves: a local part has 64
# characters and a label 63 at most, a name no more than five labels, a card or phone number 19 digits.  What is longer is
# in the base formats only.
_AT_WORD = r"[(\[] ?at ?[)\]]"
_AT = rf"(?:@| ?{_AT_WORD} ?)"
_DOT = r"(?:\.| ?[(\[] ?dot ?[)\]] ?)"
_SOME_AT = re.compile(_AT_WORD, re.I)
_LOOSE_EMAIL = re.compile(rf"(?<![\w.+-])[\w.%+-]{{1,64}}{_AT}[\w-]{{1,63}}(?:{_DOT}[\w-]{{2,63}}){{1,4}}", re.I)
_LOOSE_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?: ?[.\[(]{1,2}(?:dot)?[.\])]{0,2} ?[0-9]{1,3}){3}(?![\w]|\.[0-9])")
_DIGIT_RUN = re.compile(r"(?<![\w.,+#$-])[+(]{0,2}[0-9](?:[ ()./\-]{0,2}[0-9]){8,}(?![\w]|[.,][0-9])")
_DIGIT_GROUP = re.compile(r"[+(]{0,2}([0-9]+)")
MOST_DIGITS = 19


def candidates(text: str) -> list[Span]:
    """Spans of looser formats, with the kind that each could be; they may overlap."""
    return [*_marked(text), *(c for run in _DIGIT_RUN.finditer(text) for c in _stretches(text, run))]


def _marked(text: str) -> list[Span]:
    """E-mail and IP addresses of looser formats."""
    out: list[Span] = []
    if "@" in text or (("(" in text or "[" in text) and _SOME_AT.search(text)):
        out += [("email", m.start(), m.end()) for m in _LOOSE_EMAIL.finditer(text)]
    if "[" in text or "(" in text or "." in text:
        out += [("ip", m.start(), m.end()) for m in _LOOSE_IP.finditer(text)]
    return out


def _stretches(text: str, run: re.Match) -> Iterator[Span]:
    """Every stretch of whole groups of a run of digits: others may be close before or behind a number."""
    groups = [(g.start(), g.end(), g.end() - g.start(1)) for g in _DIGIT_GROUP.finditer(text, run.start(), run.end())]
    for i, (start, _, _) in enumerate(groups):
        n = 0
        for _, end, k in groups[i:i + MOST_DIGITS]:
            n += k
            if n > MOST_DIGITS:
                break
            if n >= 13:
                yield "card", start, end
            if 9 <= n <= 15:
                yield "phone", start, end


_CUES = [re.compile(p, re.I) for p in (
    r"phone|call|tel\b|tel[.:]|mobile|fax|dial", r"card|visa|master|credit|payment|cvv", r"\bip\b|host|server|addr",
    r"mail|contact|write to", r"version|release|build|\bv$", r"order|invoice|isbn|serial|token|\bid\b|ref|page|part|no\.|number|#|[$€£]|=\s*\"?$")]
# Groups of digits that a run continues with on either side of a stretch, and a country code before it.
_GROUP_BEFORE = re.compile(r"([0-9]{1,9})[ ()./\-]{1,2}$")
_GROUP_AFTER = re.compile(r"[ ()./\-]{1,2}([0-9]{1,9})")
_CODE_BEFORE = re.compile(r"(?:\+|(?<![0-9])00)[0-9]{1,3}[ ()./\-]{1,2}$")


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s = text[a:b]
    d = _digits(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    before, after = text[max(0, a - 24):a], text[b:b + 8]
    group_before, group_after = _GROUP_BEFORE.search(before), _GROUP_AFTER.match(text, b)
    return [KINDS.index(kind), len(s), len(d), len(groups), max(groups), min(groups), s.count("-"), s.count(" "), s.count("."),
            s.count("("), s.startswith("+"), s.startswith("00"), len(set(d)), bool(d) and luhn(d), d[:1] in ("3", "4", "5", "6"),
            all(_small(g) for g in re.findall(r"[0-9]+", s)) if d else False, "@" in s, "(" in s or "[" in s,
            len(re.split(r"[.\])\s]", s)[-1]), groups[0], groups[-1], s.count("/"),
            before[-1:].isspace() or not before, after[:1].isspace() or not after,
            len(group_before[1]) if group_before else 0, len(group_after[1]) if group_after else 0, bool(_CODE_BEFORE.search(before)),
            *[bool(c.search(before)) for c in _CUES]]


#: Runs of more characters are taken by numpy, so many groups at once: the same candidates and features, without a Python step for each.
LONG_RUN, GROUPS_AT_ONCE = 200, 1 << 14


def _before(text: str, a: int) -> list[float]:
    """The features of what stands before a number: space, the group before, a country code, cues."""
    before = text[max(0, a - 24):a]
    group = _GROUP_BEFORE.search(before)
    return [before[-1:].isspace() or not before, len(group[1]) if group else 0, bool(_CODE_BEFORE.search(before)), *[bool(c.search(before)) for c in _CUES]]


def run_blocks(text: str, run: re.Match) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The stretches of a run as arrays (start, end, features), some groups at once, kind by kind; features are those of ``features``."""
    starts, firsts, ends = array("q"), array("q"), array("q")
    for g in _DIGIT_GROUP.finditer(text, run.start(), run.end()):
        starts.append(g.start())
        firsts.append(g.start(1))
        ends.append(g.end())
    n = len(starts)
    for i0 in range(0, n, GROUPS_AT_ONCE):
        last = min(n, i0 + GROUPS_AT_ONCE)
        upto = min(n, last + MOST_DIGITS)
        a, d, e = (np.frombuffer(x, np.int64)[i0:upto] for x in (starts, firsts, ends))
        base = int(a[0])
        chars = np.frombuffer(text[base:int(e[-1])].encode("utf-32-le"), np.uint32)
        m, size = last - i0, e - d

        def count(sign: str) -> np.ndarray:
            return np.concatenate([[0], np.cumsum(chars == ord(sign), dtype=np.int32)])

        is_digit = (chars >= 48) & (chars <= 57)
        digits = chars[is_digit].astype(np.int64) - 48
        at = np.concatenate([[0], np.cumsum(size)])  # of each group, in ``digits``
        twice = 2 * digits - 9 * (digits > 4)
        odd = np.arange(len(digits)) % 2 == 1
        sums = [np.concatenate([[0], np.cumsum(np.where(odd == bool(q), twice, digits))]) for q in (0, 1)]
        mask = np.bitwise_or.reduceat(1 << digits, at[:-1])
        small = np.array([_small(text[x:y]) for x, y in zip(d.tolist(), e.tolist())])
        signs = {c: count(c) for c in "- .(/"}
        breaks = np.maximum.accumulate(np.where(np.isin(chars, [ord(c) for c in ".) "]), np.arange(len(chars)), -1))
        plus = chars[a - base] == ord("+")
        zeros = (chars[a - base] == 48) & (chars[np.minimum(a - base + 1, len(chars) - 1)] == 48)
        first_digit = digits[at[:-1]]

        # what stands before each group and behind it: by the text itself at the run's ends, where other signs are near
        gap = np.concatenate([[0], a[1:] - e[:-1]])
        before_space = np.concatenate([[False], chars[a[1:] - base - 1] == 32])
        before_group = np.where(gap >= 1, np.minimum(9, np.concatenate([[0], size[:-1]])), 0)
        lead = np.concatenate([[False], (chars[d[:-1] - base] == 48) & (chars[np.minimum(d[:-1] - base + 1, len(chars) - 1)] == 48)])
        sized = np.concatenate([[0], size[:-1]])
        before_code = (gap >= 1) & lead & (sized >= 3) & (sized <= 5)
        cues = np.zeros((len(a), len(_CUES)), bool)
        for k in range(m):
            if i0 + k and a[k] - 24 >= run.start() and not (k == 0 or i0 + k == 1):
                break
            before_space[k], before_group[k], before_code[k], *cue = _before(text, int(a[k]))
            cues[k] = cue
        after_space = np.concatenate([chars[e[:-1] - base] == 32, [False]])
        after_group = np.concatenate([np.minimum(9, size[1:]), [0]])
        if upto == n:
            behind = _GROUP_AFTER.match(text, int(e[-1]))
            after_space[-1] = text[e[-1]:e[-1] + 1].isspace() or e[-1] == len(text)
            after_group[-1] = len(behind[1]) if behind else 0

        total, most, least = np.zeros(m, np.int64), np.zeros(m, np.int64), np.full(m, 1 << 60)
        seen, all_small = np.zeros(m, np.int64), np.ones(m, bool)
        i = np.arange(m)
        for k in range(MOST_DIGITS):
            i = i[i + k < len(a)]
            j = i + k
            if not len(i):
                break
            total, most, least = total[:len(i)] + size[j], np.maximum(most[:len(i)], size[j]), np.minimum(least[:len(i)], size[j])
            seen, all_small = seen[:len(i)] | mask[j], all_small[:len(i)] & small[j]
            for kind, low, high in (("card", 13, MOST_DIGITS), ("phone", 9, 15)):
                pick = np.flatnonzero((total >= low) & (total <= high))
                if not len(pick):
                    continue
                p, q = i[pick], j[pick]
                x, y = a[p] - base, e[q] - base
                sums_of = np.where(at[q + 1] % 2 == 0, sums[0][at[q + 1]] - sums[0][at[p]], sums[1][at[q + 1]] - sums[1][at[p]])
                number = {c: signs[c][y] - signs[c][x] for c in signs}
                cut = breaks[y - 1]
                yield a[p], e[q], np.stack([
                    np.full(len(pick), KINDS.index(kind)), y - x, total[pick], np.full(len(pick), k + 1), most[pick], least[pick], number["-"], number[" "], number["."], number["("],
                    plus[p], zeros[p], np.bitwise_count(seen[pick]), sums_of % 10 == 0, (first_digit[p] >= 3) & (first_digit[p] <= 6), all_small[pick], np.zeros(len(pick)), number["("] > 0,
                    np.where(cut >= x, y - 1 - cut, y - x), size[p], size[q], number["/"], before_space[p], after_space[q], before_group[p], after_group[q], before_code[p], *cues[p].T], 1).astype(float)


def examples(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of candidates in ``n`` sentences that a seeded rule writes."""
    return _written(seed, n)[:2]


def _written(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, Span]]]:
    """The same, with the sentence and the span of each candidate."""
    r = random.Random(seed)

    def num(k: int) -> str:
        return str(r.randint(1, 9)) + "".join(str(r.randint(0, 9)) for _ in range(k - 1))

    def word(a: int = 3, b: int = 9) -> str:
        return "".join(r.choice("etaoinshrdlucmfwyp") for _ in range(r.randint(a, b)))

    def card(ok: bool = True) -> str:
        body = r.choice("3456") + num(r.choice((13, 14, 14, 14)))
        return body + next(c for c in "0123456789" if luhn(body + c) == ok)

    def cut(d: str, sep: str) -> str:
        return sep.join(d[i:i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"{a} {b} {c}",
                         f"+{r.randint(1, 99)} {a} {b} {c}", f"00{r.randint(10, 99)} {a} {b} {c}",
                         f"00{r.randint(10, 99)} {num(r.randint(2, 4))} {r.choice((num(6), f'{b} {c}', f'{num(2)} {b}'))}"))

    def ip() -> str:
        return r.choice((".", "[.]", " . ", "(.)")).join(str(r.randint(0, 255)) for _ in range(4))

    def email() -> str:
        at, dot = r.choice((("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", ".")))
        return word() + r.choice(("", ".", "_")) + word(1, 5) + at + word() + dot + r.choice(("com", "org", "net", "de"))

    made = {
        "email": (lambda: email(), lambda: r.choice((f"{word()}@{num(2)}.{num(2)}", f"x@{word(1, 2)}.{num(3)}"))),
        "ip": (lambda: ip(), lambda: r.choice((f"{num(1)}.{num(1)}.{num(1)}.{num(1)}", f"{num(3)}.{num(3)}.{num(3)}.{num(3)}", f"{r.randint(1, 31)}.{r.randint(1, 12)}.20.{num(2)}"))),
        "card": (lambda: r.choice((cut(card(), " "), cut(card(), "-"), card())), lambda: r.choice((card(False), num(13), num(16), num(19), cut(card(False), " "), f"{num(6)}/{num(8)}"))),
        "phone": (lambda: phone(), lambda: r.choice((num(10), num(12), f"{num(4)}-{num(2)}-{num(2)} {num(2)}", f"{num(5)}-{num(5)}", f"{num(3)}/{num(6)}/{num(2)}", f"19{num(2)}-20{num(2)} {num(4)}", f"978-{num(1)}-{num(4)}-{num(4)}",
                                                      " ".join(num(r.randint(1, 5)) for _ in range(r.randint(3, 9)))))),
    }
    cues = {"email": ("mail ", "contact ", ""), "ip": ("host ", "server ", "ip "), "card": ("card ", "visa ", ""), "phone": ("call ", "phone: ", "tel. ", "")}
    def close(kind: str, good: bool) -> tuple[str, str, str]:
        """What stands close before and behind a number, and another number of the kind behind that."""
        if kind not in ("card", "phone") or r.random() < 0.5:
            return "", "", ""
        if r.random() < 0.25:
            return r.choice((f"{r.randint(2, 9)} ", f"{num(4)} ", f"{num(2)}/{num(2)} ")), "", ""
        if r.random() < 0.4:
            return "", r.choice((" ", "/")), made[kind][0 if good else 1]()
        return "", r.choice((f" {r.randint(1, 12):02}/{r.randint(24, 39)}", f" {num(3)}", f" {r.randint(1, 48)}", f" ({num(3)})", f"/{num(2)}")), ""

    odd = ("version ", "order ", "invoice ", "isbn ", "serial ", "id ", "page ", "no. ", "build ", "ref ", "")
    rows, labels, places = [], [], []
    for sentence in range(n):
        kind, good = r.choice(KINDS), r.random() < 0.5
        cue = r.choice(cues[kind] if good or r.random() < 0.3 else odd)
        inner = made[kind][0 if good else 1]()
        lead, behind, other = close(kind, good)
        start = f"{word()} {word()} {cue}{lead}"
        text = f"{start}{inner}{behind}{other}{r.choice((' ', ', ', '. '))}{word()} {word()}"
        a, c = len(start), len(start + inner + behind)
        true = {(kind, a, a + len(inner)), (kind, c, c + len(other))} if good else set()
        for span in candidates(text):
            rows.append(features(text, span))
            labels.append(span in true)
            places.append((sentence, span))
    return np.array(rows, float), np.array(labels, float), places


class Boosted:
    """Gradient boosting of small regression trees on log loss, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned, score = self.binned(x), np.zeros(len(y))
        self.trees: list[list] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree: list = []
            self._grow(tree, binned, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            score += self._tree(tree, binned)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)

    def _grow(self, tree: list, x, g, h, rows, depth: int) -> int:
        """Adds a node [feature, bin, left, right] or a leaf [value]; returns its place."""
        place, gs, hs = len(tree), g[rows].sum(), h[rows].sum()
        tree.append([RATE * gs / (hs + 1)])
        best = (1e-6, None, None)
        for f in range(x.shape[1] if depth else 0):
            n = len(self.edges[f]) + 1
            gl = np.cumsum(np.bincount(x[rows, f], g[rows], n))[:-1]
            hl = np.cumsum(np.bincount(x[rows, f], h[rows], n))[:-1]
            gain = gl ** 2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs ** 2 / (hs + 1)
            gain[(hl < 1) | (hs - hl < 1)] = 0
            if len(gain) and gain.max() > best[0]:
                best = float(gain.max()), f, int(gain.argmax())
        if best[1] is not None:
            left = x[rows, best[1]] <= best[2]
            a = self._grow(tree, x, g, h, rows[left], depth - 1)
            b = self._grow(tree, x, g, h, rows[~left], depth - 1)
            tree[place] = [best[1], best[2], a, b]
        return place

    def _tree(self, tree: list, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            if len(tree[k]) == 1:
                out[rows] = tree[k][0]
            elif len(rows):
                left = x[rows, tree[k][0]] <= tree[k][1]
                todo += [(tree[k][2], rows[left]), (tree[k][3], rows[~left])]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return 1 / (1 + np.exp(-sum(self._tree(t, b) for t in self.trees)))


def train(seed: int = 17) -> tuple[Boosted, list[float]]:
    """The trees, and for each kind the least threshold with PRECISION on examples that they weren't trained on.

    Of overlapping candidates only the best counts, as in ``find``.
    """
    trees = Boosted(*examples(seed, TRAIN_EXAMPLES))
    x, y, places = _written(seed + 1, TRAIN_EXAMPLES // 2)
    p, kind, thresholds = trees.predict(x), x[:, 0], []
    best: dict[int, list[int]] = {}
    for i in np.argsort(-p, kind="stable"):
        sentence, (_, a, b) = places[i]
        if not any(places[j][1][1] < b and a < places[j][1][2] for j in best.setdefault(sentence, [])):
            best[sentence].append(int(i))
    stay = np.zeros(len(p), bool)
    stay[[i for held in best.values() for i in held]] = True
    for k in range(len(KINDS)):
        ok = [t for t in np.arange(0.5, 0.995, 0.01) if (hit := stay & (kind == k) & (p >= t)).any() and y[hit].mean() >= PRECISION]
        thresholds.append(float(min(ok, default=1.0)))
    return trees, thresholds


def find(text: str | None, model: tuple[Boosted, list[float]]) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans (both by start, then kind), and the number of looser candidates."""
    text = text or ""
    base = base_spans(text)
    order = {k: i for i, k in enumerate(KINDS)}

    def key(s: Span):
        return s[1], order[s[0]], s[2]

    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = bytes([1]) * (b - a)
    loose, runs = _marked(text), []
    for run in _DIGIT_RUN.finditer(text):
        if run.end() - run.start() > LONG_RUN:
            runs.append(run)
        else:
            loose += _stretches(text, run)
    loose = [c for c in loose if 1 not in taken[c[1]:c[2]]]
    n, (trees, thresholds) = len(loose), model
    good: list[tuple[float, Span]] = []
    if loose:
        scores = trees.predict(np.array([features(text, c) for c in loose], float))
        good = [(float(p), c) for p, c in zip(scores, loose) if p >= thresholds[order[c[0]]]]
    before = np.concatenate([[0], np.cumsum(np.frombuffer(taken, np.uint8), dtype=np.int32)]) if runs and base else None
    for run in runs:
        for start, end, x in run_blocks(text, run):
            if before is not None:
                free = before[end] == before[start]
                start, end, x = start[free], end[free], x[free]
            n += len(start)
            if len(start):
                kind = int(x[0, 0])
                _, one, same = np.unique(x.astype(np.int64) @ _MIX, return_index=True, return_inverse=True)  # like stretches are scored once
                p = trees.predict(x[one])[same]
                good += [(float(p[k]), (KINDS[kind], int(start[k]), int(end[k]))) for k in np.flatnonzero(p >= thresholds[kind])]
    chosen: list[Span] = []
    for _, c in sorted(good, key=lambda v: (-v[0], key(v[1]))):
        if 1 not in taken[c[1]:c[2]]:
            chosen.append(c)
            taken[c[1]:c[2]] = bytes([1]) * (c[2] - c[1])
    return sorted(base, key=key), sorted(base + chosen, key=key), n


#: Tells rows of features, which are whole numbers, apart by 64 bits.
_MIX = np.random.default_rng(1).integers(1, 1 << 62, 27 + len(_CUES))


def _told(spans: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def _row(text: str | None, model) -> tuple:
    base, every, n = find(text, model)
    return (*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(_told(base).encode()).hexdigest(), _told(every), n)


_models: dict[int, tuple] = {}


def _model(seed: int = 17) -> tuple:
    if seed not in _models:
        _models[seed] = train(seed)
    return _models[seed]


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the columns of SCHEMA for each row."""
    model = _model()
    made = text_udf(SCHEMA, _row, lambda: model)
    return docs.select(F.col(doc_id).alias("doc_id"), made(F.col(text)).alias("p")).select("doc_id", "p.*")


def redact(text: str | None, model) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    if not text:
        return text
    merged: list[list] = []
    for k, a, b in find(text, model)[1]:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([k, a, b])
    for k, a, b in reversed(merged):
        text = f"{text[:a]}[{k.upper()}]{text[b:]}"
    return text


def redacted(text: Column) -> Column:
    """A text column without its personal data."""
    model = _model()
    return text_udf("text:string", lambda t, m: (redact(t, m),), lambda: model)(text).getField("text")
