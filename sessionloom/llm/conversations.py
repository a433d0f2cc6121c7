"""Repair of conversations: faulty turns found, and the cheapest edits that give each conversation a legal order of roles.

Turns are blank (nothing but white space), duplicate (role and text seen
earlier in the conversation), truncated (the last sign ends no sentence) or
sound; the first that fits counts.  A repaired conversation has the roles
``(s?(ua)+)?``: nothing, or a system turn at most and then user and assistant in
turn.  Edits and their costs are in COSTS; a blank or duplicate turn must be
deleted, a truncated one that stays costs TRUNCATED more.

The search is depth-first branch-and-bound over (next turn, state of the roles)
with an explicit stack.  Suffix bounds say what the turns from a node on cost at
least; the incumbent (cost, audit) and a table of the best (cost, audit) seen at
each node cut off whatever is worse, until the stack is empty and the incumbent
is proved: the least cost, and of its audits the least in ASCII order.  An audit
(edits' initials) tells all roles, so that of two ways to a node with equal
costs none is the other's beginning, and the table's order is safe.  The bounds
are exact for each node, which keeps the search linear in the turns.

A conversation is one unit of work, as its order is its meaning.  The plan needs
a few bytes a turn; texts are never gathered: they pass a second time, behind
their conversation's plan, in one sorted stream.

Null roles and texts are one space, null conversation ids are one conversation,
null turns come first; turns of one number are ordered by role, then by the
hash of their text.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COSTS = {"D": 4, "I": 3, "K": 0, "R": 3}
TRUNCATED = 3
SOUND, BLANK, DUPLICATE, CUT = range(4)

#: States of the roles told so far: nothing, system, user, assistant; what a made or changed turn is there, and the state behind it.
_ROLE = ("user", "user", "assistant", "user")
_NEXT = (2, 2, 3, 2)
_LEGAL = ("su", "ua", "au")

Turn = tuple[str, int]  # the role's initial and the fault


def _edits(turn: Turn, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of what may be done with a turn."""
    initial, fault = turn
    yield "D", COSTS["D"], state
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    if initial == _ROLE[state][0]:
        yield "K", COSTS["K"] + more, _NEXT[state]
    elif initial == "s" and state == 0:
        yield "K", COSTS["K"] + more, 1
    yield "R", COSTS["R"] + more, _NEXT[state]


def suffix_bounds(turns: list[Turn]) -> list[tuple[int, ...]]:
    """For each place and state, what the turns from there on cost at least."""
    def with_inserts(b: list[int]) -> tuple[int, ...]:
        user, assistant = min(b[2], COSTS["I"] + b[3]), min(b[3], COSTS["I"] + b[2])
        return min(b[0], COSTS["I"] + user), min(b[1], COSTS["I"] + user), user, assistant

    never = 1 << 60
    out = [with_inserts([0, never, never, 0])]
    for turn in reversed(turns):
        after = out[-1]
        out.append(with_inserts([min(cost + after[to] for _, cost, to in _edits(turn, state)) for state in range(4)]))
    out.reverse()
    return out


def cheapest(turns: list[Turn]) -> tuple[int, str]:
    """Least cost and, of its audits, the least in ASCII order."""
    n, bounds = len(turns), suffix_bounds(turns)
    parent, letters, depth = [-1], [""], [0]
    table: dict[tuple[int, int], tuple[int, int]] = {}
    best_cost, best = 1 << 60, -1
    on_best: dict[int, str] = {}  # a node on the incumbent's way, and the letter behind it

    def before(a: int, b: int) -> bool:
        """Whether the audit of node a is less than that of node b."""
        last_a = last_b = ""
        while a != b:
            if depth[a] >= depth[b]:
                last_a, a = letters[a], parent[a]
            else:
                last_b, b = letters[b], parent[b]
        return last_a < last_b

    def misses_best(a: int) -> bool:
        """Whether the audit of node a leaves the incumbent's for a greater one."""
        while parent[a] not in on_best:
            a = parent[a]
        return letters[a] > on_best[parent[a]]

    stack = [(0, 0, 0, -1, "")]
    while stack:
        i, state, cost, up, letter = stack.pop()
        bound = cost + bounds[i][state]
        if bound > best_cost:
            continue
        node = 0
        if up >= 0:
            node = len(parent)
            parent.append(up)
            letters.append(letter)
            depth.append(depth[up] + 1)
        held = table.get((i, state))
        worse = held is not None and (held[0] < cost or (held[0] == cost and not before(node, held[1])))
        if worse or (bound == best_cost and node and misses_best(node)):
            parent.pop()
            letters.pop()
            depth.pop()
            continue
        table[i, state] = cost, node
        if i == n and state in (0, 3) and (cost < best_cost or before(node, best)):
            best_cost, best, on_best = cost, node, {}
            at = node
            while at:
                on_best[parent[at]] = letters[at]
                at = parent[at]
        ways = [(i, _NEXT[state], cost + COSTS["I"], node, "I")]
        if i < n:
            ways += [(i + 1, to, cost + more, node, letter) for letter, more, to in _edits(turns[i], state)]
        ways = [w for w in ways if w[2] + bounds[w[0]][w[1]] <= best_cost]
        stack += sorted(ways, key=lambda w: (w[2] + bounds[w[0]][w[1]], w[4]), reverse=True)
    audit = []
    while best > 0:
        audit.append(letters[best])
        best = parent[best]
    return best_cost, "".join(reversed(audit))


# --- rows ------------------------------------------------------------------------------------------------------------

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_WHITE = " \t\n\x0b\x0c\r"
_ORDER = ("turn", "role", "digest")


def _told(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def _turns(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """The columns that are read, under names of this module's own."""
    return rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), _told(role).alias("role"), _told(text).alias("text")).withColumn(
        "digest", F.sha2(F.col("text").cast("binary"), 256))


def _columns(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


class _Told:
    """What is known of the conversation that the stream is in."""

    def __init__(self, conv):
        self.conv, self.turns, self.seen, self.counts = conv, [], set(), [0] * 4
        self.first = self.last = None
        self.numbers = self.illegal = 0

    def add(self, turn, role: str, digest: str, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.numbers = turn, self.numbers + 1
        same = hashlib.sha256(f"{digest}{role}".encode("utf-8", "surrogatepass")).digest()
        fault = BLANK if blank else DUPLICATE if same in self.seen else CUT if cut else SOUND
        self.seen.add(same)
        self.counts[fault] += 1
        if self.turns and self.turns[-1][0] + role[:1] not in _LEGAL:
            self.illegal += 1
        self.turns.append((role[:1], fault))

    def report(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.numbers
        cost, audit = cheapest(self.turns)
        return (self.conv, gaps, *self.counts[1:], self.illegal, cost, audit)


def plan_repairs(rows: DataFrame, conversations: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: gaps in the numbers of turns, turns of each fault, illegal neighbours, and the cost and audit of its repair.

    ``conversations``, if given, has ids (``conv_id``) that are reported even where no turn is left."""
    t = _turns(rows, conv_id, turn, role, text)
    end = F.rtrim(F.col("text"), F.lit(_WHITE))
    facts = t.select("conv_id", "turn", "role", "digest", (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    if conversations is not None:
        ids = conversations.select(F.col(conv_id).alias("conv_id")).distinct()
        facts = facts.unionByName(ids, allowMissingColumns=True)  # a row without a role is no turn
    names = ("conv_id", "turn", "role", "digest", "blank", "cut")
    kind = t.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(n, T.LongType()) for n in _COUNTS], T.StructField("audit", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def first() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types.setdefault("conv_id", batch.schema.field("conv_id").type)
                yield batch

        types: dict = {}
        out: list[tuple] = []
        at = None
        for conv, *rest in _columns(first(), names):
            if at is None or conv != at.conv:
                if at is not None:
                    out.append(at.report())
                at = _Told(conv)
            if rest[1] is not None:
                at.add(*rest)
            if len(out) >= 1000:
                yield _batch(out, types["conv_id"])
                out = []
        if at is not None:
            yield _batch([*out, at.report()], types["conv_id"])

    return facts.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER).mapInArrow(each, schema)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
    columns = list(zip(*rows))
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"][:len(columns)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _behind_plans(rows: DataFrame, plans: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One sorted stream of each conversation's plan and, behind it, its turns."""
    t = _turns(rows, *names).withColumn("part", F.lit(1))
    both = plans.withColumn("part", F.lit(0)).unionByName(t, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "part", *_ORDER)


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(None, plan) where a conversation begins, then (edit, role, text) of each of its repaired turns.  rows: (plan or None, role, text)."""
    audit, p, state = "", 0, 0

    def made() -> Iterator[tuple]:
        nonlocal p, state
        while p < len(audit) and audit[p] == "I":
            yield "I", _ROLE[state], ""
            p, state = p + 1, _NEXT[state]

    for plan, role, text in rows:
        if plan is not None:
            yield from made()
            audit, p, state = plan[-1], 0, 0
            yield None, plan, None
            continue
        yield from made()
        edit, p = audit[p], p + 1
        if edit == "D":
            continue
        system = edit == "K" and state == 0 and role[:1] == "s"
        yield edit, role if edit == "K" else _ROLE[state], text
        state = 1 if system else _NEXT[state]
    yield from made()


def _stream(batches: Iterator[pa.RecordBatch], types: dict) -> Iterator[tuple]:
    for batch in batches:
        types.setdefault("conv_id", batch.schema.field("conv_id").type)
        told = zip(*[batch.column(n).to_pylist() for n in ("conv_id", *_COUNTS, "audit")])
        for plan, part, role, text in zip(told, *[batch.column(n).to_pylist() for n in ("part", "role", "text")]):
            yield (None if part else plan), role, text


def repair(rows: DataFrame, conversations: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns: conv_id, position (from 0), edit (K, R or I), role and text; conversations of which nothing is left have none."""
    names = (conv_id, turn, role, text)
    plans = plan_repairs(rows, conversations, *names)
    schema = T.StructType([plans.schema["conv_id"], T.StructField("position", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("edit", "role", "text")]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict = {}
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            kinds = [types["conv_id"], pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["conv_id", "position", "edit", "role", "text"])

        conv, position = None, 0
        for edit, who, said in _repaired(_stream(batches, types)):
            if edit is None:
                conv, position = who[0], 0
                continue
            out.append((conv, position, edit, who, said))
            position, size = position + 1, size + len(said)
            if len(out) >= 1000 or size > 1 << 22:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return _behind_plans(rows, plans, names).mapInArrow(each, schema)


def repair_digest(rows: DataFrame, conversations: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The plans, with the SHA-256 of the repaired ``role:text`` lines, made of the same stream as ``repair`` without storing it."""
    names = (conv_id, turn, role, text)
    plans = plan_repairs(rows, conversations, *names)
    schema = T.StructType([*plans.schema, T.StructField("repaired_sha256", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict = {}
        out: list[tuple] = []
        plan, sha, empty = None, hashlib.sha256(), True
        for edit, who, said in _repaired(_stream(batches, types)):
            if edit is None:
                if plan is not None:
                    out.append((*plan, sha.hexdigest()))
                plan, sha, empty = who, hashlib.sha256(), True
                if len(out) >= 1000:
                    yield _batch(out, types["conv_id"])
                    out = []
                continue
            sha.update(f"{'' if empty else chr(10)}{who}:{said}".encode("utf-8", "surrogatepass"))
            empty = False
        if plan is not None:
            yield _batch([*out, (*plan, sha.hexdigest())], types["conv_id"])

    return _behind_plans(rows, plans, names).mapInArrow(each, schema)
