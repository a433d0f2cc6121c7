"""Conversation repair, whitening and toxicity against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import conversations, queries, toxicity, whitening
from sessionloom.llm.common import table

SF = "/root/testdata/sf0.01"


# --- conversations ---------------------------------------------------------------------------------------------------

LEGAL = re.compile(r"(s?(ua)+)?")


def plain_repair(turns):
    """All sequences of edits, kept apart by what they gave: the least (cost, audit) whose roles are legal.  turns: (role, text, fault)."""
    states = {"": (0, "", [])}  # roles so far -> cost, audit, output; the pattern looks at the last role and whether there was one

    def key(roles):
        return roles[:1] + roles[-1:] if len(roles) > 1 else roles

    def better(into, roles, value):
        k = key(roles)
        if k not in into or value[:2] < into[k][:2]:
            into[k] = value

    def fits(roles):
        return LEGAL.fullmatch(roles) or LEGAL.fullmatch(roles + "a") or LEGAL.fullmatch(roles + "ua")

    def inserts(have):
        for _ in range(3):
            for cost, audit, out in list(have.values()):
                for role in ("user", "assistant"):
                    told = "".join(r[:1] for r, _ in out) + role[0]
                    if fits(told):
                        better(have, told, (cost + 3, audit + "I", [*out, (role, "")]))
        return have

    states = inserts(states)
    for role, text, fault in turns:
        after = {}
        for cost, audit, out in states.values():
            told = "".join(r[:1] for r, _ in out)
            better(after, told, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if fits(told + role[:1]) and role[:1]:
                better(after, told + role[:1], (cost + more, audit + "K", [*out, (role, text)]))
            for new in ("user", "assistant"):
                if fits(told + new[0]):
                    better(after, told + new[0], (cost + 3 + more, audit + "R", [*out, (new, text)]))
        states = inserts(after)
    return min(v for v in states.values() if LEGAL.fullmatch("".join(r[:1] for r, _ in v[2])))


def every_sequence(turns):
    """The same by listing every sequence of edits with few inserts."""
    best = None
    n = len(turns)
    for inserts in itertools.product(range(3), repeat=n + 1):
        if sum(inserts) > 3:
            continue
        for edits in itertools.product("DKR", repeat=n):
            audit = "".join("I" * k + e for k, e in zip(inserts, (*edits, "")))
            for news in itertools.product("ua", repeat=audit.count("R") + audit.count("I")):
                new, i, cost, roles, bad = iter(news), 0, 0, "", False
                for e in audit:
                    if e == "I":
                        cost, roles = cost + 3, roles + next(new)
                        continue
                    initial, fault = turns[i]
                    i += 1
                    if e == "D":
                        cost += 4
                    else:
                        bad |= fault in (1, 2)
                        cost += 3 * (e == "R") + 3 * (fault == 3)
                        roles += next(new) if e == "R" else initial
                if not bad and LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def test_search_against_every_sequence():
    r = random.Random(5)
    for _ in range(60):
        turns = [(r.choice("uaust"), r.choice((0, 0, 0, 1, 2, 3))) for _ in range(r.randint(0, 3))]
        assert conversations.cheapest(turns) == every_sequence(turns), turns


def test_search_against_plain_version():
    r, faults = random.Random(6), (None, "blank", "duplicate", "truncated")
    for _ in range(400):
        turns = [(r.choice(("user", "assistant", "user", "system", "tool", "")), "x", r.choice((0, 0, 0, 0, 1, 2, 3))) for _ in range(r.randint(0, 14))]
        cost, audit, _ = plain_repair([(a, b, faults[f]) for a, b, f in turns])
        assert conversations.cheapest([(a[:1], f) for a, _, f in turns]) == (cost, audit), turns


def test_search_is_linear():
    r = random.Random(7)
    turns = [(r.choice("uaus"), r.choice((0, 0, 0, 1, 2, 3))) for _ in range(60_000)]
    cost, audit = conversations.cheapest(turns)
    assert cost == conversations.suffix_bounds(turns)[0][0] and len(audit) >= len(turns)


def plain_reports(rows):
    """The contract row by row.  rows: (conv_id, turn, role, text) as they are in the table."""
    told, groups = (lambda v: " " if v is None else str(v)), {}
    for conv, turn, role, text in rows:
        out = groups.setdefault(conv, [])
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", told(text)) if kind == 2 else told(text)
        role = "user" if kind == 4 else told(role)
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    reports = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in turns:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None)
            seen.add((role, text))
        numbers = {t[0] for t in turns if t[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, out = plain_repair([(role, text, fault) for (_, role, text), fault in zip(turns, faults)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        reports[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return reports


def reports_of(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_repair_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_repair(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"] * 2
    assert reports_of(got) == plain_reports(rows)


def test_repair_of_odd_rows(spark, tmp_path):
    """Nulls anywhere, repeated rows, numbers that clash, conversations of which nothing is left, columns with clashing names."""
    r = random.Random(8)
    rows = [(r.choice((None, 1, 2, 3, 4, 5)), r.choice((None, 0, 1, 2, 3, 9, -4)), r.choice((None, "user", "assistant", "system", "", "tool")), r.choice((None, "", " \n", "Yes.", "No", "É!\x1f")))
            for _ in range(120)]
    gone = next(c for c in range(100, 300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Hi."), (6, None, None, None)]
    frame = spark.createDataFrame([(*x, "x", 0) for x in rows], "conv_id long, turn long, role string, text string, digest string, part int").repartition(5)
    got = reports_of(conversations.repair_digest(queries.damaged(frame), frame))
    assert got == plain_reports(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair_digest(frame.limit(0)).collect() == [] and conversations.repair(frame.limit(0)).collect() == []


def test_repaired_turns(spark):
    """The turns that the operator gives have legal roles and are what the hash is of."""
    rows = queries.damaged(table(spark, SF, "conversations"))
    told: dict = {}
    for r in conversations.repair(rows).orderBy("conv_id", "position").collect():
        told.setdefault(r["conv_id"], []).append((r["position"], r["edit"], r["role"], r["text"]))
    for r in conversations.repair_digest(rows).collect():
        turns = told.get(r["conv_id"], [])
        assert [t[0] for t in turns] == list(range(len(turns))) and LEGAL.fullmatch("".join(t[2][0] for t in turns))
        assert "".join(t[1] for t in turns) == r["audit"].replace("D", "")
        assert hashlib.sha256("\n".join(f"{t[2]}:{t[3]}" for t in turns).encode()).hexdigest() == r["repaired_sha256"]


# --- whitening -------------------------------------------------------------------------------------------------------

def plain_whitening(vectors, k=4, counts=False):
    """vec_id and vector of each row -> (deviations and whitened by row, explained, n)."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(x) for _, x in kept), default=0)
    kept = [(i, tuple(x) + (0,) * (d - len(x))) for i, x in kept]
    distinct = list(dict.fromkeys(x for _, x in kept))
    w = [sum(y == x for _, y in kept) for x in distinct] if counts else [1] * len(distinct)
    n = sum(w)
    s = [sum(a * x[j] for a, x in zip(w, distinct)) for j in range(d)]
    m = np.array(distinct, float) - np.array(s, float) / n
    cov = (m * np.array(w)[:, None]).T @ m / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = [(i, sum((n * a - b) ** 2 for a, b in zip(x, s)), (np.array(x, float) - np.array(s, float) / n) @ u / np.sqrt(np.where(e > 1e-9, e, np.inf))) for i, x in kept]
    return out, e / max(np.trace(cov), 1e-300), n


def same_whitening(rows, vectors, k=4, counts=False):
    want, explained, n = plain_whitening(vectors, k, counts)
    signs = {}
    held: dict = {}
    for r in rows:
        held.setdefault((r["vec_id"], r["component"]), []).append(r)
        assert r["n"] == n and abs(r["explained"] - explained[r["component"] - 1]) < 1e-9
    for i, deviation, white in want:
        for c, value in enumerate(white, 1):
            r = held[i, c].pop()
            assert int(r["deviation"]) == deviation
            if abs(value) > 1e-9 and abs(r["whitened"]) > 1e-9:
                sign = np.sign(value * r["whitened"])
                assert signs.setdefault(c, sign) == sign
            assert abs(abs(r["whitened"]) - abs(value)) < 1e-6
    assert not any(held.values())


def test_whitening_query(spark):
    rows = queries.op12_whitening(spark, SF)
    assert dict(rows.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = rows.collect()
    same_whitening(rows, [tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()])
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_of_odd_rows(spark, weights):
    """Nulls, non-finite entries, shorter and repeated vectors, one vector in most rows, repeated ids, large numbers, clashing names."""
    r = np.random.default_rng(3)
    base = [[float(x) for x in r.normal(size=5) * 3] for _ in range(40)]
    vectors = [(i, v) for i, v in enumerate(base)] + [(i, base[0]) for i in range(40, 400)] + [(7, base[1]), (None, base[2]), (500, None), (501, [1.0, None, 2.0, 3.0, 4.0]),
               (502, [1.0, float("nan"), 0.0, 0.0, 0.0]), (503, [float("inf")] * 5), (504, [1.0, 2.0]), (505, []), (506, [-0.0] * 5), (507, [3e7, -2e7, 1.0, 0.0, 0.5])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, times int").repartition(3)
    rows = whitening.whiten(frame, weights=weights).collect()
    ids = {}
    for i, v in vectors:  # rows of one id can't be told apart by id
        ids.setdefault(i, []).append(v)
    once = {i for i, v in ids.items() if len(v) == 1}
    assert len(rows) == 4 * (len(vectors) - 4)
    want, explained, n = plain_whitening(vectors, counts=weights == "count")
    deviations = {i: d for i, d, _ in want if i in once}
    assert {r["vec_id"]: int(r["deviation"]) for r in rows if r["vec_id"] in once} == deviations
    assert rows[0]["n"] == n and rows[0]["identity_error"] < 1e-4
    assert all(abs(r["explained"] - explained[r["component"] - 1]) < 1e-9 for r in rows)


def test_whitening_of_little(spark):
    def frame(*v):
        return spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>")

    assert whitening.whiten(frame()).collect() == [] and whitening.whiten(frame(None, [])).collect() == []
    one = whitening.whiten(frame([1.0, 2.0], [1.0, 2.0])).collect()
    assert {(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in one} == {(1, 1, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)} and len(one) == 4
    line = whitening.whiten(frame([0.0, 0.0], [1.0, 1.0], [2.0, 2.0])).collect()  # one dimension of variance
    assert {r["whitened"] for r in line if r["component"] == 2} == {0.0} and {round(r["explained"], 9) for r in line} == {1.0, 0.0}


# --- toxicity --------------------------------------------------------------------------------------------------------

def test_gradients():
    """The backward pass against differences."""
    net, r = toxicity.Network(1), np.random.default_rng(0)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x, mask, y = r.standard_normal((5, 3, 6 * toxicity.HIDDEN)), np.ones((5, 3)), np.array([1, 0, 1.0])
    mask[3:, 1] = 0

    def loss():
        s = net.forward(x, mask)
        return float((np.log1p(np.exp(s)) - y * s).sum())

    keep: dict = {}
    g, dx = net.backward(1 / (1 + np.exp(-net.forward(x, mask, keep))) - y, keep)
    for array, grad in [(net.p[k], g[k]) for k in g] + [(x, dx)]:
        for _ in range(5):
            at = tuple(r.integers(0, n) for n in array.shape)
            array[at] += 1e-4
            up = loss()
            array[at] -= 2e-4
            down = loss()
            array[at] += 1e-4
            assert abs((up - down) / 2e-4 - grad[at]) < 1e-4


def test_windows_cover_every_word(monkeypatch):
    monkeypatch.setattr(toxicity, "SEGMENT", 64)
    r = random.Random(2)
    for n in (0, 1, 5, 31, 32, 33, 63, 64, 65, 128, 300, 1000):
        text = " ".join(f"w{k}" for k in range(n))
        parts, begin, windows = list(toxicity.segments(text)), 0, set()
        for words in parts:
            windows |= {(begin + s, min(toxicity.WINDOW, len(words))) for s in toxicity.window_starts(len(words)).tolist()}
            begin += len(words) - toxicity.WINDOW
        assert {k for a, size in windows for k in range(a, a + size)} == set(range(n))
        whole = toxicity.window_starts(n).tolist()
        assert {a for a, _ in windows} == set(whole) or n == 0
    assert [w for p in toxicity.segments("x" * 50 + " É " + "".join(r.choice("ab ") for _ in range(9))) for w in p][:4] == ["x" * 24, "x" * 24, "xx", "é"]


@pytest.fixture(scope="module")
def toxic_texts():
    r = random.Random(4)
    words = ["".join(r.choice("abcdeilmnorst") for _ in range(r.randint(2, 8))) for _ in range(400)]

    def text(bad, n):
        out = [r.choice(words) for _ in range(n)]
        for _ in range(bad):
            out.insert(r.randint(0, len(out)), "zzgru" + r.choice(words))  # told by its characters only
        return " ".join(out)

    return [text(4 * (k % 3 == 0), r.choice((20, 60, 200))) for k in range(600)], [int(k % 3 == 0) for k in range(600)]


def test_model_learns_parts_of_words(toxic_texts):
    texts, labels = toxic_texts
    model = toxicity.train(texts[:400], labels[:400])
    p, n, first = toxicity.Scorer(model).scores(texts[400:])
    hit = (p >= 0.3) == (np.array(labels[400:]) == 1)
    assert hit.mean() >= 0.95
    for text, y, at in zip(texts[400:], labels[400:], first):
        if y:  # the highest window has one of the words
            assert any(w.startswith("zzgru") for w in text.split()[at:at + toxicity.WINDOW])
    # a batch, one by one, and behind other words: the same scores; a long text is covered to its end
    alone = np.array([toxicity.Scorer(model).scores([t])[0][0] for t in texts[400:420]])
    assert np.allclose(alone, p[:20], atol=1e-5)
    clean = next(t for t, y in zip(texts, labels) if not y)
    long = " ".join([clean] * 400)
    low, high = toxicity.Scorer(model).scores([long, long + " zzgrumel zzgruba zzgrute"])[0]
    assert low < 0.3 <= high
    assert toxicity.Scorer(model).scores([None, "", " .,"])[0].tolist() == [0.0, 0.0, 0.0]


def test_model_needs_both_labels(spark):
    assert toxicity.train(["a", "b"], [0, 0]) is None and toxicity.train([], []) is None
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none is None and [tuple(r) for r in toxicity.score(docs, none).collect()] == [(1, 0.0, 0, None)]


def test_toxicity_query_held_out(spark):
    """Held-out accuracy on the table, with labels never seen, and texts scored alike wherever they are."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op13_toxicity(spark, sf)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int", "n_windows": "bigint", "first_word": "bigint"}
    told = rows.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in told}
    assert n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * (n[0, 0] + n.get((0, 1), 0))


def test_toxicity_of_odd_rows(spark):
    """Nulls, empty tables, repeated rows, contradictory labels, clashing names."""
    r = random.Random(3)
    rows = [(i, f"{'vile scum ' if i % 2 else 'kind words '}{r.random()}", 1) for i in range(60)] + [(1, None, 1), (None, "vile", 1), (2, "", 0), (2, "", 0), (61, "x" * 200_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 5) for i in range(60)] + [(3, 0, 5), (None, 1, 1), (4, None, 1), (900, 1, 1)], "doc_id long, toxic int, label int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "score", "n_windows", "first_word"] and got.count() == len(rows)
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert [x["score"] for x in got.where("doc_id = 2 and n_windows = 0").collect()] == [0.0, 0.0]
