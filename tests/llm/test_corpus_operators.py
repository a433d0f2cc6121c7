"""Each corpus operator against a plain version of itself, on a real table and on odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from sessionloom.llm import bpe, fingerprints, jaccard, language, licenses, packing, pii, quality, queries, sharding, urls

SF = "/root/testdata/sf0.001"
# fixed values of the tests: the runs that a text of ordinary words doesn't have
RUNS = [(20, " " * 900_000 + "x"), (21, "\t" * 300_000), (22, "a" * 300_000), (23, "under the mit license " * 20_000), (24, "x@" * 50_000), (25, "1 " * 100_000)]
LONG = "alpha beta gamma delta " * 4000 + "x" * 5000
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, LONG), (7, "Éa Σας ΟΔΟΣ \x1c 日本語 🙂"),
       (8, "Call +1 (314) 555-6532 4663622617512349 or a.b@mail.example.com"), (9, "Released under the MIT Licence. CC BY-NC! Under the MIT License"),
       (None, "no id here at all"), (10, "the same words again and again " * 3), (11, "the same words again and again " * 3), (12, "<|endoftext|> a  b   c")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    return spark.createDataFrame([(i, t, None, "src", 7, "x", 1, 2) for i, t in ODD],
                                 "doc_id long, text string, lang string, source string, n_chars long, labels string, a long, _rank int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def both(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def by_row(rows):
    return sorted(map(repr, rows))


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark):
    e = spark.createDataFrame([], EMPTY)
    path, byte_path = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("byte_bpe_50k.json")
    model = language.learn(language.sample_of(e))
    for made in (quality.quality_rules(e), packing.pack(e, byte_path), licenses.license_scan(e), pii.personal_data(e),
                 fingerprints.compare_neighbours(e), language.identify(e, model), sharding.shard(e), bpe.digest(e, path),
                 jaccard.jaccard_groups(e), jaccard.keep_one(e)):
        assert made.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(pages, queries.url_rules(spark), queries.reported_sites(pages)).count() == 0


def test_long_runs(spark):
    """Texts of one character a million times over, and of one phrase: ids as the library has them, in linear time."""
    import time

    from tokenizers import Tokenizer

    frame = spark.createDataFrame(RUNS, "doc_id long, text string").repartition(4)
    texts, t = dict(RUNS), Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    ids = packing.ids_of(queries.tokenizer_path("byte_bpe_50k.json"))
    assert ids.of(" " * 2_000_000 + "x") == b"".join(i.to_bytes(4, "little") for i in t.encode(" " * 2_000_000 + "x", add_special_tokens=False).ids)
    totals = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(frame, queries.tokenizer_path("byte_bpe_50k.json")).collect()}
    assert totals == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in RUNS}
    start = time.time()  # of the functions themselves, which take about a second each; quadratic ones took minutes
    scanner, model = licenses._scanner(licenses.NOTICES), pii._model()
    for text in texts.values():
        licenses.scan(text, scanner)
        pii.find(text, model)
        quality.measure(text)
    assert time.time() - start < 60
    found = {r["doc_id"]: r for r in licenses.license_scan(frame).collect()}
    assert found[23]["n_base"] == 20_000 and found[23]["last_word"] == 4 * 19_999
    assert {r["doc_id"] for r in pii.personal_data(frame).collect()} == set(texts)
    for made in (quality.quality_rules(frame), bpe.digest(frame, queries.tokenizer_path("word_bpe_49k.json")), jaccard.jaccard_groups(frame), sharding.shard(frame)):
        assert made.count() == len(RUNS)


def test_no_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from sessionloom.llm import common

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(RuntimeError):
        common.shared_dir(far)


def test_release(spark):
    from sessionloom.llm import common

    common._settled.clear()
    made = common.settle(spark.range(3))
    assert made.count() == 3 and common.release(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(made.inputFiles()[0]).count()


def test_settled_tables_leave_no_shuffle_files(spark):
    import glob
    import time

    from sessionloom.llm import common

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}

    before = files()
    made = common.settle(spark.range(1000).repartition(7, "id"))
    ends = time.time() + 20
    while (left := files() - before) and time.time() < ends:  # they are taken away beside the driver's work
        time.sleep(0.2)
    assert not left
    assert made.count() == 1000


def test_jaccard_keeps_what_its_result_reads_only(spark):
    from sessionloom.llm import common

    common.release(spark)
    text = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(i, text + f" x{i}") for i in range(80)] + [(100 + i, f"a{i} b c d e") for i in range(9)], "doc_id long, text string")
    rows = jaccard.jaccard_groups(frame, 4, 85)
    kept = [set(t.columns) for t in common._settled.values()]
    assert not any(c & {"text", "t", "s", "token", "counts", "logs", "slot"} for c in kept)
    want = {i: 0 for i in range(80)} | {100 + i: 100 + i for i in range(9)}
    assert {r.doc_id: r.component_id for r in rows.collect()} == want


def test_prefix_rows_are_dealt_once(spark):
    frame = spark.createDataFrame([(1, 5, 9, 0, -1), (1, 6, 9, 0, -1), (1, 6, 9, 0, -1), (2, 5, 9, 1, -1)], "token long, a long, n int, pos int, part int")
    met = jaccard._met(frame, False)
    assert sorted(tuple(r)[:4] for r in met.collect()) == [(1, 5, 9, 0), (1, 6, 9, 0)]
    assert met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    chars = sum(map(len, words))

    def inside(n):
        seen = defaultdict(list)
        for i in range(len(words) - n + 1):
            seen[tuple(words[i:i + n])].append(i)
        hit = set()
        for at in seen.values():
            if len(at) > 1:
                for i in at:
                    hit.update(range(i, i + n))
        return hit

    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup_line = sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x in lines if lines.count(x) > 1)
    repeat = len(inside(3))
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    kept = not failed and dup_line <= quality.LINE_LIMIT * chars and all(
        sum(len(words[i]) for i in inside(n)) <= most * chars for n, most in quality.NGRAM_LIMITS.items())
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat, failed, kept, dup_line


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_quality(request, which):
    frame = request.getfixturevalue(which)
    whole = quality.quality_rules(frame)
    rows = whole.drop("dup_ngram_chars").collect()
    measured = {r["doc_id"]: r["dup_ngram_chars"] for r in whole.collect()}
    assert all(measured[i][0] >= measured[i][-1] for i in measured)
    assert quality.measure("a b c a b c", {2: 0.5})[4] == 6 and quality.measure("a b c a b c", {})[4] == 6
    assert by_row(tuple(r) for r in rows) == by_row((i, *plain_quality(t)) for i, t in both(frame))


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_packing(request, which):
    from tokenizers import Tokenizer

    frame = request.getfixturevalue(which)
    path = queries.tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = defaultdict(list)
    for i, text in both(frame):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want[i].append((len(ids), raw))
    rows = packing.pack(frame, path).collect()
    held = defaultdict(list)
    for r in rows:
        assert any(r["doc_tokens"] == n and zlib.crc32(raw[4 * r["start"]:4 * (r["start"] + r["length"])]) == r["ids_crc32"] for n, raw in want[r["doc_id"]])
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(n for v in want.values() for n, _ in v)
    for at in held.values():
        at.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:])) and at[0][0] == 0 and sum(at[-1]) <= 2048
    if which == "docs":
        assert sum(n for at in held.values() for _, n in at) > 0.97 * 2048 * (len(held) - 1)


def test_plan_meets_the_histogram():
    import random

    r = random.Random(5)
    for _ in range(10):
        need = {r.randint(1, 64): r.randint(1, 500) for _ in range(20)}
        patterns = packing.plan(need, 64)
        made = defaultdict(int)
        for n, held in patterns:
            assert sum(k * c for k, c in held.items()) <= 64
            for k, c in held.items():
                made[k] += n * c
        assert all(made[k] >= n for k, n in need.items())
        room: list[int] = []  # first fit, longest first
        for k in sorted((k for k, n in need.items() for _ in range(n)), reverse=True):
            at = next((i for i, x in enumerate(room) if x >= k), None)
            if at is None:
                room.append(64 - k)
            else:
                room[at] -= k
        assert sum(n for n, _ in patterns) <= len(room) + 3


def test_urls(spark):
    odd = ["https://a.org", "https://A.org/x?y", None, "", "no scheme", "http://example.org/es/1", "http://m.example.org/en/1x", "ftp://x.com/de/",
           "https://www.shop.com/fr/", "://", "http://com/de/a#b", "http://notexample.org/es/", "http://bad.net/p/?utm_source=q", "http://m.bad.net:80/p", "http://bad.net/q",
           "https://blog.site-x.com:443/a?b=c", "http://site-x.com", "http://notsite-x.com/a", "http://bad.net/" + "p" * 100_000]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(odd + odd)], "page_id long, url string, host string")
    rules = queries.url_rules(spark)
    assert [tuple(r) for r in rules.collect()] == queries.URL_RULES
    listed = spark.createDataFrame([("https://bad.net/p",), ("http://www.site-x.com/",), (None,)], "url string")
    rows = {r["page_id"]: r for r in urls.filter_urls(pages, rules, listed).collect()}
    assert len(rows) == 2 * len(odd)
    for i, u in enumerate(odd + odd):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fit = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        bad = host in ("bad.net", "m.bad.net:80") and path.rstrip("/") == "/p" or host in ("site-x.com", "blog.site-x.com:443")
        best = max(fit, default=(0, None, "block" if bad else "allow"))
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == (host, path, best[1], best[2]), u


@pytest.mark.parametrize("most_mb", [64, 0])
def test_bloom_filter_has_no_false_negative(spark, monkeypatch, most_mb):
    """False positives are few; in a filter that its bound has made too small there are more, and the result stays right."""
    monkeypatch.setattr(urls, "MAX_FILTER_MB", most_mb or 1 / 1024)
    monkeypatch.setattr(urls, "SEGMENT", 100)
    keys = spark.range(5000).selectExpr("concat('k', id) as key")
    bloom, blocks = urls.bloom_filter(keys, "key", 5000)
    assert blocks == (1250 if most_mb else 128) and bloom.count() == -(-blocks // 100)
    passed = urls.might_hold(spark.range(20000).selectExpr("concat('k', id) as key", "id"), "key", bloom, int(blocks))
    ids = {r["id"] for r in passed.collect()}
    assert set(range(5000)) <= ids and (len(ids) < 5300) == bool(most_mb)


def test_reported_sites_are_found_by_the_join(spark):
    """On the real pages: what a plain loop over sites blocks, though most blocked pages aren't reported; false positives are counted."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    sites = {r["url"][7:] for r in queries.reported_sites(pages).collect()}
    rows = {r["page_id"]: r for r in urls.filter_urls(pages, queries.url_rules(spark), queries.reported_sites(pages)).collect()}
    blocked = reported = 0
    for r in pages.collect():
        got = rows[r["page_id"]]
        host = re.sub(r"^(www|m)\.", "", got["host"])
        bad = any(host == x or host.endswith("." + x) for x in sites)
        if got["rule"] is None:
            assert got["verdict"] == ("block" if bad else "allow"), r["url"]
            blocked += bad
            reported += bad and hashlib.md5(str(r["page_id"]).encode()).hexdigest() < "4"
    assert blocked > 2 * reported > 0
    entries = urls.entries_of(queries.url_rules(spark), queries.reported_sites(pages))
    bloom, blocks = urls.bloom_filter(entries, "key", entries.count())
    distinct = pages.select(urls.host_of(pages["url"]).alias("host"), urls.path_of(pages["url"]).alias("path"), urls.canonical(pages["url"]).alias("canonical"))
    keys = urls.candidate_keys(distinct, [1, 4, 5])
    passed = urls.might_hold(keys, "key", bloom, blocks)
    false = passed.join(entries, "key", "left_anti").count()
    assert passed.join(entries, "key").count() == keys.join(entries, "key").count() and false < 0.02 * keys.count()


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_licenses(request, which):
    frame = request.getfixturevalue(which)
    rows = licenses.license_scan(frame).collect()
    want = []
    for i, text in both(frame):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for label, phrase in licenses.PHRASES for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
        want.append((i, len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert by_row((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows) == by_row(want)
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)


def test_licence_notices_with_edits():
    wanted = licenses._scanner(licenses.NOTICES)
    for text, label in (("x Relesed under the MIT Licence. y", "mit"), ("Licensd under the Apache-Licence, Version 2.0", "apache-2"),
                        ("This work is licenced under the GNU General Public Licence, version 3", "gpl"), ("Licensed under CC BY NC-4.0", "cc-by-nc")):
        found = licenses.scan(text, wanted)
        assert label in found[5].split(","), (text, found)
        name, first, end, _ = found[7][0].split(":")
        assert name == label and 0 <= int(first) < int(end) <= found[0]
    assert licenses.scan("Released under the BSD license; the plain words of a text without any notice", wanted)[5] == ""
    adjacent = licenses.scan("released under teh mit license released under the mit license", wanted)
    assert adjacent[7] == ["mit:0:5:2", "mit:5:10:0"]


def fewest_edits(pattern, text):
    """The fewest edits between a pattern and any stretch of a text, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_licence_spans_against_whole_texts():
    """Random edits in each notice: it is found if and only if dynamic programming over the whole text finds it, with as few edits."""
    import random

    r = random.Random(3)
    rows = [(label, words, "") for label, words, _ in licenses.NOTICES]
    scanner = licenses.Scanner(rows)
    found = lost = 0
    for k, (label, words, _) in enumerate(rows):
        for _ in range(6):
            inner = list(words)
            for _ in range(r.randint(0, scanner.notices[k].edits + 2)):
                at = r.randrange(len(inner))
                inner[at:at + r.choice((0, 1, 1))] = r.choice(("", "x", "e", " "))
            text = " ".join(f"some words before {''.join(inner)} and after".split())
            got = [s for s in scanner.spans(f" {text} ".encode()) if s[0] == k]
            least = fewest_edits(words, f" {text} ")
            assert bool(got) == (least <= scanner.notices[k].edits), (text, words, least)
            assert not got or min(s[3] for s in got) == least
            found, lost = found + bool(got), lost + (not got)
    assert found > 100 and lost > 10


def test_a_table_of_notices(spark):
    docs = spark.createDataFrame([(1, "Offered to all under the Tea-Drinkers' licence 3"), (2, None)], "doc_id long, text string")
    table = spark.createDataFrame([("tea", "under the TEA drinkers license 3", None), ("none", None, None), ("empty", " ", ""), (None, "offered", "")], "label string, words string, fixed string")
    assert [r["labels"] for r in licenses.license_scan(docs, notices=table).orderBy("doc_id").collect()] == ["tea", ""]
    assert [r["labels"] for r in licenses.license_scan(docs, notices=table.where("false")).collect()] == ["", ""]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(text):
    def digits(m):
        return re.sub(r"[^0-9]", "", m[0])

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_personal_data(request, which):
    frame = request.getfixturevalue(which)
    rows = pii.personal_data(frame).collect()
    want = []
    for i, t in both(frame):
        base = plain_pii(t or "")
        want.append((i, *(sum(s[0] == k for s in base) for k in pii.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    assert by_row(tuple(r)[:6] for r in rows) == by_row(want)


def test_personal_data_on_random_text():
    import random

    r = random.Random(2)
    for _ in range(20000):
        text = "".join(r.choice("aZ0129.@+-% ()5") for _ in range(r.randint(1, 30)))
        assert sorted(pii.base_spans(text), key=lambda s: (s[1], pii.KINDS.index(s[0]))) == plain_pii(text), text


def test_personal_data_added_by_the_trees():
    model = pii._model()
    for text, span in (("reach me at jane (at) example (dot) org today", ("email", 12, 39)), ("phone: (314) 555-6532 now", ("phone", 7, 21)),
                       ("x +1 (314) 555-6532 4663622617512349 y", ("phone", 2, 19))):
        assert span in pii.find(text, model)[1], pii.find(text, model)
    for text in ("version 10.4.2 build 20240101", "order 4757965300 page 123456789", 'token = "11acdfb36bb72224148e6160f674b4be45601bff"'):
        assert pii.find(text, model)[1] == [], text
    assert pii.redact("a b@c.de +1 (314) 555-6532", model) == "a [EMAIL] [PHONE]"


def test_numbers_with_digits_close_by():
    model = pii._model()
    for text, spans in (("card 4111 1111 1111 1111 12/27", [("card", 5, 24)]), ("4111 1111 1111 1111 123", [("card", 0, 19)]),
                        ("314-555-6532 314-555-7777", [("phone", 0, 12), ("phone", 13, 25)]), ("314-555-6532/314-555-7777", [("phone", 0, 12), ("phone", 13, 25)]),
                        ("(314) 555-6532 24 hours", [("phone", 0, 14)])):
        assert set(spans) <= set(pii.candidates(text)), text
        assert pii.find(text, model)[1] == spans, (text, pii.find(text, model))
    assert pii.redact("card 4111 1111 1111 1111 12/27", model) == "card [CARD] 12/27"
    assert pii.find("table 12 345 6789 22 1 334 4455 66 7788 99 1", model)[1] == []


def test_addresses_spelled_out():
    model = pii._model()
    for text in ("write jane (AT) example (DOT) org today", "write jane ( at ) example ( dot ) org today", "write jane [At]example[dot]org today"):
        span = ("email", 6, len(text) - 6)
        for more in ("", " a@b"):  # found or not, whatever else the text holds
            assert pii.candidates(text + more) == [span]
            assert pii.find(text + more, model)[1] == [span], text
        assert pii.redact(text, model) == "write [EMAIL] today"


def test_digit_stretches_on_random_text():
    import random

    r = random.Random(4)
    for _ in range(5000):
        text = "".join(r.choice("0123456789012345 -()/.+a") for _ in range(r.randint(1, 45)))
        got = [c for c in pii.candidates(text) if c[0] in ("card", "phone")]
        want = set()
        for run in re.finditer(r"(?<![\w.,+#$-])[+(]{0,2}[0-9]+(?:[ ()./\-]{1,2}[0-9]+)*(?![\w]|[.,][0-9])", text):
            groups = [m.span() for m in re.finditer(r"[0-9]+", text) if run.start() <= m.start() and m.end() <= run.end()]
            for a, _ in groups:
                first = a
                while a > max(run.start(), first - 2) and text[a - 1] in "+(":
                    a -= 1
                for _, b in groups:
                    n = len(re.sub(r"[^0-9]", "", text[first:b]))
                    want |= {("card", a, b)} if 13 <= n <= 19 else set()
                    want |= {("phone", a, b)} if 9 <= n <= 15 else set()
        assert len(got) == len(set(got)) and set(got) == want, text


def test_recall_of_planted_loose_formats():
    """Formats that the base doesn't know, planted between the words of real documents; recall by kind."""
    import random

    import duckdb

    r = random.Random(11)
    docs = [t for t, in duckdb.sql(f"select text from '{SF}/documents.parquet' where length(text) > 200 order by doc_id").fetchall()]

    def d(k):
        return "".join(str(r.randint(0, 9)) for _ in range(k))

    def card():
        body = r.choice("3456") + d(14)
        return body + next(c for c in "0123456789" if pii.luhn(body + c))

    def spelled():
        at, dot = r.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" (AT) ", "."), (" [at] ", " [dot] ")))
        return f"{r.choice(('anna', 'j.smith', 'info', 'li_wei'))}{at}{r.choice(('mail', 'firma', 'uni-x'))}{dot}{r.choice(('org', 'de', 'com'))}"

    n = card()
    made = {"email": spelled, "ip": lambda: r.choice(("[.]", "(.)")).join(str(r.randint(1, 255)) for _ in range(4)),
            "card": lambda: f"{n[:4]} {n[4:8]} {n[8:12]} {n[12:]} {r.randint(1, 12):02}/{r.randint(25, 32)}",
            "phone": lambda: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{r.randint(201, 989)}-{d(3)}-{d(4)}", f"{r.randint(201, 989)}.{d(3)}.{d(4)}", f"0049 {r.randint(30, 89)} {d(3)} {d(4)}"))}
    cues = {"email": ("mail ", "contact ", "write to "), "ip": ("host ", "server "), "card": ("card ", "visa "), "phone": ("call ", "phone: ", "tel. ")}
    model, share = pii._model(), {}
    for kind in pii.KINDS:
        hit = 0
        for k in range(150):
            n, words = card(), docs[k % len(docs)].split(" ")
            inner, at = made[kind](), r.randrange(1, len(words))
            head = " ".join(words[:at]) + " " + r.choice(cues[kind])
            spans = pii.find(f"{head}{inner} {' '.join(words[at:])}", model)[1]
            want = len(n) + 3 if kind == "card" else len(inner)
            hit += any(s == kind and a <= len(head) and b >= len(head) + want for s, a, b in spans)
        share[kind] = hit / 150
    assert min(share.values()) >= 0.9, share


def test_trees_on_held_out_examples():
    trees, thresholds = pii.train(5)
    x, y = pii.examples(99, 2000)
    hit = trees.predict(x) >= [thresholds[int(k)] for k in x[:, 0]]
    assert y[hit].mean() > 0.95 and hit[y == 1].mean() > 0.6


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_fingerprints(request, which, monkeypatch):
    frame = request.getfixturevalue(which)
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 30)
    rows = fingerprints.compare_neighbours(frame).collect()
    order = sorted(both(frame), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        common = next((k for k, (a, b) in enumerate(zip(t, edited)) if a != b), min(len(t), len(edited)))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), common))
    assert by_row((r["doc_id"], r["n_chars"], r["edited_sha256"], r["common_edited"]) for r in rows) == by_row(want)
    texts = dict((i, t or "") for i, t in both(frame))
    seen = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert seen.setdefault(r["fingerprint"], texts[r["doc_id"]]) == texts[r["doc_id"]]
    if which == "docs":
        assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.9 * len(rows)


def plain_likeness(a, b):
    """The share of common spans, over the smallest hashes of both; by plain arithmetic over each span."""
    if a == b:
        return 1.0
    width = fingerprints.SHORT if max(len(a), len(b)) < 2 * fingerprints.WINDOW else fingerprints.WINDOW

    def least(t):
        w = min(width, len(t))
        spans = (fingerprints.PrefixHash(t[i:i + w]).span(0, w) for i in range(len(t) - w + 1 if t else 0))
        return sorted({a << 31 | b for a, b in spans})[:fingerprints.KEPT]

    x, y = least(a), least(b)
    union = sorted(set(x) | set(y))[:fingerprints.KEPT]
    return sum(v in x and v in y for v in union) / len(union) if union else 0.0


def test_likeness_against_plain_spans(spark):
    rows = [(i, t[:300]) for i, t in both(spark.read.parquet(f"{SF}/documents.parquet")) if t][:60]
    rows += [(1000 + k, "the quick brown fox jumps over it"[:k]) for k in range(0, 34, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: -r[0])
    after = {i: nxt for (i, _), (_, nxt) in zip(order, order[1:] + order[:1])}
    texts, short = dict(rows), 0
    for r in fingerprints.compare_neighbours(frame).collect():
        t, nxt = texts[r["doc_id"]], after[r["doc_id"]]
        half = len(t) // 2
        assert r["near_edited"] == pytest.approx(plain_likeness(t, t[:len(t) - half] + nxt[:half]))
        assert r["near_next"] == pytest.approx(plain_likeness(t, nxt))
        short += 12 < len(t) < 47 and r["near_edited"] > 0
    assert short > 5


def test_prefix_hashes_answer_span_equality():
    import random

    r = random.Random(1)
    for _ in range(200):
        a = "".join(r.choice("ab🙂") for _ in range(r.randint(0, 40)))
        b = "".join(r.choice("ab🙂") for _ in range(r.randint(0, 40)))
        g, h = fingerprints.PrefixHash(a), fingerprints.PrefixHash(b)
        i, j = r.randint(0, len(a)), r.randint(0, len(b))
        want = next((k for k, (x, y) in enumerate(zip(a[i:], b[j:])) if x != y), min(len(a) - i, len(b) - j))
        assert g.extension(i, h, j) == want


def test_language(spark, odd):
    rows = queries.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.97 * len(held)
    model = language.learn(language.sample_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    for r in language.identify(odd, model).collect():
        assert 0 <= r["score"] <= 1
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, model).collect()}
    assert found[1] == found[2] == found[3] == "und" and found[4] != "und"
    assert {r["lang_pred"] for r in language.identify(odd, {}).collect()} == {"und"}


def test_language_against_a_plain_loop(spark):
    """Every dictionary in turn, with compressors of its own, for all texts that aren't short."""
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, "🙂 12345"), (-2, None), (-3, "ab" * 200)], "doc_id long, text string"))
    model = language.learn(language.sample_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    rows = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    compared = 0
    for i, text in both(docs):
        r = rows[i]
        assert r["accepted"] == (r["lang_pred"] != "und" and r["score"] >= language.MARGIN)
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        folded = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode()).strip(b" ")
        if len(folded) < language.SHORT:
            continue
        sizes = []
        for lang, raw in sorted(model.items()):
            c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                         write_content_size=False, write_dict_id=False, write_checksum=False)
            sizes.append((sum(len(c.compress(folded[k:k + language.BLOCK])) for k in range(0, len(folded), language.BLOCK)), lang))
        best, second = sorted(sizes)[:2]
        assert r["lang_pred"] == best[1] and abs(r["score"] - (1 - best[0] / second[0])) < 1e-12
        compared += 1
    assert compared > 100 and not all(r["accepted"] for r in rows.values())


def test_many_labels(spark, monkeypatch):
    """A dirty label column: the most frequent labels are learned, with a warning."""
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    frame = spark.createDataFrame([(i, f"word{i % 7} some words of a text {i} " * 3, f"l{min(i % 10, 3)}") for i in range(200)], "doc_id long, text string, lang string")
    with pytest.warns(UserWarning):
        model = language.learn(language.sample_of(frame))
    assert set(model) == {"l3", "l0"}


def test_short_texts_keep_their_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    coders = language._coders(language.learn(language.sample_of(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1"))))
    short = docs.where("lang is not null and text rlike '[A-Za-z]' and size(split(trim(text), ' +')) < 8").select("text", "lang").collect()
    found = [language.classify(r["text"], coders) for r in short]
    assert len(short) > 100
    assert sum(f[0] == r["lang"] for f, r in zip(found, short)) > 0.97 * len(short)
    assert sum(f[1] >= language.MARGIN for f in found) > 0.97 * len(short)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_sharding(request, which):
    frame = request.getfixturevalue(which)
    rows = sharding.shard(frame).collect()
    assert by_row((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == by_row(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in both(frame))
    held = defaultdict(list)
    for r in rows:
        held[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    counts = [len(held.get(k, [])) for k in range(8)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1 and set(held) <= set(range(8))
    if which == "docs":
        where = defaultdict(set)
        for r in rows:
            if r["size"] > 1:
                where[r["text_crc32"], r["size"]].add(r["shard"])
        assert all(len(v) == 1 for v in where.values())


def plain_cut(texts, shard_of):
    """Cut pairs of nodes by a plain loop: a hub's pairs weigh one in n - 1."""
    hubs = defaultdict(set)
    for t in texts:
        for line in {x.strip(" ") for x in t.split("\n")}:
            if len(line) >= sharding.LINE:
                hubs[line].add(t)
    return sum(sum(shard_of[a] != shard_of[b] for a in h for b in h) / 2 / (len(h) - 1) for h in hubs.values() if len(h) > 1)


def test_sharding_cuts_fewer_edges(spark):
    """Documents of several hubs move to their neighbours: far fewer edges are cut than by the hash at the start, by two counts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {i: t for i, t in both(docs) if t}
    held = sharding.node_of(docs, docs.count(), 8)
    links = sharding.links_of(held, "node", "text")
    assert links.groupBy("node").count().where("count > 1").count() > 20
    node = {r["doc_id"]: r["node"] for r in held.collect()}
    start = held.where("node is not null").selectExpr("node", "cast(pmod(xxhash64(node, 'shard'), 8) as int) as shard").distinct()
    at = {r["node"]: r["shard"] for r in start.collect()}
    before = sharding.cut_edges(links, start)
    assert before == pytest.approx(plain_cut(set(texts.values()), {t: at[node[i]] for i, t in texts.items()}))
    made = {r["doc_id"]: r["shard"] for r in sharding.shard(docs).collect()}
    after = plain_cut(set(texts.values()), {t: made[i] for i, t in texts.items()})
    assert after < 0.6 * before, (before, after)


def test_flows_keep_the_quotas():
    import random

    r = random.Random(8)
    for _ in range(200):
        load = [r.randint(50, 120) for _ in range(5)]
        asked = {(i, j): float(r.randint(0, 40)) for i in range(5) for j in range(5) if i != j}
        go = sharding.flows(asked, load, [110] * 5)
        assert all(0 <= x <= asked[p] + 1e-9 for p, x in go.items())
        for k in range(5):
            now = load[k] + sum(x for (i, j), x in go.items() if j == k) - sum(x for (i, j), x in go.items() if i == k)
            assert now <= max(110, load[k]) + 1e-3


def test_sharding_splits_a_hot_group(spark):
    frame = spark.createDataFrame([(i, "same" if i % 3 else f"text {i}") for i in range(900)], "doc_id long, text string")
    held = defaultdict(int)
    for r in sharding.shard(frame).collect():
        held[r["shard"]] += 1
    assert sorted(held.values()) == [112] * 4 + [113] * 4


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_bpe(request, which):
    from tokenizers import Tokenizer

    frame = request.getfixturevalue(which)
    path = queries.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = []
    for i, text in both(frame):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert by_row(tuple(r) for r in bpe.digest(frame, path).collect()) == by_row(want)


def test_bpe_over_all_code_points():
    """Letters, numbers, cases and normal forms as the library sees them; planes without letters are sampled."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), bpe.Encoder(path)
    points = [c for c in range(0x32400) if not 0xD800 <= c <= 0xDFFF] + list(range(0x32400, 0x110000, 997))
    for k in range(0, len(points), 500):
        text = " ".join(f"b{chr(c)}a 1{chr(c)} Ab!{chr(c)}" for c in points[k:k + 500])
        assert e.encode(text) == t.encode(text, add_special_tokens=False).ids, hex(points[k])


def test_other_vocabularies_are_refused(tmp_path):
    import json

    with open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for key, value in (("normalizer", {"type": "NFKC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("decoder", {"type": "ByteLevel"})):
        path = str(tmp_path / f"{key}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(spec | {key: value}, f)
        with pytest.raises(ValueError):
            bpe.Encoder(path)


def test_packing_ids_over_all_code_points():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    t, ids = Tokenizer.from_file(path), packing.ids_of(path)
    points = [c for c in range(0x32400) if not 0xD800 <= c <= 0xDFFF] + list(range(0x32400, 0x110000, 997))
    for k in range(0, len(points), 500):
        text = " ".join(f"b{chr(c)}a 1{chr(c)} !{chr(c)}{chr(c)}  x" for c in points[k:k + 500])
        assert ids.of(text) == b"".join(i.to_bytes(4, "little") for i in t.encode(text, add_special_tokens=False).ids), hex(points[k])


def plain_groups(rows, k, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]


@pytest.mark.parametrize("which", ["odd", "docs"])
@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard(request, which, k, percent):
    frame = request.getfixturevalue(which)
    rows = jaccard.jaccard_groups(frame, k, percent).collect()
    assert by_row(tuple(r) for r in rows) == by_row(plain_groups(both(frame), k, percent))


@pytest.mark.parametrize("few,hot", [(1, 50_000), (20, 3), (1000, 40)])
def test_jaccard_in_a_family_near_the_threshold(spark, monkeypatch, few, hot):
    """Near copies whose likeness to each other lies about the threshold, over several blocks."""
    import random

    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "HOT", hot)
    r = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(0, 7)):
            words[r.randrange(len(words))] = f"e{r.randint(0, 40)}"
        rows.append((i * 7 % 150, " ".join(words)))
    frame = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in rows], "doc_id long, text string, _at int, _kept long, id int, row int")
    want = plain_groups(rows, 4, 85)
    assert by_row(tuple(x) for x in jaccard.jaccard_groups(frame, 4, 85).collect()) == by_row(want)
    assert 1 < len({c for _, _, c in want}) < 150
    one = jaccard.keep_one(frame, 4, 85)
    assert one.columns == frame.columns and {x["doc_id"] for x in one.collect()} == {c for _, _, c in want}


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (300, 300)]
    made = {r["node"]: r["component"] for r in jaccard.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert made == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}


def test_long_runs_of_digits(monkeypatch):
    """Long runs, which numpy takes, have the candidates and features of short ones, and are found alike."""
    import random

    r = random.Random(1)

    def run() -> str:
        out = [r.choice(("", "", "+", "(", "+("))]
        for k in range(r.randint(60, 160)):
            out.append((r.choice((" ", " ", "-", ".", "/", ") (", " (", "( ", ")", "--")) if k else "") + r.choice(("00", "", "", "")) + str(r.randint(0, 10 ** r.randint(1, 12))))
        return r.choice(("", "tel. ", "call: ", "order #", "\n", "12 ", "+49 ", "0049 ", "x", " ")) + "".join(out) + r.choice(("", " ", "x", " 12", "\n", " ()44", ".5", ","))

    model = pii._model()
    for _ in range(25):
        text = run()
        for at_once in (3, 50, 1 << 14):
            monkeypatch.setattr(pii, "GROUPS_AT_ONCE", at_once)
            for m in pii._DIGIT_RUN.finditer(text):
                got = {(pii.KINDS[int(x[0])], int(a), int(b)): x.tolist() for starts, ends, rows in pii.run_blocks(text, m) for a, b, x in zip(starts, ends, rows)}
                assert got == {c: [float(v) for v in pii.features(text, c)] for c in pii._stretches(text, m)}
        text += " mail a@b.org 4111 1111 1111 1111 " + text
        monkeypatch.setattr(pii, "LONG_RUN", 1 << 60)
        want = pii.find(text, model)
        monkeypatch.setattr(pii, "LONG_RUN", 0)
        assert pii.find(text, model) == want
        monkeypatch.undo()
