"""The pipeline's stages against plain versions of themselves."""

import corpus_pipeline as cp
from sessionloom.llm import jaccard, language, pii, quality

from test_corpus_operators import plain_groups, plain_quality

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(tuple, frame.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    coders = language._coders(language.learn(language.sample_of(docs)))
    kept = cp.language_stage(spark, at, SF)
    assert rows(kept) == sorted((r for r in rows(at) if (f := language.classify(r[1], coders))[0] != "und" and f[1] >= language.MARGIN), key=repr)
    assert kept.count() > 0.9 * docs.count() and kept.columns == docs.columns
    at, kept = kept, cp.quality_stage(spark, kept, SF)
    assert rows(kept) == sorted((r for r in rows(at) if plain_quality(r[1])[6]), key=repr)
    at, kept = kept, cp.duplicate_stage(spark, kept, SF)
    group = plain_groups([(r[0], r[1]) for r in rows(at)], 5, 80)
    assert rows(kept) == sorted((r for r in rows(at) if r[0] in {c for _, _, c in group}), key=repr)
    at, kept = kept, cp.privacy_stage(spark, kept, SF)
    model = pii._model()
    assert rows(kept) == sorted(((r[0], t := pii.redact(r[1], model), r[2], r[3], len(t)) for r in rows(at)), key=repr)
    assert not any(pii.base_spans(r[1]) for r in rows(kept))
    packed = cp.packing_stage(spark, kept, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in rows(kept)}


def test_clashing_columns_and_empty_table(spark):
    names = ["n_words", "_at", "_kept", "id", "row", "place", "score", "node", "_bucket", "_rank", "length", "offset", "p", "l"]
    odd = spark.createDataFrame([(1, None, "en", "a", 1, *range(len(names))), (None, "some words", None, None, None, *[None] * len(names)), (2, "some words", "en", "b", 9, *range(len(names)))],
                                "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
    assert cp.duplicate_stage(spark, odd, SF).count() == 3 and cp.packing_stage(spark, odd, SF).count() == 3
    assert jaccard.keep_one(odd).count() == 3
    empty = odd.where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.count() > 0 and quality.MIN_WORDS == 50
