"""The pipeline's stages with hostile columns and rows."""

import pytest

import corpus_pipeline
from locusframe.llm import mixing

DIR = "/root/testdata/sf0.001"
NAMES = ["_id", "_hash", "_copies", "_copy", "row", "doc", "text_hash", "copies", "rows", "key", "component"]


def hostile(spark, rows):
    extra = [f"{n}!" for n in NAMES]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), *extra) for i, t, lang, src in rows], schema)


def test_clashing_names_stay(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = hostile(spark, [(1, words, "en", "s"), (2, words + " end", "en", "s"), (3, "other text of few words", None, None), (None, None, None, "s"), (4, "", "en", "t")])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, DIR)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4]
    for out in (kept, corpus_pipeline.cut_repeats(spark, docs, DIR), corpus_pipeline.mix_sources(spark, docs, DIR)):
        assert out.columns == docs.columns
        assert all(r[n] == f"{n}!" for r in out.collect() for n in NAMES)


def test_mixed_decides_by_row(spark):
    """Rows that share an id, or everything, are selected for themselves; the budget holds."""
    text = lambda n, w: " ".join([w] * n)
    rows = [(1, text(6, "a"), "en", "s"), (1, text(9, "b"), "en", "s"), (2, text(5, "c"), "en", "s"), (2, text(5, "c"), "en", "s"), (None, text(4, "d"), "en", "s"), (3, text(7, "e"), "en", "s")]
    docs = hostile(spark, rows)
    total = sum(len(t.split()) for _, t, _, _ in rows)
    for share in ((1, 2), (1, 1), (2, 1), (5, 2)):
        took = mixing.mix(docs, {}, share).collect()
        out = mixing.mixed(docs, {}, share).collect()
        assert sorted((r.doc_id or 0, r.n_tokens) for r in took) == sorted((r.doc_id or 0, len(r.text.split())) for r in out)
        assert sum(len(r.text.split()) for r in out) <= total * share[0] // share[1]


@pytest.mark.parametrize("stage", range(4))
def test_empty_tables(spark, stage):
    docs = hostile(spark, []).limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, DIR).count() == 0
