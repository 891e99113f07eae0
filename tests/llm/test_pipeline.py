"""The pipeline against brute force: only the classifier's scores are taken from the operator."""

import pytest

from graphloom.llm.quality import train_quality, with_quality

from .test_dedup import UPPER, brute_components
from .test_pages import brute_contamination

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def expected(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = with_quality(docs, train_quality(docs, labels)).filter("score >= 0.5").select("doc_id", "text").collect()
    last = {}
    for i, x in good:
        key = (x or "").translate(UPPER)
        last[key] = max(last.get(key, (-1, "")), (i, x))
    rows = sorted(last.values())
    parts, _ = brute_components(rows)
    own = {i: c for i, _, c in parts}
    rows = [(i, x) for i, x in rows if own[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {int(i) for i, n, hit, _ in brute_contamination(rows, items) if hit > 0 and 20 * hit >= n}
    return {i: x for i, x in rows if i not in dirty}


def test_pipeline_equals_brute_force(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    theirs = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    want = expected(spark)
    out = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    assert set(out) == set(want) and 100 < len(want) < 200
    assert all(out[i].token_ids == theirs.encode(x) and out[i].round_trip for i, x in want.items())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns, name


ODD_DOCS = [
    (None, None, None, None, None),
    (None, None, None, None, None),
    (1, "", "en", "web", 0),
    (2, None, "en", "web", None),
    (3, " \n ", None, None, 3),
    (4, "the same words stand here twice or more", "en", "web", 40),
    (4, "the same words stand here twice or more", "en", "web", 40),
    (5, "THE same words stand here twice or more", "de", "web", 40),
    (None, "the same words stand here twice or more", "de", "web", 40),
    (6, "another text of an id", "en", "web", 21),
    (6, "a second text of the id", "en", "web", 23),
    (7, "long " * 300_000, "en", "web", 1_500_000),
]


def odd_documents(spark):
    """Rows no stage may fail on, with further columns of names that operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in ODD_DOCS], "doc_id long, text string, lang string, source string, n_chars long, row string, th string, score string")


def test_every_stage_takes_odd_rows(spark):
    key = lambda r: (r.doc_id, r.text)
    docs = odd_documents(spark)
    (_, quality), _, (_, near), (_, clean), (_, tokens) = pipeline.STAGES
    some = [key(r) for r in quality(spark, docs, SF).collect()]
    assert set(some) <= {r[:2] for r in ODD_DOCS} and all(some.count(k) == [r[:2] for r in ODD_DOCS].count(k) for k in set(some))
    kept = [key(r) for r in near(spark, docs, SF).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(None, None), (1, ""), (2, None), (3, " \n "), (None, ODD_DOCS[8][1]), (6, ODD_DOCS[9][1]), (6, ODD_DOCS[10][1]), (7, ODD_DOCS[11][1])]))
    assert clean(spark, docs, SF).count() == len(ODD_DOCS)
    out = tokens(spark, docs, SF).collect()
    assert len(out) == len(ODD_DOCS) and all(r.round_trip for r in out if r.token_ids is not None) and sum(r.token_ids is None for r in out) == 3


def test_exact_stage_keeps_one_row_of_equal_texts(spark):
    kept = pipeline.STAGES[1][1](spark, odd_documents(spark), SF).collect()
    lowered = [(r.text or "").translate(UPPER) for r in kept]
    assert sorted(lowered) == sorted({(r[1] or "").translate(UPPER) for r in ODD_DOCS})
    assert {(r.text or "").translate(UPPER): r.doc_id for r in kept}[ODD_DOCS[5][1]] == 5
