"""The pipeline on a small corpus, against the operators' brute-force results stage by stage."""

import corpus_pipeline
import pytest

from tests.llm.test_exact import encoding, plain_components, plain_cuts, plain_distance

from cadenza.llm import decontam, quality, suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"input": docs.cache()}
    for name, fn in corpus_pipeline.STAGES:
        docs = fn(spark, docs, SF).cache()
        out[name] = docs
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["input"].columns


def test_quality_stage_filters(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    v = quality.verdicts(stages["input"], quality.fit(stages["input"], labels)).where("kept").count()
    assert stages["quality"].count() == v


def test_one_of_each_group_stays(stages):
    want = [eval(x) for x in plain_components(rows(stages["quality"]))]  # noqa: S307
    assert sorted(d for d, _ in rows(stages["near_duplicates"])) == sorted(d for d, _, c in want if d == c)


def test_repeats_are_cut(stages):
    before = rows(stages["near_duplicates"])
    got = suffix_dedup.digests(stages["near_duplicates"]).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_cuts(before)
    size = {r.doc_id: r.n_bytes - r.n_removed for r in got}
    assert all(size[d] - 12 <= len(t.encode()) <= size[d] for d, t in rows(stages["repeats"]))


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = dict(rows(stages["decontamination"]))
    m = decontam.Matcher(items)
    for d, t in rows(stages["repeats"]):
        t = decontam.normal(t)
        exact = any(i.text in t for i in m.items)
        if exact or d not in kept:
            assert d not in kept
        if d not in kept and not exact:
            assert any(plain_distance(i.text, t) <= i.budget for i in m.items)


def test_tokens(stages):
    e = encoding()
    text = dict(rows(stages["decontamination"]))
    got = stages["tokens"].collect()
    assert len(got) == len(text) and all(list(r.ids) == e.encode_ordinary(text[r.doc_id]) for r in got)


def test_edges(spark):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x y z " * 3000, None, "s", 18000)]
    docs = spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 as score", "2 as g")
    for name, fn in corpus_pipeline.STAGES:
        assert fn(spark, docs.limit(0), SF).count() == 0, name
        docs = fn(spark, docs, SF)
        assert docs.count() <= 4
