"""Operators that learn: held-out accuracy and defined results at the edges."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cadenza.llm import langid, quality, subword, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def edge(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "12 34 !", "en", None), (4, "x" * 100_000, None, "s"), (4, "x" * 100_000, None, "s"), (None, "the of and", "en", "s")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns({"score": F.lit(1), "predicted": F.lit(2), "_quality": F.lit(3), "_y": F.lit(4), "quality_score": F.lit(5), "y": F.lit("z"), "h": F.lit(6), "n": F.lit(7)})


def clashing(docs):
    return docs.withColumns({c: F.lit("x") for c in ("_y", "y", "h", "n", "rank", "all", "score", "held_out", "_quality", "quality_score", "toxic", "quality", "s")})


def other_labels(labels, col):
    """The labels with those of held-out documents turned round, and labels of documents that do not exist."""
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return labels.withColumn(col, F.when(held, 1 - F.col(col)).otherwise(F.col(col)))


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(docs, labels)
    got = toxicity.score(docs, m).join(labels, "doc_id").where("held_out and toxic is not null").select("predicted", "toxic").collect()
    hit = sum(r.predicted == 1 for r in got if r.toxic)
    assert hit >= 0.75 * sum(r.toxic for r in got) and sum(r.predicted for r in got if not r.toxic) <= 0.02 * len(got)
    e = toxicity.score(edge(spark), m).collect()
    assert len(e) == 6 and all(0 <= r.score <= 1 for r in e) and [r.predicted for r in e if r.doc_id in (1, 2)] == [0, 0]
    none = toxicity.fit(edge(spark), labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score(edge(spark), none).collect())
    assert toxicity.score(docs.limit(0), m).count() == 0


def test_toxicity_learns_from_no_held_out_label_nor_clashing_column(spark, docs, labels):
    plain = toxicity.score(docs, toxicity.fit(docs, labels)).orderBy("doc_id").collect()
    odd = toxicity.score(clashing(docs), toxicity.fit(clashing(docs), other_labels(labels, "toxic"))).orderBy("doc_id").collect()
    assert plain == odd
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in plain)


def test_samples_are_bounded_under_repeated_ids(spark):
    """One doc_id in three thousand rows of two texts, and one language for each text."""
    rows = [(1 if i % 2 else i, f"some text {i % 2 or i}", f"l{i % 40}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    keys = docs.select(F.col("lang").alias("y"), F.xxhash64("doc_id", "text").alias("h"), F.octet_length("text").alias("n"))
    chosen = subword.choose(keys, 5, 100)
    t = subword.fetch(docs, chosen, StringType())
    assert len(chosen) == 100 and len({y for y, _ in chosen}) == 40 and t.num_rows <= 20 * 40 and t.num_rows == len(set(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), t["y"].to_pylist(), strict=True)))
    assert len(subword.choose(keys, 10**6, 10**6, 200)) <= 16 and subword.choose(keys.limit(0), 5) == []


def test_every_language_is_learned(spark):
    """However many there are: none is dropped for being rare."""
    rng = random.Random(2)
    alphabets = ["".join(chr(0x4E00 + 40 * k + j) for j in range(40)) for k in range(300)]
    rows = [(i, " ".join("".join(rng.choice(alphabets[i % 300]) for _ in range(4)) for _ in range(12)), f"lang{i % 300}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    m = langid.fit(docs, most=8)
    assert len(m.names) == 300 and m.words.table is None  # more classes than dimensions: embeddings, no table of logits
    got = langid.identify(docs, m).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.1 * len(got)  # 30 times chance, from six texts of each


def test_misspelt_words_are_scored_by_their_ngrams():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8)))
    texts, y = [], []
    for i in range(800):
        w = [word() for _ in range(rng.randint(5, 40))]
        if i % 2:
            w[rng.randrange(len(w))] = rng.choice(["badword", "wickedness", "grumpfish"])
        texts.append(" ".join(w)), y.append(i % 2)
    m = toxicity.train(pa.array(texts), np.array(y))
    s = m.score(pa.array(["eat tins in a badwordd rain", "tiles of wickednes outline", "tiles of stone outline a rain", ""]))
    assert s[0] > 0.3 and s[1] > 0.3 and s[2] < 0.3 and s[3] < 0.3


def test_langid(spark, docs):
    m = langid.fit(docs)
    got = langid.identify(docs, m).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    e = {r.doc_id: r for r in langid.identify(edge(spark), m).collect()}
    assert e[1].lang_pred == e[2].lang_pred == e[3].lang_pred == "und" and e[None].lang_pred == "en"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and all(0 <= r.score <= 1 for r in got)
    # neither the languages of held-out documents nor columns of other names count
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = clashing(docs).withColumns({"lang": F.when(held, "xx").otherwise(F.col("lang")), "source": F.lit("none")})
    assert langid.identify(docs, m).orderBy("doc_id").collect() == langid.identify(other, langid.fit(other)).orderBy("doc_id").collect()
    assert langid.identify(docs.limit(0), m).count() == 0
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(edge(spark), none).collect()} == {"und"}


def test_quality(spark, docs, labels):
    m = quality.fit(docs, labels)
    got = quality.verdicts(docs, m).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    good, poor = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(not r.kept for r in poor) >= 0.6 * len(poor)
    e = edge(spark)
    kept = quality.keep(e, m)
    assert kept.columns == e.columns and kept.count() <= 6
    assert quality.verdicts(e, quality.fit(e, labels.limit(0))).count() == 6
    assert quality.verdicts(docs.limit(0), m).count() == 0 == quality.keep(docs.limit(0), m).count()
    odd = clashing(docs)
    again = quality.fit(odd, labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert quality.verdicts(docs, m).orderBy("doc_id").collect() == quality.verdicts(odd, again).orderBy("doc_id").collect()


def test_the_page_view_reads_no_text(spark, docs):
    some = docs.limit(50).select("text", "lang", "source", "n_chars").toArrow()
    blank = some.set_column(0, "text", pa.array([""] * 50))
    assert (quality.page_features(some) == quality.page_features(blank)).all()


def test_bags_and_sums():
    assert subword.sums(np.array([1, 2, 3]), np.array([0, 0, 2, 2, 3])).tolist() == [0, 3, 0, 3]
    assert subword.spread(np.array([5, 0]), np.array([2, 3])).tolist() == [5, 6, 0, 1, 2]
    words, at, off = subword.split_words(pa.array([None, " a b ", "", "b\n\tA"]), True)
    assert [[words[i] for i in at[a:b]] for a, b in zip(off, off[1:], strict=False)] == [[], ["a", "b"], [], ["b", "a"]]
