"""Quality rules: base counts per text, and robust multivariate outliers by minimum covariance determinant.

One pass over the texts leaves a narrow table of counts. Everything after it is DataFrame work on that table. For each
language and source several estimates start: at medians and median deviations, at the moments of all texts, and at those
of texts drawn by a hash. A concentration step takes the distance under which the h share of the documents lie and the
mean and covariance of those, both grouped aggregates that combine before the shuffle, and never raises the determinant.
After two steps the two starts of least determinant go on until theirs no longer falls, and the lesser one is the estimate.
A source may hold any share of the rows: no group is ever gathered in a task.

Covariances are regularised: a fixed diagonal is added, more of it in small groups, so that the determinant is never zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.dist import chi2_cdf, chi2_quantile
from cadenza.llm.common import drop_out, on_disk, pieces, utf8_lists, write_out
from cadenza.llm.words import blocks, shingles, word_hashes

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Share of a group that the estimate concentrates on, most steps, fall of the logarithm of the determinant that ends them.
SHARE, STEPS, TOLERANCE = 0.75, 40, 1e-3
#: A language and source with fewer texts is judged by the estimate of its language, one of fewer still by all texts'.
LEAST = 50
#: Squared distance beyond which a text is rejected. Of five-dimensional normal vectors one in 10**11 lies beyond 60.
CUTOFF = 60.0
#: Starts by the moments of one text in ten, drawn by a hash.
DRAWS = 2
#: Least standard deviation of each transformed statistic: most texts have no symbol or repeat at all, and a covariance
#: of zeros would reject the first one that has.
FLOOR = {"f_words": 0.3, "f_length": 0.06, "f_symbols": 0.12, "f_lines": 0.3, "f_repeats": 0.3}
FEATURES = list(FLOOR)


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text; null: all zero."""
    strings = texts.to_pylist()
    raw, offsets = utf8_lists(texts)
    n = len(strings)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for i, t in enumerate(strings):
        if not t:
            continue
        out["word_chars"][i] = len(t) - sum(map(t.count, SPACES))
        out["n_symbols"][i] = sum(map(t.count, SYMBOLS))
        if "\n" in t:
            lines = [x for x in t.split("\n") if x.strip(SPACES)]
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    for i, j in blocks(offsets):
        at = offsets[i : j + 1] - offsets[i]
        words, per = word_hashes(raw[offsets[i] : offsets[j]], at)
        out["n_words"][i:j] = np.diff(per)
        h, d, first = shingles(words, per, WINDOW, False)
        if not len(h):
            continue
        own = h * np.uint64(2) + np.uint64(1)  # the text's number goes into the hash, so one sort serves the block
        own ^= d.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        twice = first[order[np.append(same, False) | np.append(False, same)]]
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, np.minimum(twice + WINDOW, len(words)), -1)
        total = np.append(0, np.cumsum(np.cumsum(cover[:-1]) > 0))
        out["n_repeat_words"][i:j] = total[per[1:]] - total[per[:-1]]
    return out


def count_table(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts, a row per row of docs."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = counts(b.column(3))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2)] + [pa.array(c[x]) for x in names], ["doc_id", "lang", "source", *names])

    return docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(pieces(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, source string, " + ", ".join(f"{x} bigint" for x in names))


def transformed(t: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return t.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "f_words": F.log1p("n_words"),
        "f_length": F.log1p(share("word_chars", "n_words")),
        "f_symbols": F.log1p(100 * share("n_symbols", "word_chars")),
        "f_lines": F.log1p(100 * share("n_dup_lines", "n_words")),
        "f_repeats": F.log1p(100 * share("n_repeat_words", "n_words")) / 2,
    })


def consistency(share: float, p: int) -> float:
    """What the covariance of the inner share of a normal vector must be multiplied by to be that of all."""
    return float(share / chi2_cdf(chi2_quantile(share, p), p + 2))


def _estimates(factor: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Centre, inverse covariance and log-determinant of each row's moments."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(FEATURES)
        for pdf in parts:
            n = pdf["n"].to_numpy(float)
            mean = np.stack([pdf[f"s_{x}"].to_numpy(float) / n for x in FEATURES], 1)
            cov = np.empty((len(pdf), p, p))
            for i, x in enumerate(FEATURES):
                for j, y in enumerate(FEATURES[: i + 1]):
                    cov[:, i, j] = cov[:, j, i] = pdf[f"s_{x}_{y}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
            cov = cov * factor + np.diag(np.array(list(FLOOR.values())) ** 2) * (1 + LEAST / n)[:, None, None]
            inv = np.linalg.inv(cov)
            out = {f"m_{x}": mean[:, i] for i, x in enumerate(FEATURES)}
            out |= {f"i_{x}_{y}": inv[:, i, j] for i, x in enumerate(FEATURES) for j, y in enumerate(FEATURES[: i + 1])}
            yield pd.DataFrame({"grp": pdf["grp"], "start": pdf["start"], "det": np.linalg.slogdet(cov)[1], "was": pdf["was"], **out})

    return run


PARAMS = [f"m_{x}" for x in FEATURES] + [f"i_{x}_{y}" for i, x in enumerate(FEATURES) for y in FEATURES[: i + 1]]


def distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its group's parameters."""
    total = F.lit(0.0)
    for i, x in enumerate(FEATURES):
        for j, y in enumerate(FEATURES[: i + 1]):
            total = total + F.col(f"i_{x}_{y}") * (F.col(x) - F.col(f"m_{x}")) * (F.col(y) - F.col(f"m_{y}")) * (1 if i == j else 2)
    return total


def _moments() -> list[Column]:
    """Sums from which _estimates() works."""
    pairs = [(x, y) for i, x in enumerate(FEATURES) for y in FEATURES[: i + 1]]
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s_{x}") for x in FEATURES], *[F.sum(F.col(x) * F.col(y)).alias(f"s_{x}_{y}") for x, y in pairs]]


def mcd(rows: DataFrame, groups: int, share: float = SHARE, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(grp, start, det, PARAMS): the minimum-covariance-determinant estimate of each grp of rows (grp, pick, FEATURES).

    pick: any hash of a row; groups: how many groups there are, about. Parameters are written each step; Spark broadcasts
    them where they are below its threshold.
    """
    schema = "grp string, start int, det double, was double, " + ", ".join(f"{x} double" for x in PARAMS)
    most = 300 * groups
    factor = consistency(share, len(FEATURES))
    of = lambda f: f.mapInPandas(_estimates(factor), schema)
    med = write_out(rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, 10_000).alias(f"m_{x}") for x in FEATURES]), "mcd", most)
    mad = rows.join(med, "grp").groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, 10_000).alias(f"d_{x}") for x in FEATURES])
    variance = {x: F.pow(1.4826 * F.col(f"d_{x}"), 2) + FLOOR[x] ** 2 for x in FEATURES}
    robust = med.join(mad, "grp").select("grp", F.lit(0).alias("start"), sum(map(F.log, variance.values()), F.lit(0.0)).alias("det"), F.lit(np.inf).alias("was"), *[f"m_{x}" for x in FEATURES], *[(1 / variance[x] if x == y else F.lit(0.0)).alias(f"i_{x}_{y}") for i, x in enumerate(FEATURES) for y in FEATURES[: i + 1]])
    # start 1: all rows; further ones: a tenth each
    draw = F.pmod("pick", F.lit(10))
    starts = F.array_compact(F.array(F.lit(1), *[F.when(draw == k, F.lit(k + 2)) for k in range(DRAWS)]))
    other = of(rows.withColumn("start", F.explode(starts)).groupBy("grp", "start").agg(*_moments(), F.lit(np.inf).alias("was")))
    params = write_out(robust.unionByName(other), "mcd", most)
    drop_out(med)
    for step in range(steps):
        d = rows.join(params, "grp").select("grp", "start", "det", *FEATURES, distance().alias("d"))
        q = d.groupBy("grp", "start").agg(F.percentile_approx("d", share, 10_000).alias("q"))
        # written, so that its size is known and the rows stay where they are
        limits = write_out(params.join(q, ["grp", "start"]), "mcd", most)
        near = rows.join(limits, "grp").where(distance() <= F.col("q"))
        new = of(near.groupBy("grp", "start").agg(*_moments(), F.first("det").alias("was")))
        if step == 1:
            new = new.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("det", "start"))).where("place <= 2").drop("place")
        new = write_out(new, "mcd", most)
        drop_out(params), drop_out(limits)
        params = new
        if step > 1 and not params.where(F.col("was") - F.col("det") > tolerance).limit(1).count():
            break
    best = params.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("det", "start"))).where("place = 1").drop("place", "was")
    return write_out(best, "mcd", most)


def screen(docs: DataFrame, share: float = SHARE, least: int = LEAST, cutoff: float = CUTOFF) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    Estimates use every text that passes the base rules. A (lang, source) with fewer than `least` such texts is judged by
    the estimate of all texts of its language, and if those are fewer than `least` too, by that of the whole corpus,
    however few its texts are. Null languages and sources are values of their own. A null text has no words and fails the
    base rules. Other columns of docs are ignored.
    """
    own = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    t = on_disk(transformed(count_table(docs)).withColumns({"lang_key": own("lang"), "fine": F.concat_ws("\x1f", own("lang"), own("source"))}))
    sizes = t.where("not base_failed").groupBy("lang_key", "fine").count()
    of_lang = sizes.groupBy("lang_key").agg(F.sum("count").alias("in_lang"))
    # every (lang, source) of the table, those without a text that passes too
    every = t.groupBy("lang_key", "fine").count().select("lang_key", "fine").join(sizes.select("fine", "count"), "fine", "left").join(of_lang, "lang_key", "left")
    grp = F.when(F.col("count") >= least, F.col("fine")).when(F.col("in_lang") >= least, F.concat("lang_key", F.lit("\x1e"))).otherwise(F.lit("\x1d"))
    groups = t.agg(F.approx_count_distinct("fine")).first()[0]
    of = write_out(every.select("lang_key", "fine", grp.alias("grp")), "groups", 100 * groups)
    wide = of.where(F.col("grp") != F.col("fine")).select("grp").distinct()
    langs = [F.concat("lang_key", F.lit("\x1e")), F.lit("\x1d")]
    # a text belongs to its own group, and to its language's and the corpus's if some group is judged by those
    belongs = of.where(F.col("grp") == F.col("fine")).select("fine", "grp").unionByName(of.select("fine", F.explode(F.array(*langs)).alias("grp")).join(wide, "grp").select("fine", "grp"))
    belongs = write_out(belongs, "belongs", 300 * groups)
    rows = t.where("not base_failed").select("fine", *FEATURES, F.xxhash64("doc_id", *FEATURES).alias("pick")).join(belongs, "fine").select("grp", "pick", *FEATURES)
    params = mcd(rows, 3 * groups, share)
    out = t.join(of.select("fine", "grp"), "fine", "left").join(params.drop("start", "det"), "grp", "left").withColumn("distance", distance())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"), "distance")
