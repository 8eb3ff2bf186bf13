"""Features, k-means and DBSCAN."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators.series import per_series
from cadenza.operators.stats import valid
from cadenza.schema import KEYS, ConfigError


def features(df: DataFrame, slope_window: int = 5, keys: list[str] = KEYS, order: str = "mjd", value: str = "value") -> DataFrame:
    """derivative, absolute, second derivative and trailing slope of each valid row, by row order."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.where(valid(value)).withColumn("_i", F.row_number().over(w))
    d = F.col(value) - F.lag(value).over(w)
    x = x.withColumn("derivative", d)
    t = w.rowsBetween(1 - slope_window, 0)
    full = F.count("*").over(t) == slope_window
    n, si, sv = F.count("*").over(t), F.sum("_i").over(t), F.sum(value).over(t)
    slope = (n * F.sum(F.col("_i") * F.col(value)).over(t) - si * sv) / (n * F.sum(F.col("_i") * F.col("_i")).over(t) - si * si)
    return x.withColumns({"abs_value": F.abs(value), "second_derivative": F.col("derivative") - F.lag("derivative").over(w), "slope": F.when(full, slope)}).drop("_i")


def zscores(df: DataFrame, cols: list[str], keys: list[str] = KEYS) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumns({c: F.when(F.stddev_pop(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(F.col(c)) for c in cols})


def kmeans_np(x: np.ndarray, k: int, inits: int = 10, rounds: int = 300, tol: float = 1e-6, seed: int = 42, start: str = "kmeans++") -> tuple[np.ndarray, np.ndarray, float]:
    """(labels, centres, inertia) of the best of several starts; an empty cluster moves to a random row."""
    if not 1 <= k <= len(x):
        raise ConfigError("k lies between 1 and the number of rows")
    rng, best = np.random.default_rng(seed), None
    for _ in range(inits):
        c = x[rng.integers(len(x))][None]
        while len(c) < k:
            if start == "random":
                c = np.vstack([c, x[rng.integers(len(x))]])
                continue
            d = ((x[:, None] - c[None]) ** 2).sum(-1).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(rounds):
            lab = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            new = np.array([x[lab == j].mean(0) if (lab == j).any() else x[rng.integers(len(x))] for j in range(k)])
            moved = np.abs(new - c).max()
            c = new
            if moved < tol:
                break
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        lab, inertia = d.argmin(1), float(d.min(1).sum())
        if best is None or inertia < best[2]:
            best = lab, c, inertia
    return best


def silhouette(x: np.ndarray, lab: np.ndarray) -> float:
    ids = np.unique(lab[lab >= 0])
    if len(ids) < 2:
        return 0.0
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in np.flatnonzero(lab >= 0):
        own = (lab == lab[i]).sum() - 1
        if own == 0:
            out.append(0.0)
            continue
        a = d[i][lab == lab[i]].sum() / own
        b = min(d[i][lab == j].mean() for j in ids if j != lab[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def best_kmeans(x: np.ndarray, k_min: int = 2, k_max: int = 10, **kw) -> tuple[np.ndarray, np.ndarray, float]:
    """The number of clusters with the best exact silhouette."""
    runs = [kmeans_np(x, k, **kw) for k in range(k_min, max(k_min, min(k_max, len(x) - 1)) + 1)]
    return max(runs, key=lambda r: silhouette(x, r[0]))


def kmeans(df: DataFrame, cols: list[str], k: int, seed: int = 42) -> DataFrame:
    """Distributed k-means over all rows; a `cluster` column."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=cols, outputCol="_v", handleInvalid="skip").transform(df)
    m = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v)
    return m.transform(v).drop("_v")


def kmeans_series(df: DataFrame, cols: list[str], k: int = 0, keys: list[str] = KEYS, order: str = "mjd", **kw) -> DataFrame:
    """k-means of the rows of each series (k 0: by silhouette); rows with a missing feature go to the nearest centre."""

    def run(t: np.ndarray, *fs: np.ndarray) -> dict:
        x = np.stack(fs, 1)
        ok = ~np.isnan(x).any(1)
        lab, c, _ = kmeans_np(x[ok], k, **kw) if k else best_kmeans(x[ok], **kw)
        o = np.argsort(c[:, 0])
        rank = np.empty(len(o), int)
        rank[o] = np.arange(len(o))
        out = np.full(len(x), -1)
        out[ok] = rank[lab]
        rest = np.flatnonzero(~ok & ~np.isnan(x[:, 0]))
        out[rest] = rank[np.abs(x[rest, :1] - c[None, :, 0]).argmin(1)] if len(rest) else []
        return {"cluster": out.astype(np.int32)}

    return per_series(df, run, "cluster int", keys, order, cols)


def dbscan_eps(x: np.ndarray, k: int, metric: str = "euclidean") -> float:
    """The k-distance at the sharpest bend of its sorted curve."""
    d = distances(x, metric)
    s = np.sort(np.sort(d, 1)[:, min(k, len(x) - 1)])
    if len(s) < 3:
        return float(s[-1])
    return float(s[1 + int(np.argmax(s[2:] - 2 * s[1:-1] + s[:-2]))])


def distances(x: np.ndarray, metric: str) -> np.ndarray:
    diff = x[:, None] - x[None]
    if metric == "euclidean":
        return np.sqrt((diff**2).sum(-1))
    if metric == "manhattan":
        return np.abs(diff).sum(-1)
    raise ConfigError(f"unknown metric {metric!r}")


def dbscan(df: DataFrame, cols: list[str], eps: float, min_points: int = 5, metric: str = "euclidean", node: str = "id") -> DataFrame:
    """Density clusters over all rows: a grid join finds neighbours, components over core rows make the clusters.

    cluster is the smallest core id of its component; a border row joins the cluster of its nearest core; noise is -1.

    Rows with equal coordinates have the same neighbours, so they go as one place with a count. Squares so small that all
    within are neighbours need no pairs of their own: a full one is core as a whole, and its cores are one node of the graph.
    """
    if metric == "euclidean":
        dist = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    elif metric == "manhattan":
        dist = F.aggregate(F.zip_with("x", "y", lambda u, v: F.abs(u - v)), F.lit(0.0), lambda s, v: s + v)
    else:
        raise ConfigError(f"unknown metric {metric!r}")
    from cadenza.session import with_checkpoints

    with_checkpoints(df.sparkSession)
    side = eps / (len(cols) ** 0.5 if metric == "euclidean" else len(cols)) * (1 - 1e-9)
    at = [f"_x{i}" for i in range(len(cols))]
    cells = lambda step: F.array(*[F.floor(F.col(c) / step).cast("bigint") for c in at])
    rows = df.select(F.col(node).alias("_node"), *[F.col(c).alias(x) for c, x in zip(cols, at, strict=True)]).dropna(subset=at)
    places = rows.groupBy(*at).agg(F.min("_node").alias("a"), F.count("*").alias("n")).select("a", "n", F.array(*at).alias("x"), cells(eps).alias("c"), cells(side).alias("s")).checkpoint()
    shifts = [[]]
    for _ in cols:
        shifts = [[*s, d] for s in shifts for d in (-1, 0, 1)]
    around = F.explode(F.array(*[F.array(*[F.col("c")[i] + d for i, d in enumerate(s)]) for s in shifts]))

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        q = right.withColumnsRenamed({"a": "b", "x": "y", "s": "t", "n": "m"}).withColumn("c", around)
        return left.join(q, "c").withColumn("d", dist).where(F.col("d") <= eps)

    full = places.groupBy("s").agg((F.sum("n") >= min_points).alias("full"))
    counted = places.join(full, "s")
    sparse = near(counted.where("not full").select("a", "x", "c"), places.select("a", "x", "c", "n")).groupBy("a").agg(F.sum("m").alias("m")).where(F.col("m") >= min_points).select("a")
    cores = counted.where("full").select("a").union(sparse)
    core = places.join(cores, "a")
    core = core.join(core.groupBy("s").agg(F.min("a").alias("r")), "s").select("a", "r", "x", "c", "s").checkpoint()
    linked = near(core, core.select("a", "x", "c", "s", F.col("r").alias("o"))).where("s < t").groupBy("s", "t").agg(F.first("r").alias("a"), F.first("o").alias("b")).select("a", "b")
    own = core.select(F.col("r").alias("a"), F.col("r").alias("b"))
    both = linked.union(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).union(own).distinct().checkpoint()
    label = own.distinct().select("a", F.col("b").alias("cluster"))
    while True:
        best = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("cluster").alias("m"))
        new = label.join(best, "a").select("a", F.least("cluster", "m").alias("cluster"))
        hop = new.join(new.select(F.col("a").alias("cluster"), F.col("cluster").alias("root")), "cluster").select("a", F.col("root").alias("cluster")).checkpoint()
        if not hop.join(label.withColumnRenamed("cluster", "old"), "a").where("cluster <> old").limit(1).count():
            break
        label = hop
    owned = core.join(label.withColumnRenamed("a", "r"), "r").select("a", "x", "c", "cluster")
    border = near(places.join(cores, "a", "left_anti").select("a", "x", "c"), owned).groupBy("a").agg(F.min_by("cluster", F.struct("d", "b")).alias("cluster"))
    found = places.join(owned.select("a", "cluster").union(border), "a")
    found = found.select(*[F.col("x")[i].alias(c) for i, c in enumerate(cols)], "cluster")
    out = df.join(found, cols, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    return out.select(node, *[c for c in df.columns if c != node], "cluster")


def classify_edges(lab: np.ndarray, names: list[str], centres: np.ndarray) -> list[str]:
    """User labels given in the order of the centres."""
    o = np.argsort(centres[:, 0] if centres.ndim > 1 else centres)
    to = {int(c): names[i] for i, c in enumerate(o) if i < len(names)}
    return [to.get(int(v), "noise" if v < 0 else str(int(v))) for v in lab]

