"""Quality of predictions and clusterings, as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators.series import present, running_sums
from quernel.sources.shared import materialize


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count("*"))).alias("r2"))


def ranking_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Average precision (steps, no trapezoids), ROC area and Brier score, from counts of each distinct score and the rows below it. Scores are computed once, and
    only their counts go on."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(y).cast("long").alias("y"), (-F.col(p).cast("double")).alias("s"))
    counted = materialize(rows.groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("pos")), "score-counts")
    c = running_sums(present(counted, "s"), "s", ["n", "pos"]).withColumnsRenamed({"before_n": "n_before", "before_pos": "pos_before"})
    totals = counted.agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    c = c.crossJoin(F.broadcast(totals))  # one row
    neg = F.col("n") - F.col("pos")
    negatives_before = F.col("n_before") - F.col("pos_before")
    out = c.groupBy("all_pos", "all_n").agg(
        F.sum(F.when(F.col("pos") > 0, F.col("pos") / F.col("all_pos") * (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))).otherwise(0.0)).alias("ap"),
        # pairs of a positive and a negative with the positive first: all pairs but those where the negative is ahead, ties half
        (1 - F.sum(F.when(F.col("pos") > 0, F.col("pos") * (negatives_before + neg / 2)).otherwise(0.0)) / (F.col("all_pos") * (F.col("all_n") - F.col("all_pos")))).alias("auc"),
        (F.sum(F.col("pos") * F.pow(1 + F.col("s"), F.lit(2.0)) + neg * F.pow("s", F.lit(2.0))) / F.col("all_n")).alias("brier"),
    )
    return out.select(F.col("all_n").alias("n"), F.col("all_pos").alias("positives"), "ap", "auc", "brier")


def threshold_metrics(df: DataFrame, y: str, p: str, thresholds: Sequence[float]) -> DataFrame:
    """Counts, precision, recall, F1, false positive and alarm rate at each threshold; rows meet the thresholds as an array, and only sums are shuffled."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(y).cast("int").alias("y"), F.col(p).alias("p"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    on = F.col("p") >= F.col("threshold")
    c = rows.groupBy("threshold").agg(F.sum((on & (F.col("y") == 1)).cast("long")).alias("tp"), F.sum((on & (F.col("y") == 0)).cast("long")).alias("fp"), F.sum((~on & (F.col("y") == 1)).cast("long")).alias("fn"), F.sum((~on & (F.col("y") == 0)).cast("long")).alias("tn"))

    def part(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1": part(2 * tp, 2 * tp + fp + fn), "fpr": part(fp, fp + tn), "alarm_rate": part(tp + fp, tp + fp + fn + tn)})


def best_f1(scan: DataFrame) -> DataFrame:
    return scan.groupBy().agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", "precision", -F.col("threshold"))).alias("b")).where("b is not null").select("b.*")


def cluster_quality(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from sums of each cluster; centres are one row a cluster."""
    n = len(features)
    c = df.groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)])
    centres = c.select("c", "n", F.array(*[F.col(f"m{i}") for i in range(n)]).alias("m"))
    g = df.agg(F.array(*[F.avg(f) for f in features]).alias("g"), F.count("*").alias("nn"))

    def square(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)

    rows = df.select(F.col(cluster).alias("c"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")).join(F.broadcast(centres), "c")
    inside = rows.groupBy("c").agg(F.sum(square(F.col("x"), F.col("m"))).alias("w"), F.avg(F.sqrt(square(F.col("x"), F.col("m")))).alias("s"))
    stats = centres.join(inside, "c").crossJoin(F.broadcast(g))
    ch = stats.agg(((F.sum(F.col("n") * square(F.col("m"), F.col("g"))) / (F.count("*") - 1)) / (F.sum("w") / (F.first("nn") - F.count("*")))).alias("calinski_harabasz"))
    a, b = stats.select("c", "m", "s").alias("a"), stats.select("c", "m", "s").alias("b")  # one row a cluster
    ratio = (F.col("a.s") + F.col("b.s")) / F.sqrt(square(F.col("a.m"), F.col("b.m")))
    db = a.join(b, F.col("a.c") != F.col("b.c")).groupBy("a.c").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    return ch.crossJoin(db)


def silhouette(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """One row: mean silhouette of squared distances, and the least and largest number of rows in a cluster. The mean squared distance of a row to a cluster follows from the cluster's
    mean and mean square, so no pairs of rows are formed. Rows with a null feature don't count; the silhouette is null for one cluster, or where a cluster has one row."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.where(F.lit(True) if not features else ~F.exists(x, lambda v: v.isNull())).select(F.col(cluster).alias("c"), x.alias("x"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    means = [F.avg(F.col("x")[i]) for i in range(len(features))]
    shift = rows.agg(F.array(*means).alias("g"))  # one row; centred rows keep their digits
    rows = rows.crossJoin(F.broadcast(shift)).select("c", F.zip_with("x", "g", lambda p, q: p - q).alias("x"))
    each = rows.groupBy("c").agg(F.count("*").cast("double").alias("n"), F.array(*means).alias("m"), F.avg(dot(F.col("x"), F.col("x"))).alias("q"))
    side = each.agg(F.collect_list(F.struct("c", "n", "m", "q")).alias("cs"), F.min("n").cast("long").alias("min_size"), F.max("n").cast("long").alias("max_size"))  # one row, of the clusters
    far = lambda k: dot(F.col("x"), F.col("x")) - 2 * dot(F.col("x"), k["m"]) + k["q"]
    met = rows.crossJoin(F.broadcast(side)).select(
        F.element_at(F.transform(F.filter("cs", lambda k: k["c"].eqNullSafe(F.col("c"))), lambda k: F.try_divide(far(k) * k["n"], k["n"] - 1)), 1).alias("a"),
        F.array_min(F.transform(F.filter("cs", lambda k: ~k["c"].eqNullSafe(F.col("c"))), far)).alias("b"),
    )
    mean = met.agg(F.avg(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))).alias("silhouette"))
    fine = (F.size("cs") > 1) & (F.col("min_size") > 1)
    return mean.crossJoin(F.broadcast(side)).select(F.when(fine, F.col("silhouette")).alias("silhouette"), "min_size", "max_size")


def cluster_scores(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """One row: what ``silhouette`` and ``cluster_quality`` give, in two passes over rows without nulls whose features are centred: means of each cluster, then distances to them."""
    dot = lambda a, b: sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    part = lambda c: [c[i] for i in range(len(features))]
    far = lambda a, b: dot(*[[x - y for x, y in zip(a, b, strict=True)]] * 2)
    x = [F.col(f).cast("double") for f in features]
    each = df.groupBy(F.col(cluster).alias("c")).agg(F.count("*").cast("double").alias("n"), F.array(*[F.avg(v) for v in x]).alias("m"), F.avg(dot(x, x)).alias("q"))
    each = materialize(each, "cluster-means")  # a row a cluster
    side = each.agg(F.collect_list(F.struct("c", "n", "m", "q")).alias("cs"))
    mean_square = lambda k: dot(x, x) - 2 * dot(x, part(k["m"])) + k["q"]
    own = F.element_at(F.filter("cs", lambda k: k["c"].eqNullSafe(F.col("c"))), 1)
    met = df.withColumn("c", F.col(cluster)).crossJoin(F.broadcast(side)).withColumn("own", own)
    met = met.select("c", F.try_divide(mean_square(F.col("own")) * F.col("own.n"), F.col("own.n") - 1).alias("a"), F.array_min(F.transform(F.filter("cs", lambda k: ~k["c"].eqNullSafe(F.col("c"))), mean_square)).alias("b"), far(x, part(F.col("own.m"))).alias("d"))
    share = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    sums = met.groupBy("c").agg(F.sum(share).alias("shares"), F.count(share).alias("shared"), F.sum("d").alias("w"), F.avg(F.sqrt("d")).alias("s"))
    stats = materialize(each.join(sums, each["c"].eqNullSafe(sums["c"])).drop(sums["c"]), "cluster-sums")
    total = stats.agg(F.sum("n").alias("nn"), F.array(*[F.sum(F.col("n") * F.col("m")[i]) / F.sum("n") for i in range(len(features))]).alias("g"))
    fine = (F.count("*") > 1) & (F.min("n") > 1)
    between = F.try_divide(F.sum(F.col("n") * far(part(F.col("m")), part(F.col("g")))), F.count("*") - 1)
    out = stats.crossJoin(F.broadcast(total)).agg(
        F.when(fine, F.try_divide(F.sum("shares"), F.sum("shared"))).alias("silhouette"), F.min("n").cast("long").alias("min_size"), F.max("n").cast("long").alias("max_size"),
        F.try_divide(between * (F.first("nn") - F.count("*")), F.sum("w")).alias("calinski_harabasz"),
    )
    a, b = stats.select("c", "m", "s").alias("a"), stats.select("c", "m", "s").alias("b")  # one row a cluster
    ratio = F.try_divide(F.col("a.s") + F.col("b.s"), F.sqrt(far(part(F.col("a.m")), part(F.col("b.m")))))
    return out.crossJoin(a.join(b, F.col("a.c") != F.col("b.c")).groupBy("a.c").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin")))


def choose_clustering(sweep: DataFrame) -> DataFrame:
    """The row of ``ml.sweep_clusters`` (one a kind and k) that passes the gates of size, stability, separation of the labels and silhouette, and has the best sum of ranks; no row where none passes."""
    apart = (F.col("label_range") >= 0.05) | (F.col("high_range") >= 0.05)
    usable = sweep.where(~F.col("tiny") & (F.col("stability") >= 0.7) & apart & (F.col("silhouette") > 0.03))
    # average ranks as shares, over the few rows of the sweep
    share = lambda c: (F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2) / F.count("*").over(Window.partitionBy())
    score = share("silhouette") + share("stability") + share("high_range") + share("label_range") - share("davies_bouldin")
    return usable.withColumn("score", score).orderBy(F.desc("score"), F.desc("silhouette"), "kind", "k").limit(1)


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two clusterings of the same rows, from their contingency counts; null where both put all rows into one cluster."""
    def pairs(c: Column) -> Column:
        return c * (c - 1) / 2

    t = materialize(df.groupBy(a, b).count(), "contingency")  # a row a pair of clusters, read three times
    s = t.agg(F.sum(pairs(F.col("count"))).alias("i"), F.sum("count").alias("n"))
    for name, side in (("x", a), ("y", b)):
        s = s.crossJoin(t.groupBy(side).agg(F.sum("count").alias("c")).agg(F.sum(pairs(F.col("c"))).alias(name)))
    expected = F.col("x") * F.col("y") / pairs(F.col("n"))
    return s.select(F.try_divide(F.col("i") - expected, (F.col("x") + F.col("y")) / 2 - expected).alias("ari"))
