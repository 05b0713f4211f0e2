"""Models: boosted trees, screens, selection, reduction and clustering, by Spark's own library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.scalars import label_flags
from quernel.operators.aggregates import correlations, unpivot
from quernel.operators.series import quantiles
from quernel.sources.shared import materialize


def _prepare(features: Sequence[str]) -> list:
    filled = [f"__{f}" for f in features]
    return [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__x")]


#: Training rows of one task, which holds them through all rounds.
FIT_ROWS = 250_000


def _dealt(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of a large training table dealt out evenly, so that a task's share doesn't grow with the table."""
    parts = -(-train.count() // FIT_ROWS)
    train = train.select(*dict.fromkeys(columns))
    return train if parts <= 1 else train.repartition(parts)


def fit_trees(train: DataFrame, features: Sequence[str], target: str, kind: str = "regression", seed: int = 0, rounds: int = 20, depth: int = 3) -> PipelineModel:
    """Boosted trees on median-filled features. A binary target of one class gives a model of its share."""
    if kind == "regression":
        model = GBTRegressor(featuresCol="__x", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)
    elif train.select(target).distinct().limit(2).count() < 2:
        model = GBTRegressor(featuresCol="__x", labelCol=target, maxIter=1, maxDepth=1, seed=seed)
    else:
        model = GBTClassifier(featuresCol="__x", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*_prepare(features), model]).fit(_dealt(train, [*features, target]))


def fit_logistic(train: DataFrame, features: Sequence[str], target: str) -> PipelineModel:
    return Pipeline(stages=[*_prepare(features), LogisticRegression(featuresCol="__x", labelCol=target, maxIter=50)]).fit(train)


def predict(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    """Adds the probability of 1, or the predicted value."""
    scored = model.transform(df)
    p = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    return scored.withColumn(out, p).select(*df.columns, out)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def select_features(train: DataFrame, features: Sequence[str], targets: Sequence[str], top: int, core: Sequence[str] = ()) -> DataFrame:
    """Features by mean absolute Spearman correlation with the targets, the core ones always: ``(feature, score, place)``."""
    r = correlations(train, [(f, t) for f in features for t in targets], "spearman", 30)
    s = r.groupBy(F.col("x").alias("feature")).agg(F.coalesce(F.avg(F.abs("r")), F.lit(0.0)).alias("score"))
    s = s.withColumn("is_core", F.col("feature").isin(*core) if core else F.lit(False))
    return s.orderBy(F.desc("is_core"), F.desc("score"), "feature").limit(max(top, len(core)))


def audit_features(df: DataFrame, features: Sequence[str], most_missing: float = 0.4) -> DataFrame:
    """Missing rate, deviation and share of far outliers of each feature, and whether it may be used."""
    long = unpivot(df, [], features)
    q = long.groupBy("feature").agg(F.count("*").alias("rows"), F.count("value").alias("n"), F.stddev_samp("value").alias("std")).join(quantiles(long, "value", (0.25, 0.5, 0.75), ["feature"]), "feature", "left")
    z = F.abs(F.col("value") - F.col("q")[1]) / F.nullif(F.col("q")[2] - F.col("q")[0], F.lit(0.0))
    far = long.join(q.select("feature", "q"), "feature").groupBy("feature").agg(F.coalesce(F.avg((z > 5).cast("int")), F.lit(0.0)).alias("outlier_rate"))
    out = q.join(far, "feature").withColumn("missing_rate", 1 - F.col("n") / F.col("rows"))
    return out.select("feature", "missing_rate", "std", "outlier_rate", ((F.col("missing_rate") <= most_missing) & (F.col("std") > 1e-9)).alias("usable"))


def decorrelate(df: DataFrame, features: Sequence[str], core: Sequence[str] = (), most: float = 0.95) -> list[str]:
    """Features kept in order, core first, when none kept before correlates beyond ``most``. The matrix has a row for each feature, some hundred at most."""
    ordered = [*[f for f in features if f in core], *[f for f in features if f not in core]]
    x = Pipeline(stages=_prepare(ordered)).fit(df).transform(df)
    m = Correlation.corr(x, "__x").first()[0].toArray()
    kept: list[int] = []
    for i in range(len(ordered)):
        if all(not abs(m[i, j]) > most for j in kept):
            kept.append(i)
    return [ordered[i] for i in kept]


def reduce(df: DataFrame, features: Sequence[str], variance: float = 0.9, most: int = 15) -> tuple[DataFrame, int]:
    """Standardised and projected to the first components that explain ``variance``: adds ``pcs``."""
    scaled = Pipeline(stages=[*_prepare(features), StandardScaler(inputCol="__x", outputCol="__z", withMean=True)]).fit(df).transform(df)
    k = min(most, len(features))
    model = PCA(k=k, inputCol="__z", outputCol="__p").fit(scaled)
    explained, total = model.explainedVariance.toArray(), 0.0
    for n, e in enumerate(explained, 1):
        total += e
        if total >= variance:
            break
    out = model.transform(scaled).withColumn("pcs", F.slice(vector_to_array("__p"), 1, n))
    return out.select(*df.columns, "pcs"), n


def _clusterer(kind: str, k: int, seed: int) -> KMeans | GaussianMixture | BisectingKMeans:
    return {"kmeans": KMeans, "mixture": GaussianMixture, "bisecting": BisectingKMeans}[kind](featuresCol="__z", predictionCol="cluster", k=k, seed=seed)


def cluster(df: DataFrame, features: Sequence[str], k: int, kind: str = "kmeans", seed: int = 0) -> DataFrame:
    """Adds ``cluster`` from standardised features: kmeans, mixture or bisecting."""
    stages = [*_prepare(features), StandardScaler(inputCol="__x", outputCol="__z", withMean=True), _clusterer(kind, k, seed)]
    return Pipeline(stages=stages).fit(df).transform(df).select(*df.columns, "cluster")


def sweep_clusters(df: DataFrame, features: Sequence[str], label: str, ks: Sequence[int] = range(2, 11), seeds: Sequence[int] = (0, 1, 2, 3, 4), kinds: Sequence[str] = ("kmeans", "mixture", "bisecting")) -> DataFrame:
    """A row for each kind and number of clusters: agreement of the seeds' assignments (``stability``, 1 for one seed), size gate (``tiny``: a cluster of some seed under 30 rows or 5 % of
    all), means over the seeds of silhouette, Calinski-Harabasz, Davies-Bouldin, and of the ranges over clusters of the label's mean and its high and ok rates. Metrics are of standardised features,
    missing ones filled by medians; they are written once, dealt out, and so are assignments for each kind and k."""
    from quernel.operators.metrics import adjusted_rand, cluster_scores

    scaled = Pipeline(stages=[*_prepare(features), StandardScaler(inputCol="__x", outputCol="__z", withMean=True)]).fit(df).transform(df)
    z = [f"__z{i}" for i in range(len(features))]
    base = scaled.withColumn("__a", vector_to_array("__z")).select("__z", F.col(label).cast("double").alias("__label"), *[F.col("__a")[i].alias(c) for i, c in enumerate(z)])
    base = base.withColumns(label_flags(F.col("__label")))
    base = materialize(_dealt(base, base.columns), "sweep-rows")
    out = None
    for kind in kinds:
        for k in ks:
            rows = base
            for s in seeds:
                rows = _clusterer(kind, k, s).fit(base.select("__z")).transform(rows).drop("probability").withColumnRenamed("cluster", f"__c{s}")
            rows = materialize(rows.drop("__z"), "sweep-clusters")
            parts = []
            for s in seeds:
                per = rows.groupBy(f"__c{s}").agg(F.avg("__label").alias("m"), F.avg("y_high").alias("h"), F.avg("y_ok").alias("o"))
                spread = per.agg(*[(F.max(c) - F.min(c)).alias(f"{name}_range") for c, name in (("m", "label"), ("h", "high"), ("o", "ok"))])
                parts.append(cluster_scores(rows, f"__c{s}", z).crossJoin(spread))  # each has one row
            each = parts[0]
            for p in parts[1:]:
                each = each.unionByName(p)
            row = each.agg(F.min("min_size").alias("min_size"), *[F.avg(c).alias(c) for c in each.columns if c not in ("min_size", "max_size")], F.avg(F.col("max_size") / F.col("min_size")).alias("imbalance"))
            agreements = None
            for i, s in enumerate(seeds):
                for t in seeds[i + 1 :]:
                    r = adjusted_rand(rows, f"__c{s}", f"__c{t}")
                    agreements = r if agreements is None else agreements.unionByName(r)
            row = row.crossJoin(agreements.agg(F.avg("ari").alias("stability"))) if agreements is not None else row.withColumn("stability", F.lit(1.0))
            row = row.crossJoin(rows.agg(F.greatest(F.lit(30), F.floor(F.count("*") * 0.05)).alias("__least"))).withColumn("tiny", F.col("min_size") < F.col("__least")).drop("__least")
            row = materialize(row.select(F.lit(kind).alias("kind"), F.lit(k).alias("k"), "*"), "sweep-metrics")
            out = row if out is None else out.unionByName(row)
    return out


def incremental_value(train: DataFrame, test: DataFrame, base: Sequence[str], extra: Sequence[str], target: str) -> DataFrame:
    """Ranking metrics on the test rows of a screen with and without each extra feature: one logistic fit a feature."""
    from quernel.operators.metrics import ranking_metrics

    out = None
    for added in (None, *extra):
        cols = [*base, *([added] if added else [])]
        m = ranking_metrics(predict(fit_logistic(train, cols, target), test), target, "p").withColumn("added", F.lit(added or "(base)"))
        out = m if out is None else out.unionByName(m)
    return out


def profile_clusters(df: DataFrame, features: Sequence[str], cluster_col: str = "cluster") -> DataFrame:
    """Each cluster's mean of each feature, its z-score against all rows and its level by their tertiles."""
    long = unpivot(df, [cluster_col], features)
    every = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).join(quantiles(long, "value", (1 / 3, 2 / 3), ["feature"]), "feature", "left")
    per = long.groupBy(cluster_col, "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    joined = per.join(F.broadcast(every), "feature")  # one row a feature
    level = F.when(F.col("mean") <= F.col("q")[0], "low").when(F.col("mean") <= F.col("q")[1], "mid").otherwise("high")
    return joined.select(cluster_col, "feature", "n", "mean", F.when(F.col("s") > 0, (F.col("mean") - F.col("m")) / F.col("s")).alias("z"), level.alias("level"))
