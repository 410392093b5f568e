"""Models on feature tables: classifiers chosen by balanced accuracy, least squares with its tests, imputation, splits."""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.columns import mixer


def split(df: DataFrame, key: str, parts: tuple[int, int] = (70, 15), seed: int = 42) -> DataFrame:
    """Adds part (train, valid, test) by the key: rows of one key stay together; parts in percent, the rest is test."""
    m = mixer(F.xxhash64(key) % 1_000_000_007, seed) % 100
    return df.withColumn("part", F.when(m < parts[0], "train").when(m < sum(parts), "valid").otherwise("test"))


def folds(df: DataFrame, key: str, k: int, by: str | None = None, seed: int = 42) -> DataFrame:
    """Adds fold 0..k-1; with `by`, every label's rows are dealt out evenly."""
    if by is None:
        return df.withColumn("fold", (mixer(F.xxhash64(key) % 1_000_000_007, seed) % k).cast("int"))
    w = Window.partitionBy(by).orderBy(mixer(F.xxhash64(key) % 1_000_000_007, seed), key)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def balanced_accuracy(df: DataFrame, truth: str = "label", guess: str = "prediction") -> float:
    r = df.groupBy(truth).agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("r")).agg(F.avg("r")).first()[0]
    return float(r) if r is not None else 0.0


def classifiers(width: int, classes: int, seed: int = 42) -> dict:
    common = {"featuresCol": "_v", "labelCol": "label"}
    out = {
        "logistic": LogisticRegression(**common, elasticNetParam=0.5, regParam=0.01, maxIter=50),
        "forest": RandomForestClassifier(**common, numTrees=50, seed=seed),
        "bottleneck": MultilayerPerceptronClassifier(**common, layers=[width, 32, 16, classes], maxIter=40, seed=seed),
        "margin": OneVsRest(classifier=LinearSVC(maxIter=20), **common),
    }
    if classes == 2:
        out["boosting"] = GBTClassifier(**common, maxIter=20, seed=seed)
    return out


def choose_classifier(df: DataFrame, x: str = "x", names: tuple[str, ...] | None = None, seed: int = 42) -> DataFrame:
    """df(id, x, label from 0, part) to model, valid, test: balanced accuracies, best on the validation part first."""
    v = df.withColumn("_v", array_to_vector(F.transform(x, lambda z: z.cast("double")))).withColumn("label", F.col("label").cast("double")).select("_v", "label", "part").persist()
    classes, width = int(v.agg(F.max("label")).first()[0]) + 1, len(df.select(x).first()[0])
    rows = []
    for name, est in classifiers(width, classes, seed).items():
        if names is None or name in names:
            model = est.fit(v.filter("part = 'train'"))
            rows.append((name, *[balanced_accuracy(model.transform(v.filter(F.col("part") == p))) for p in ("valid", "test")]))
    v.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, valid double, test double").orderBy(F.desc("valid"), "model")


def least_squares(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """term, coefficient, t, and of the whole fit r2, r2_adjusted, f, n (repeated on each row)."""
    clean = df.select(target, *features).dropna().withColumn("_v", array_to_vector(F.array(*[F.col(c).cast("double") for c in features])))
    m = LinearRegression(featuresCol="_v", labelCol=target, solver="normal").fit(clean)
    s = m.summary
    n, p = s.numInstances, len(features)
    f = s.r2 / p / ((1 - s.r2) / (n - p - 1)) if s.r2 < 1 else math.inf
    beta = [*m.coefficients.toArray().tolist(), m.intercept]
    rows = [(name, float(b), float(t), float(s.r2), float(s.r2adj), float(f), int(n)) for name, b, t in zip([*features, "intercept"], beta, s.tValues, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, t double, r2 double, r2_adjusted double, f double, n bigint")


def forest_regression(df: DataFrame, features: list[str], target: str, seed: int = 42) -> DataFrame:
    """feature, importance."""
    v = df.select(F.col(target).cast("double").alias("label"), array_to_vector(F.array(*[F.col(c).cast("double") for c in features])).alias("features"))
    m = RandomForestRegressor(numTrees=30, seed=seed).fit(v)
    return df.sparkSession.createDataFrame(list(zip(features, [float(x) for x in m.featureImportances.toArray()], strict=True)), "feature string, importance double")


def imputed(df: DataFrame, columns: list[str], rounds: int = 3) -> DataFrame:
    """Missing numbers filled by chained regressions: first the median, then each column in turn predicted from the others,
    fitted where it was there. Columns without any value stay null; NaN counts as missing."""
    clean = df.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns})
    gone = {r: n for r, n in clean.agg(*[F.count(c).alias(c) for c in columns]).first().asDict().items()}
    use = [c for c in columns if gone[c]]
    flagged = clean.withColumns({f"_{c}_m": F.col(c).isNull() for c in use})
    out = Imputer(strategy="median", inputCols=use, outputCols=[f"_{c}_f" for c in use]).fit(flagged).transform(flagged).drop(*use).withColumnsRenamed({f"_{c}_f": c for c in use})
    missing = [c for c in use if gone[c] < df.count()]
    for _ in range(rounds if len(use) > 1 else 0):
        for c in missing:
            others = [o for o in use if o != c]
            v = out.withColumn("_v", array_to_vector(F.array(*others)))
            m = LinearRegression(featuresCol="_v", labelCol=c, regParam=1e-6, solver="normal").fit(v.filter(~F.col(f"_{c}_m")))
            guess = F.lit(float(m.intercept))
            for o, b in zip(others, m.coefficients.toArray().tolist(), strict=True):
                guess = guess + F.col(o) * float(b)
            out = out.withColumn(c, F.when(F.col(f"_{c}_m"), guess).otherwise(F.col(c)))
    return out.drop(*[f"_{c}_m" for c in use])
