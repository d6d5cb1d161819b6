"""Survey statistics: contingency, chi-square with continuity correction, logistic regression, scaling, clusters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def phi(df: DataFrame, a: str, b: str) -> DataFrame:
    """Matthews correlation of two 0/1 columns: Pearson's."""
    return df.agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("phi"))


def chi2_tail(x):
    """Upper tail at one degree of freedom; a scalar a group, so no hot path."""
    return F.udf(lambda v: None if v is None else math.erfc(math.sqrt(v / 2)), "double")(x)


def chi_square_yates(df: DataFrame, row: str, col: str) -> DataFrame:
    """One row: chi2 with Yates' correction of a 2x2 table of booleans, and p."""
    r, c = F.col(row).cast("boolean"), F.col(col).cast("boolean")
    t = df.agg(F.count_if(r & c).alias("a"), F.count_if(r & ~c).alias("b"), F.count_if(~r & c).alias("c"), F.count_if(~r & ~c).alias("d"))
    t = t.select(*(F.col(x).cast("double").alias(x) for x in "abcd")).withColumn("n", F.expr("a + b + c + d"))
    chi = F.expr("n * pow(greatest(abs(a * d - b * c) - n / 2, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d))").alias("chi2")
    return t.select("n", chi).withColumn("p", chi2_tail("chi2"))


def crosstab_share(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, n, pct): counts and percentages within the row."""
    from pyspark.sql import Window

    g = df.groupBy(row, col).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(row)))


def zscore(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Population-scaled columns; a constant column gives 0. Moments are aggregated, then joined back as one row (or a row a group)."""
    moments = [x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    m = (df.groupBy(by) if by else df).agg(*moments)
    joined = df.join(m, by) if by else df.join(F.broadcast(m))  # one row
    z = {f"z_{c}": F.when(F.col(f"_s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}
    return joined.withColumns(z).drop(*(x for c in columns for x in (f"_m_{c}", f"_s_{c}")))


def _vector(df: DataFrame, features: list[str]):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def logistic(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(term, coefficient, p_value) of an unpenalised fit."""
    from pyspark.ml.regression import GeneralizedLinearRegression

    m = GeneralizedLinearRegression(family="binomial", link="logit", labelCol=label, regParam=0.0, maxIter=50, tol=1e-10).fit(_vector(df, features))
    p = list(m.summary.pValues)
    rows = [(f, float(c), float(q)) for f, c, q in zip(features, m.coefficients, p)] + [("const", float(m.intercept), float(p[-1]))]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, p_value double")


def kmeans(df: DataFrame, features: list[str], k: int, restarts: int = 10) -> tuple[DataFrame, float]:
    """(rows with cluster, inertia) of the best of several starts; clusters are numbered by falling size."""
    from pyspark.ml.clustering import KMeans

    v = _vector(df, features).persist()
    try:
        models = [KMeans(k=k, seed=s, maxIter=50).fit(v) for s in range(42, 42 + restarts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        sizes = best.summary.clusterSizes
        order = {c: i for i, c in enumerate(sorted(range(k), key=lambda c: -sizes[c]))}
        names = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
        return best.transform(v).withColumn("cluster", names[F.col("prediction")]).drop("features", "prediction"), float(best.summary.trainingCost)
    finally:
        v.unpersist()


def elbow(df: DataFrame, features: list[str], most: int) -> DataFrame:
    """(k, inertia) for 1..most; k = 1 is the sum of squares about the mean."""
    one = df.agg(sum((F.var_pop(f) * F.count(f) for f in features), F.lit(0.0)).alias("x")).first()["x"]
    rows = [(1, float(one))] + [(k, kmeans(df, features, k)[1]) for k in range(2, most + 1)]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")
