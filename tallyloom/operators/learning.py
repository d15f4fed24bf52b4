"""Character tf-idf features and linear classifiers over them."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most features, least documents a feature is in.
FEATURES, LEAST = 50_000, 2


def char_grams(df: DataFrame, text: str, out: str = "grams") -> DataFrame:
    """All character 1-grams and 2-grams of a text, in lower case."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_t", t)
    one = F.when(F.length("_t") > 0, F.transform(F.sequence(F.lit(1), F.length("_t")), lambda i: F.substring("_t", i, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    two = F.when(F.length("_t") > 1, F.transform(F.sequence(F.lit(1), F.length("_t") - 1), lambda i: F.substring("_t", i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return df.withColumn(out, F.concat(one, two)).drop("_t")


class TfIdf:
    """Sublinear tf, smoothed idf plus one, unit length."""

    def __init__(self, train: DataFrame, grams: str = "grams"):
        self.grams = grams
        self.counts = CountVectorizer(inputCol=grams, outputCol="_c", vocabSize=FEATURES, minDF=float(LEAST)).fit(train)
        n = train.count()
        per = train.select(F.explode(F.array_distinct(grams)).alias("g")).groupBy("g").agg(F.count("*").alias("df"))
        known = {g: i for i, g in enumerate(self.counts.vocabulary)}  # bounded by FEATURES
        self.idf = np.ones(len(known))
        for r in per.filter(F.col("df") >= LEAST).toLocalIterator():
            if r.g in known:
                self.idf[known[r.g]] = np.log((1 + n) / (1 + r.df)) + 1

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        idf = df.sparkSession.sparkContext.broadcast(self.idf)

        def weigh(v: SparseVector) -> SparseVector:
            if not len(v.indices):
                return v
            x = (1 + np.log(v.values)) * idf.value[v.indices]
            return SparseVector(v.size, v.indices, x / np.sqrt((x * x).sum()))

        # a vector column has no built-in elementwise product with log; rows
        # here are labelled samples and what is scored once
        return self.counts.transform(df).withColumn(out, F.udf(weigh, VectorUDT())("_c")).drop("_c")


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight``: rows of each class weigh alike in sum."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    total, k = n.agg(F.sum("_n")).scalar(), n.agg(F.count("*")).scalar()
    return df.join(F.broadcast(n), label).withColumn("weight", total / (k * F.col("_n"))).drop("_n")


def logistic(train: DataFrame, label: str = "label", iterations: int = 100, strength: float = 1.0):
    """Balanced logistic regression with the usual penalty on unscaled features."""
    n = train.count()
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=iterations, regParam=1.0 / (strength * n), standardization=False).fit(balanced(train, label))


def support_vectors(train: DataFrame, label: str = "label", iterations: int = 50, strength: float = 1.0):
    """Balanced linear support vector machine."""
    n = train.count()
    return LinearSVC(featuresCol="features", labelCol=label, weightCol="weight", maxIter=iterations, regParam=1.0 / (strength * n), standardization=False).fit(balanced(train, label))


def scored(model, df: DataFrame) -> DataFrame:
    """Add ``pred_label``, ``pred_prob`` and ``anger_prob``; a model without probabilities gets its margin's sigmoid."""
    d = model.transform(df)
    if "probability" in d.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))
    d = d.withColumn("anger_prob", p)
    return d.withColumns({"pred_label": (F.col("anger_prob") >= 0.5).cast("int"), "pred_prob": F.greatest("anger_prob", 1 - F.col("anger_prob"))}).drop("rawPrediction", "probability", "prediction", "features")
