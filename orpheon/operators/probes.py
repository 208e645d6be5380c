"""Probes on frozen embeddings with pyspark.ml: linear and multilayer heads, one for each layer if asked."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _features(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))


def linear_probe(train: DataFrame, test: DataFrame, vec: str, label: str, reg: float = 1e-3, iterations: int = 50) -> DataFrame:
    """test with `prediction` by multinomial logistic regression; training is distributed by partition."""
    model = LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, maxIter=iterations).fit(_features(train, vec))
    return model.transform(_features(test, vec)).drop("features", "rawPrediction", "probability")


def mlp_probe(train: DataFrame, test: DataFrame, vec: str, label: str, layers: list[int], iterations: int = 50, seed: int = 0) -> DataFrame:
    """layers: width of the vector, hidden widths, number of classes."""
    model = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=layers, maxIter=iterations, seed=seed).fit(_features(train, vec))
    return model.transform(_features(test, vec)).drop("features", "rawPrediction", "probability")


def regression_probe(train: DataFrame, test: DataFrame, vec: str, target: str, reg: float = 1e-3) -> DataFrame:
    model = LinearRegression(featuresCol="features", labelCol=target, regParam=reg).fit(_features(train, vec))
    return model.transform(_features(test, vec)).drop("features")


def per_layer_heads(train: DataFrame, test: DataFrame, layer: str, vec: str, label: str, layers: list[int]) -> DataFrame:
    """(layer, n, accuracy) of a linear head for each layer; layers are few, rows of a layer stay distributed."""
    out = None
    for k in layers:
        found = linear_probe(train.where(F.col(layer) == k), test.where(F.col(layer) == k), vec, label)
        row = found.agg(F.lit(k).alias("layer"), F.count("*").alias("n"), F.avg((F.col("prediction") == F.col(label)).cast("int")).alias("accuracy"))
        out = row if out is None else out.union(row)
    return out


def fixed_linear(vec, weights: list[list[float]], bias: list[float]):
    """A matrix product with given weights, as array expressions."""
    from orpheon.functions.vectors import dot

    rows = [dot(vec, F.array(*(F.lit(float(x)) for x in w))) + float(b) for w, b in zip(weights, bias, strict=True)]
    return F.array(*rows)
