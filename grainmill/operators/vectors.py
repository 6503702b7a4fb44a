"""Nearest codes and density ratios over vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_code(rows: DataFrame, key: str, vector: str, codes: np.ndarray, cosine: bool = False) -> DataFrame:
    """(key, code, distance) of the nearest row of a codebook (a model of fixed size, broadcast): squared distance, or
    1 - cosine. Ties go to the least code. Null vectors, and those of another dimension, give null."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(codes, np.float64))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = shared.value
        unit = book / np.maximum(np.linalg.norm(book, axis=1, keepdims=True), 1e-12)
        for pdf in parts:
            ok = np.array([v is not None and len(v) == book.shape[1] for v in pdf["v"]], bool)
            code, dist = np.full(len(pdf), -1), np.full(len(pdf), np.nan)
            if ok.any():
                z = np.array([np.asarray(v, np.float64) for v in pdf["v"][ok]])
                if cosine:
                    d = 1 - z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12) @ unit.T
                else:
                    d = (z**2).sum(1)[:, None] + (book**2).sum(1) - 2 * z @ book.T
                code[ok] = d.argmin(1)
                dist[ok] = d.min(1)
            yield pd.DataFrame({"k": pdf["k"], "code": pd.array(np.where(ok, code, 0), "Int32").copy(), "distance": dist}).assign(code=lambda x: x["code"].mask(~ok))

    out = rows.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).mapInPandas(run, "k long, code int, distance double")
    return out.select(F.col("k").alias(key), "code", F.when(~F.isnan("distance"), F.col("distance")).alias("distance"))


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): the mean vector of each label."""
    at = rows.where(F.col(vector).isNotNull()).select(label, F.posexplode(vector).alias("i", "x"))
    means = at.groupBy(label, "i").agg(F.avg("x").alias("m"))
    return means.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def density_ratio(rows: DataFrame, label: str, vector: str, sample: int = 20_000, seed: int = 7) -> DataFrame:
    """Adds probability (of label true) and ratio = p / (1 - p), by a logistic regression with balanced classes. It is
    fitted on at most `sample` rows, those with the least hashes, and applied to all."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = rows.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("_y", F.col(label).cast("double"))
    some = ready.orderBy(F.xxhash64(F.col(vector), F.lit(seed))).limit(sample)
    share = some.agg(F.avg("_y")).first()[0]
    weighted = some.withColumn("_w", F.when(F.col("_y") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1e-3, maxIter=50).fit(weighted)
    scored = model.transform(ready).withColumn("probability", vector_to_array("probability")[1])
    return scored.withColumn("ratio", F.col("probability") / (1 - F.col("probability") + 1e-8)).drop("_x", "_y", "rawPrediction", "prediction")
