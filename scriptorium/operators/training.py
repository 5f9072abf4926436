"""Training of simple classifiers on feature rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators.corpus import split_of
from scriptorium.operators.scoring import VECTOR


def fit(rows: DataFrame, label: str = "label", regularisation: float = 5e-4, iterations: int = 60):
    """M5: logistic regression over all rows, by distributed quasi-Newton steps instead of ordered gradient steps."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=list(VECTOR), outputCol="_x").transform(rows)
    return LogisticRegression(featuresCol="_x", labelCol=label, regParam=regularisation, maxIter=iterations).fit(vectors)


def fit_and_score(rows: DataFrame, id_col: str = "doc_id", label: str = "label", seed: str = "s1") -> DataFrame:
    """M1-M7: fits on the rows that the hash split calls train, scores all: id, split, label, probability, prediction."""
    parts = rows.withColumn("split", split_of(F.col(id_col), seed))
    model = fit(parts.filter("split = 'train'"), label)
    z = X.dot(F.array(*[F.col(c) for c in VECTOR]), F.array(*[F.lit(float(w)) for w in model.coefficients])) + float(model.intercept)
    p = X.sigmoid(z)
    return parts.select(id_col, "split", label, F.round(p, 6).alias("probability"), (p >= 0.5).cast("int").alias("prediction"))


def losses(rows: DataFrame, label: str = "label", **settings) -> DataFrame:
    """M6: iteration, loss of a training run over the rows; as many rows as iterations."""
    history = fit(rows, label, **settings).summary.objectiveHistory
    return rows.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(history)], "iteration int, loss double")


def append_lineage(rows: DataFrame, path: str, model: dict, metrics: dict, at: str) -> None:
    """M9: one JSON line per training run, with a digest of the model."""
    spark = rows.sparkSession
    text = json.dumps(model, sort_keys=True)
    spark.createDataFrame([(at, text, json.dumps(metrics, sort_keys=True))], "at string, model string, metrics string").withColumn("digest", F.sha2("model", 256)).write.mode("append").json(path)
