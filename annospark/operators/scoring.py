"""The model boundary: a validator in Spark ML and pluggable scorers on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

# Class weights and decision threshold of the proposal validator.
NOISE_WEIGHT, GOOD_WEIGHT, VALIDATOR_CUT = 2.0, 1.0, 0.5


def train_validator(crops: DataFrame, iterations: int = 50, regularisation: float = 0.01):
    """A good/noise classifier on crop features. ``crops`` has ``features array<double>`` and ``y``.

    Noise errors weigh twice: the validator is there to catch bad proposals.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    weighted = crops.select(
        array_to_vector("features").alias("vector"),
        F.col("y").cast("double").alias("y"),
        F.when(F.col("y") == 0, NOISE_WEIGHT).otherwise(GOOD_WEIGHT).alias("weight"),
    )
    trainer = LogisticRegression(
        featuresCol="vector", labelCol="y", weightCol="weight", maxIter=iterations, regParam=regularisation
    )
    return trainer.fit(weighted)


def validate(model, crops: DataFrame) -> DataFrame:
    """Crops with ``p_good`` and the decision ``yhat``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(crops.withColumn("vector", array_to_vector("features")))
    p_good = vector_to_array("probability").getItem(1)
    return scored.withColumn("p_good", p_good).withColumn("yhat", (p_good >= VALIDATOR_CUT).cast("int")).select(
        *crops.columns, "p_good", "yhat"
    )


def score_candidates(crops: DataFrame, load_model: Callable, schema: str) -> DataFrame:
    """Run a user model over crops in Arrow batches.

    ``load_model()`` is called once per task and returns ``predict(pandas frame) -> pandas frame`` with
    columns as in ``schema``.
    """

    def run(batches: Iterator) -> Iterator:
        predict = load_model()
        for batch in batches:
            yield predict(batch)

    return crops.mapInPandas(run, schema)


def best_class(probabilities: Column) -> Column:
    """Index of the largest probability, the first one on ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def assign_class(candidates: DataFrame, probabilities: str = "class_probs") -> DataFrame:
    """Replace the detector's class by the one a crop classifier prefers."""
    return candidates.withColumn("label", best_class(F.col(probabilities)))
