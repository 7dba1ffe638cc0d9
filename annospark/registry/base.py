"""Where queries register themselves with their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from annospark import fixtures as fx
from annospark.operators import acceptance as ac, density

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables a query reads, derived from one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def images(self):
        return fx.images(self.spark, self.sf_dir)

    @cached_property
    def candidates(self):
        return fx.candidates(self.spark, self.sf_dir)

    @cached_property
    def gold(self):
        return fx.gold(self.spark, self.sf_dir)

    @cached_property
    def gold_sized(self):
        """Ground truth with the image size, which is the same for all images here."""
        return self.gold.withColumns({"width": F.lit(fx.WIDTH), "height": F.lit(fx.HEIGHT)})

    @cached_property
    def human(self):
        return fx.human_boxes(self.spark, self.sf_dir)

    @cached_property
    def ownership(self):
        return fx.ownership(self.spark, self.sf_dir)

    @cached_property
    def pool(self):
        """Raw candidates of the images no human owns, scored by the validator."""
        return ac.with_score(self.candidates.where(F.col("image_id") % 20 != 0))

    @cached_property
    def seed(self) -> ac.Seed:
        return ac.Seed.of(density.seed_density(density.seed_counts(self.human), 1, 1))

    @cached_property
    def classes(self):
        """Names of all classes but the last, so that a label without a name occurs."""
        return self.spark.createDataFrame([(0, "cat"), (1, "dog"), (2, "bird")], "cls int, name string")

    def table(self, name: str):
        return fx.table(self.spark, self.sf_dir, name)


def register(name: str, sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add
