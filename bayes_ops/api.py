"""Experiment-level API: the operations of the reference service, by name.

Each call resolves the experiment in the registry (unknown name ->
ExperimentNotFound, wrong kind -> WrongKind), reads its current version and
runs the Spark plan; posteriors can go through the result cache.  Results
are DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bayes_ops import kinds
from bayes_ops.operators import cache as C
from bayes_ops.operators import listing
from bayes_ops.sources import registry as R


class Lake:
    """Experiments stored under ``root`` (a shared folder), with a result cache."""

    def __init__(self, spark: SparkSession, root: str, cache: bool = True):
        self.spark, self.root = spark, root.rstrip("/")
        self.cache_path = self.root + "/_results" if cache else None
        R.init_registry(spark, self.root)

    # -- table lifecycle -------------------------------------------------
    def create(self, name: str, kind: str, display_name: str, data: DataFrame) -> int:
        return R.create_experiment(self.spark, self.root, name, kind, display_name, data)

    def append(self, name: str, batch: DataFrame) -> tuple[int, DataFrame]:
        return R.append_events(self.spark, self.root, name, batch)

    def list(self, kind: str | None = None) -> DataFrame:
        return R.list_experiments(self.spark, self.root, kind)

    def schema(self, kind: str | None = None) -> DataFrame:
        return R.kind_schemas(self.spark, kind)

    def drop(self, name: str) -> None:
        R.drop_experiment(self.spark, self.root, name)

    def table(self, name: str, kind: str | None = None) -> DataFrame:
        return R.read_experiment(self.spark, self.root, name, kind)

    def inspect(self, name: str, start=None, end=None, limit: int = 100, offset: int = 0) -> DataFrame:
        return listing.inspect(self.table(name), start, end, limit, offset)

    # -- Poisson cohort events -------------------------------------------
    def list_events(self, name: str, **kw) -> DataFrame:
        return listing.list_events(self.table(name, "poisson-cohorts"), **kw)

    def delete_events(self, name: str, cohort=None, event_type=None, start=None, end=None) -> int:
        R.lookup(self.spark, self.root, name, "poisson-cohorts")
        return R.delete_by_filter(self.spark, self.root, name, {"cohort": cohort, "event_type": event_type},
                                  start, end)

    # -- posteriors ------------------------------------------------------
    def posterior(self, name: str, kind: str | None = None, use_cache: bool = True, **params) -> DataFrame:
        row = R.lookup(self.spark, self.root, name, kind)
        df = self.table(name)
        fit = lambda d: kinds.posterior(row["type"], d, **params)
        if not (use_cache and self.cache_path):
            return fit(df)
        result, _ = C.get_or_compute(self.spark, self.cache_path, name, row["type"], df, fit, params)
        return result

    def next_arm(self, name: str) -> DataFrame:
        from bayes_ops.plans.bandit import next_arm
        return next_arm(self.table(name, "multi-armed-bandits"))

    def cached(self, name: str) -> DataFrame:
        return C.list_cached(self.spark, self.cache_path, name)

    def clear_cache(self, name: str) -> int:
        return C.clear_cached(self.spark, self.cache_path, name)
