"""Registry lifecycle, ingest validation, fingerprint and result cache."""

import json
import os

import pytest
from pyspark.sql import functions as F

from bayes_ops.operators import cache as C
from bayes_ops.sources import registry as R
from bayes_ops.sources.ingest import SchemaMismatch, split
from bayes_ops.functions.timefmt import parse_timestamp


def _ab_rows(spark, rows):
    return spark.createDataFrame(rows, "timestamp string, variant string, outcome string")


def test_registry_lifecycle(spark, workdir):
    root = os.path.join(workdir, "lake")
    R.init_registry(spark, root)
    assert R.list_tables(spark, root) == []
    n = R.create_experiment(spark, root, "exp1", "ab-test", "Exp 1",
                            _ab_rows(spark, [("2024-01-01 00:00:00", "A", "1"), ("2024-01-02 00:00:00", "B", "0")]))
    assert n == 2
    with pytest.raises(R.AlreadyExists):
        R.create_experiment(spark, root, "exp1", "ab-test", "dup", _ab_rows(spark, [("2024-01-01", "A", "1")]))
    with pytest.raises(ValueError):
        R.create_experiment(spark, root, "empty", "ab-test", "e", _ab_rows(spark, []))
    lst = R.list_experiments(spark, root).collect()
    assert [(r.name, r.type, r.status) for r in lst] == [("exp1", "ab-test", "created")]
    assert len(lst[0].created_at) == 26 and lst[0].created_at[10] == "T"
    with pytest.raises(R.WrongKind):
        R.lookup(spark, root, "exp1", "bernoulli")
    with pytest.raises(R.ExperimentNotFound):
        R.lookup(spark, root, "nope")
    added, bad = R.append_events(spark, root, "exp1", _ab_rows(
        spark, [("2024-01-03 00:00:00", "A", "1"), ("2024-01-03 00:00:00", "A", "7"), ("x", "B", "1")]))
    assert added == 1
    assert sorted(r.reject_reason for r in bad.collect()) == ["bad_timestamp", "outcome_not_binary"]
    with pytest.raises(SchemaMismatch):
        R.append_events(spark, root, "exp1", spark.createDataFrame([("A",)], "variant string"))
    assert R.read_experiment(spark, root, "exp1").count() == 3
    with pytest.raises(ValueError):
        R.delete_by_filter(spark, root, "exp1", {})
    assert R.delete_by_filter(spark, root, "exp1", {"variant": "A"}, start="2024-01-02") == 1
    assert R.read_experiment(spark, root, "exp1").count() == 2
    R.drop_experiment(spark, root, "exp1")
    assert R.list_tables(spark, root) == []
    assert R.drop_if_exists(spark, root, "exp1") is False


def test_migration_conversion_to_outcome(spark, workdir):
    root = os.path.join(workdir, "lake")
    R.init_registry(spark, root)
    old = spark.createDataFrame([("2024-01-01 00:00:00", True)], "timestamp string, conversion boolean")
    # written as an older table layout: register it directly
    import time
    v = time.time_ns()
    old.write.parquet(R.data_path(root, "legacy", v))
    R._append(spark, root, [("legacy", "bernoulli", "L", "created", None, v, time.time_ns())])
    assert R.migrate_conversion_column(spark, root) == 1
    assert "outcome" in R.read_experiment(spark, root, "legacy").columns
    assert R.migrate_conversion_column(spark, root) == 0


def test_drop_by_kind_and_schemas(spark, workdir):
    root = os.path.join(workdir, "lake")
    for i in range(2):
        R.create_experiment(spark, root, f"w{i}", "weibull", "w",
                            spark.createDataFrame([("1.5", "true")], "duration string, observed string"))
    R.create_experiment(spark, root, "b0", "bernoulli", "b",
                        spark.createDataFrame([("2024-01-01", "true")], "timestamp string, outcome string"))
    assert sorted(R.drop_by_kind(spark, root, "weibull")) == ["w0", "w1"]
    assert R.list_tables(spark, root) == ["b0"]
    ks = R.kind_schemas(spark, "hazard-rate").collect()
    assert [(r.name, r.type) for r in ks] == [("duration", "double"), ("observed", "boolean")]


def test_fingerprint_order_free_and_duplicate_sensitive(spark):
    df = spark.createDataFrame([(i, f"v{i % 3}") for i in range(100)], "a long, b string")
    f1 = C.fingerprint(df).first().fingerprint
    f2 = C.fingerprint(df.repartition(7).orderBy(F.desc("a"))).first().fingerprint
    dup = df.unionByName(df.limit(2)).unionByName(df.limit(2))
    assert f1 == f2
    assert C.fingerprint(dup).first().fingerprint != f1


def test_result_cache(spark, workdir):
    path = os.path.join(workdir, "cache")
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    calls = []

    def fit(d):
        calls.append(1)
        return d.agg(F.sum("x").alias("s"))
    r1, hit1 = C.get_or_compute(spark, path, "e", "m", df, fit)
    r2, hit2 = C.get_or_compute(spark, path, "e", "m", df, fit)
    assert (hit1, hit2, len(calls)) == (False, True, 1)
    assert r2.first().s == 3.0
    C.get_or_compute(spark, path, "e2", "m", df, fit)
    assert C.list_cached(spark, path, "e").count() == 1      # exact name, not prefix
    assert C.clear_cached(spark, path, "e") == 1
    assert C.list_cached(spark, path, "e").count() == 0
    _, hit3 = C.get_or_compute(spark, path, "e", "m", df, fit)
    assert hit3 is False

    def boom(d):
        raise RuntimeError("fit failed")
    with pytest.raises(RuntimeError):
        C.get_or_compute(spark, path, "e3", "m", df, boom)
    assert C.list_cached(spark, path, "e3").count() == 0


def test_timestamp_parsing(spark):
    df = spark.createDataFrame([("1704067200",), ("2024-01-01T00:00:00",), ("2024-01-01",), ("20240101",), ("junk",)],
                               "s string")
    out = [r.t for r in df.select(parse_timestamp(F.col("s")).alias("t")).collect()]
    # a bare 20240101 is read as a Unix number first, as the reference CLI does
    assert str(out[0]) == str(out[1]) == str(out[2]) == "2024-01-01 00:00:00"
    assert str(out[3]).startswith("1970-08-23")
    assert out[4] is None


def test_json_and_csv_batches(spark, workdir):
    from bayes_ops.sources.ingest import read_csv_batch, read_json_batch
    jp = os.path.join(workdir, "b.json")
    with open(jp, "w") as f:
        json.dump([{"timestamp": "2024-01-01 00:00:00", "variant": "A", "outcome": 1},
                   {"timestamp": "2024-01-01 00:01:00", "variant": "B", "outcome": 2}], f)
    good, bad = split(read_json_batch(spark, jp), "ab-test")
    assert good.count() == 1 and bad.first().reject_reason == "outcome_not_binary"
    cp = os.path.join(workdir, "b.csv")
    with open(cp, "w") as f:
        f.write("timestamp,cohort,event_type\n2025-01-01T00:00:00Z,A,signup\n2025-01-01T00:03:10Z,A,signup\n")
    good, bad = split(read_csv_batch(spark, cp), "poisson-cohorts")
    assert good.count() == 2 and bad.count() == 0


def test_register_new_kind(spark, workdir):
    """A new kind plugs into validation, the registry and posterior()."""
    from pyspark.sql import types as T
    from bayes_ops import kinds

    def fit(df, **_):
        # Normal mean with unit variance and a flat prior: N(sum y / n, 1 / n).
        st = df.agg(F.count("y").alias("n"), F.sum("y").alias("s")).withColumn("param", F.lit("mu"))
        return st.select("param", (F.col("s") / F.col("n")).alias("mean"),
                         (F.lit(1.0) / F.sqrt(F.col("n"))).alias("sd"))
    kinds.register_kind("normal-mean", [("y", T.DoubleType())], fit)
    root = os.path.join(workdir, "lake")
    data = spark.createDataFrame([("1.0",), ("3.0",), ("oops",)], "y string")
    with pytest.raises(ValueError):  # the bad row is rejected by the kind's schema
        R.create_experiment(spark, root, "m", "normal-mean", "M", data)
    R.create_experiment(spark, root, "m", "normal-mean", "M", data.where("y <> 'oops'"))
    r = kinds.posterior("normal-mean", R.read_experiment(spark, root, "m", "normal-mean")).first()
    assert (r.mean, r.sd) == (2.0, pytest.approx(2 ** -0.5))
    assert "poisson-cohorts" in kinds.kinds()


def test_lake_api_flow(spark, workdir):
    from bayes_ops.api import Lake
    from bayes_ops.sources import adapters as AD
    from tests.conftest import SF001
    lake = Lake(spark, os.path.join(workdir, "lake"))
    ev = AD.poisson_from_events(spark, SF001)
    n = lake.create("cohorts", "poisson-cohorts", "Cohorts", ev.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "cohort", "event_type"))
    assert n == ev.count()
    p1 = lake.posterior("cohorts", "poisson-cohorts", start="2024-01-01", end="2024-01-31").collect()
    p2 = lake.posterior("cohorts", "poisson-cohorts", start="2024-01-01", end="2024-01-31").collect()
    assert sorted(r.mean for r in p1) == sorted(r.mean for r in p2) and lake.cached("cohorts").count() == 1
    with pytest.raises(R.WrongKind):
        lake.posterior("cohorts", "weibull")
    page = lake.list_events("cohorts", cohort=["c1"], limit=5)
    assert page.count() == 5
    gone = lake.delete_events("cohorts", cohort="c1")
    assert gone == ev.where("cohort = 'c1'").count()
    assert lake.table("cohorts").where("cohort = 'c1'").count() == 0
    assert lake.clear_cache("cohorts") == 1
    assert lake.inspect("cohorts", limit=3).first().total_count == n - gone


def test_lake_bandit_flow(spark, workdir):
    from bayes_ops.api import Lake
    lake = Lake(spark, os.path.join(workdir, "lake"), cache=False)
    rows = [("2024-01-01 00:00:00", "A", "5.0")] * 3 + [("2024-01-01 00:00:00", "A", "0.0")] * 20 \
        + [("2024-01-01 00:00:00", "B", "2.0")] * 15 + [("2024-01-01 00:00:00", "B", "0.0")] * 10
    lake.create("mab", "multi-armed-bandits", "Bandit",
                spark.createDataFrame(rows, "timestamp string, arm string, reward string"))
    post = {r.arm: r for r in lake.posterior("mab", "multi-armed-bandits").collect()}
    assert (post["A"].successes, post["B"].successes) == (3, 15)
    assert sum(r.prob_best for r in post.values()) == pytest.approx(1.0, abs=1e-9)
    best = lake.next_arm("mab").first()
    assert best.arm == max(post.values(), key=lambda r: r.prob_best).arm
