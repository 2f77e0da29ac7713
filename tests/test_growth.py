"""Queries over rows that the given tables don't hold, and steps whose groups or tasks must not grow with the table."""

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import orbit
from skylattice.kernels import ambiguity, orbits
from skylattice.operators import staging
from skylattice.plans import baselines, catalog, files, joins, scalars
from skylattice.plans.surrogate import sta

from .compare import SMALL, connect, rows


def same(spark, con, name, folder):
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert len(want) and rows(got) == rows(want)


def changed(spark, tmp_path, table, df):
    """A folder with df as the table, and a connection that sees it."""
    df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = connect()
    con.sql(f"create or replace view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    return con, str(tmp_path)


def test_view_deals_pairs_to_many_tasks(spark):
    n = scalars._view(spark, SMALL).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(n) > 4


def test_base64_of_long_addresses(spark, tmp_path):
    pages = spark.range(3).select(F.col("id").alias("page_id"), F.concat(F.lit("https://"), F.repeat(F.lit("ab"), F.col("id").cast("int") * 60)).alias("url"))
    same(spark, *changed(spark, tmp_path, "pages", pages)[:1], "g06_base64", str(tmp_path))


def test_texts_of_stations_beyond_twelve_bits(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").limit(50).withColumn("user_id", F.col("event_id") * 2047)
    same(spark, *changed(spark, tmp_path, "events", events)[:1], "h06_text_message", str(tmp_path))


def test_biases_beyond_their_fields(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").limit(90).withColumn("value", F.round((F.col("event_id") % 90 - 45) * 37.31, 2))
    same(spark, *changed(spark, tmp_path, "events", events)[:1], "h08_ssr_biases", str(tmp_path))


def test_orbits_of_many_rows_at_once():
    s = np.column_stack([np.linspace(1.2e7, 1.5e7, 5), np.linspace(2.0e7, 1.8e7, 5), np.full(5, 1e7), np.full(5, -1e3), np.full(5, 500.0), np.full(5, 3e3)])
    together = orbits.glonass_position(s, np.zeros(3), 900.0)
    assert np.allclose(together, [orbits.glonass_position(x, np.zeros(3), 900.0) for x in s], rtol=0, atol=1e-6)


def test_windup_of_many_rows_at_once():
    a = np.linspace(0.1, 3.0, 7)
    ex, ey = np.column_stack([np.cos(a), np.sin(a), 0 * a]), np.column_stack([np.sin(a), -np.cos(a), 0 * a])
    one = lambda i: orbits.windup(np.array([0, 0, 2e7]), np.zeros(3), ex[i], ey[i], np.eye(3)[0], np.eye(3)[1], float(i))
    assert np.allclose(orbits.windup(np.array([0, 0, 2e7]), np.zeros(3), ex, ey, np.eye(3)[0], np.eye(3)[1], np.arange(7.0)), [one(i) for i in range(7)], rtol=0, atol=1e-12)


@pytest.mark.parametrize("name", ["e02_integer_search", "g18_glonass_orbit"])
def test_long_work_is_dealt_to_tasks(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_navigation_files_have_bounded_ranges(spark, monkeypatch):
    monkeypatch.setattr(files, "ISSUES", 100)
    same(spark, connect(), "a03_navigation_file", SMALL)


def test_antennas_of_one_type_meet_once(spark, tmp_path):
    p = spark.range(4000).select(F.col("id").alias("p_partkey"), F.lit("word one").alias("p_name"), F.concat(F.lit("B"), F.col("id") % 3).alias("p_brand"), F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("ab", "abc", "x"))), (F.col("id") % 3 + 1).cast("int")), F.lit("T")).alias("p_type"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    con, folder = changed(spark, tmp_path, "part", p)
    same(spark, con, "c18_receiver_antenna", folder)
    plan = joins.receiver_antenna(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(p_partkey" in plan


def test_correction_lines_are_made_once(spark):
    df = catalog.QUERIES["a10_correction_log"](spark, SMALL)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("format_string") == 1
    same(spark, connect(), "a10_correction_log", SMALL)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_satellites_and_observations_are_compiled(spark):
    s = sta(spark, SMALL).select(F.col("id").alias("srcid"), "x", "y", "z")
    made = plan(baselines.band_observations(s))
    assert "lambdafunction" not in made and "collect_list" not in made
    eph = baselines.circular_ephemerides(spark).select("sat", F.struct(*orbit.ELEMENTS).alias("e"), (F.col("toe") + 100).alias("t"))
    assert "lambdafunction" not in plan(orbit.with_satellite(eph, "e", {"s": "t"}))
    got = orbit.with_satellite(eph, "e", {"s": "t"}).withColumn("o", orbit.satellite(F.col("e"), F.col("t"))).filter("sx != o.x OR sy != o.y OR sz != o.z OR sclock != o.clock")
    assert not got.count()


def test_reduction_keeps_the_lattice():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 24):
        a = rng.normal(size=(n, n + 2)) * np.exp(rng.uniform(-6, 6, (n, 1)))
        r = ambiguity.basis(a @ a.T + np.eye(n) * 1e-6)
        b, z = ambiguity.reduced(r)
        assert np.allclose(b.T @ b, z.T @ r.T @ r @ z, rtol=1e-6, atol=1e-9 * np.abs(r.T @ r).max()) and round(abs(np.linalg.det(z))) == 1
        own, beside = np.diag(b) ** 2, np.diag(b, 1) ** 2
        assert (np.abs(np.triu(b, 1)) <= 0.5001 * np.abs(np.diag(b))[:, None]).all() and (0.989 * own[:-1] <= own[1:] + beside).all()


def test_stations_of_virtual_rows_take_turns(spark, monkeypatch):
    """All stations come out, and the tables of a turn are gone when the next one begins."""
    there = lambda: sorted(p.name for p in pathlib.Path(staging.shared_dir(spark).removeprefix("file://")).glob("step-*"))
    seen, first = [], there()

    def work(part):
        seen.append((part.count(), there()))
        return staging.staged(staging.staged(part).groupBy("id").count())

    monkeypatch.setattr(baselines, "TURN", 3)
    monkeypatch.setattr(baselines, "_virtual_rows", work)
    stations = sta(spark, SMALL).select("id")
    got = baselines.virtual_rows(spark, SMALL)
    assert sorted(got.collect()) == sorted((r.id, 1) for r in stations.collect())
    assert len(seen) == -(-stations.count() // 3) > 1 and all(steps == first for _, steps in seen) and there() == first
    assert spark.conf.get(staging.CLEANUP) == "false"


def test_turns_hold_rows_without_a_key_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (5, 3), (5, 3), (6, 4)], "k long, v long")
    turns = lambda df, most: sorted(staging.in_turn(df, "k", most, lambda part: part.groupBy("k").agg(F.sum("v").alias("v"))).collect(), key=str)
    assert turns(rows, 1) == turns(rows, 100) == sorted([(None, 3), (5, 6), (6, 4)], key=str)
    assert turns(rows.filter("v > 9"), 1) == []
