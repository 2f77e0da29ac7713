import numpy as np
from pyspark.sql import functions as F

from skylattice.kernels import positioning
from skylattice.operators.network import Engine
from skylattice.streaming import processors


def observations(spark):
    rows, wave, rng = [], 0.190293672798365, np.random.default_rng(3)
    for b in range(2):
        base = positioning.ecef(0.5 + 0.01 * b, 1.9, 100.0)
        rover, n = base + np.array([100.0 + b, -50, 20]), rng.integers(-9, 9, 64)
        for k in range(4):
            sat = positioning.constellation(k * 30.0)
            el = positioning.elevation(sat, base)
            ru, rb = positioning.ranges(sat, rover)[0], positioning.ranges(sat, base)[0]
            for s in np.flatnonzero(el > 0.2):
                e = rng.normal(size=4)
                rows.append((f"b{b}", float(k * 30), int(s), *map(float, sat[s]), float(el[s]), float(ru[s] + 0.2 * e[0]), float(rb[s] + 0.2 * e[1]), float((ru[s] + 0.002 * e[2]) / wave + n[s]), float((rb[s] + 0.002 * e[3]) / wave), False, *map(float, base)))
    kinds = {"sat": "long", "slip": "boolean"}
    return spark.createDataFrame(rows, "baseline string, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in processors.OBSERVATIONS))


def test_filter_over_stream_equals_batch(spark, tmp_path):
    obs = observations(spark)
    for k in range(4):
        obs.filter(F.col("epoch") == k * 30).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = processors.run_to_table(processors.relative_positions(stream), str(tmp_path / "out")).orderBy("baseline", "epoch").toPandas()
    want = processors.relative_positions(obs).orderBy("baseline", "epoch").toPandas()
    assert len(got) == len(want) == 8 and np.allclose(got[["x", "y", "z"]], want[["x", "y", "z"]], atol=1e-6)
    assert set(want.groupby("baseline")["status"].last()) == {"fixed"}


def test_gate():
    passed, last = processors.gate(np.array([0.0, 5, 10, 12, 30]), None, 10.0)
    assert passed.tolist() == [True, False, True, False, True] and last == 30.0


def test_engine_tables(spark):
    src = spark.createDataFrame([("A", 1, "u", "secret"), ("B", 2, "u", "secret")], "name string, srcid long, user string, password string")
    obs = spark.createDataFrame([(1, 10, "G01"), (1, 11, "G02"), (2, 9, "G03")], "srcid long, epoch long, sat string")
    e = Engine(sources=src, obs=obs)
    assert "password" not in e.sources().columns
    assert [r["sat"] for r in e.observations("A").collect()] == ["G02"]
    e.add("sources", spark.createDataFrame([("B", 5, "u", "x"), ("C", 3, "u", "x")], src.schema))
    e.delete("sources", spark.createDataFrame([("A",)], "name string"))
    assert {(r["name"], r["srcid"]) for r in e["sources"].collect()} == {("B", 2), ("C", 3)}
