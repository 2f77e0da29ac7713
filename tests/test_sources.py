import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.kernels import rtcm
from skylattice.sources import combine, configs, formats, grids, rinex, solutions, tables
from skylattice.streaming import processors

T0 = rinex.seconds(2024, 5, 1, 0, 0, 0.0)
OBS = [(T0 + 30 * k, s, c, 2.2e7 + k + i, (k + i) % 3, 7) for k in range(5) for i, (s, c) in enumerate([("G01", "C1C"), ("G01", "L1C"), ("G12", "C1C"), ("R05", "C1P")])]


def same(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))


def test_observations_round_trip_and_screen():
    lines = rinex.write_observations(OBS, {"name": "A001", "pos": [1.0, 2.0, 3.0]})
    assert all(len(v) <= 80 for v in lines[:6])
    assert same(rinex.observations(lines), OBS)
    assert {r[0] for r in rinex.observations(lines, since=T0 + 30, until=T0 + 119)} == {T0 + 30, T0 + 60, T0 + 90}
    kept = list(rinex.observations(lines, interval=60.0))
    assert {r[0] for r in kept} == {T0, T0 + 60, T0 + 120}
    slip = {(r[0], r[1], r[2]): r[4] for r in OBS if r[0] == T0 + 30 and r[4] & 1}
    carried = {(r[0], r[1], r[2]): r[4] for r in kept}
    assert all(carried[T0 + 60, s, c] & 1 for _, s, c in slip)
    assert rinex.header(iter(lines))["station"]["pos"] == [1.0, 2.0, 3.0]


def test_version_two_observations():
    head = [rinex._label("     2.11           OBSERVATION DATA    G (GPS)", "RINEX VERSION / TYPE"), rinex._label("     3    C1    L1    P2", "# / TYPES OF OBSERV"), rinex._label("", "END OF HEADER")]
    body = [" 24  5  1  0  0  0.0000000  0  2G01G 2", f"{2.2e7:14.3f} 7{1.1e8:14.3f}17{' ' * 16}", f"{2.3e7:14.3f}  {' ' * 16}{2.4e7:14.3f}  "]
    got = list(rinex.observations(head + body))
    assert got == [(T0, "G01", "C1C", 2.2e7, 0, 7), (T0, "G01", "L1C", 1.1e8, 1, 7), (T0, "G02", "C1C", 2.3e7, 0, 0), (T0, "G02", "C2P", 2.4e7, 0, 0)]


def test_navigation_round_trip():
    e = {"sat": "G07", "toc": T0} | {k: (i - 14) * 1.25e-7 for i, k in enumerate(rinex.EPH)}
    g = {"sat": "R03", "toc": T0 + 900} | {k: i * 1.5 for i, k in enumerate(rinex.GEPH)}
    got = list(rinex.navigation(rinex.write_navigation([e, g])))
    for want, have in zip([e, g], got, strict=True):
        assert have["sat"] == want["sat"] and have["toc"] == want["toc"]
        assert all(np.isclose(have[k], v, rtol=1e-12, atol=1e-30) for k, v in want.items() if k not in ("sat", "toc"))


def test_orbits_maps_and_antennas():
    rows = [(T0, "G01", 1e7, -2e7, 3e6, 1e-5), (T0, "R02", None, None, None, None), (T0 + 900, "G01", 1.1e7, -2e7, 3e6, -1e-5)]
    got = list(grids.sp3(grids.write_sp3(rows)))
    assert got[1][2] is None and got[1][5] is None and np.isclose(got[2][5], -1e-5)
    label = rinex._label
    text = [label("    -1", "EXPONENT"), label("     1", "START OF TEC MAP"), label("  2024     5     1     0     0     0", "EPOCH OF CURRENT MAP"), label("    87.5-180.0 180.0   5.0 450.0", "LAT/LON1/LON2/DLON/H"), "   10 9999   30", label("     1", "END OF TEC MAP")]
    assert list(grids.ionex(text)) == [(T0, "TEC", 450.0, 87.5, -180.0, 1.0), (T0, "TEC", 450.0, 87.5, -170.0, 3.0)]
    atx = [label("", "START OF ANTENNA"), label(f"{'AOAD/M_T        NONE':<20}{'S1':<20}", "TYPE / SERIAL NO"), label("   G01", "START OF FREQUENCY"), label("      1.00     -2.00      3.50", "NORTH / EAST / UP"), "   NOAZI    0.00   -0.25", label("   G01", "END OF FREQUENCY"), label("", "END OF ANTENNA")]
    a = next(grids.antex(atx))
    assert a["type"] == "AOAD/M_T        NONE" and a["offsets"]["G01"] == [1e-3, -2e-3, 3.5e-3] and a["variations"]["G01"] == [0.0, -0.25e-3]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "obs").mkdir()
    (d / "obs" / "a.obs").write_text("\n".join(rinex.write_observations(OBS, {"name": "A"})) + "\n")
    with gzip.open(d / "obs" / "b.obs.gz", "wt") as f:
        f.write("\n".join(rinex.write_observations(OBS[:8], {"name": "B"})) + "\n")
    (d / "clk").mkdir()
    for i, v in enumerate((1e-6, 2e-6)):
        line = f"AS G01  2024 05 01 00 00  0.000000  2   {v:19.12E} {1e-11:19.12E}"
        (d / "clk" / f"{i}.clk").write_text("\n".join([rinex._label("     3.00           C", "RINEX VERSION / TYPE"), rinex._label("", "END OF HEADER"), line]) + "\n")
    (d / "bytes").mkdir()
    for i in range(2):
        (d / "bytes" / f"{i}.rtcm").write_bytes(b"\x00" + b"".join(rtcm.frame(rtcm.encode_fields(1005, {"station": k, "x": i})) for k in range(40)))
    return d


def test_data_sources(spark, folder):
    formats.register(spark)
    got = spark.read.format("rinex_obs").option("interval", "60").load(str(folder / "obs"))
    assert {r["rcv"]: r["n"] for r in got.groupBy("rcv").agg(F.count("*").alias("n")).collect()} == {1: 12, 2: 4}
    assert {r["name"] for r in spark.read.format("rinex_station").load(str(folder / "obs")).collect()} == {"A", "B"}
    clk = spark.read.format("rinex_clk").load(str(folder / "clk"))
    assert [r["clock"] for r in combine.later_wins(clk, ["t", "sat"], ["clock"]).collect()] == [2e-6]
    assert spark.read.format("rtcm3").option("chunk", "13").load(str(folder / "bytes")).filter("class = 5").count() == 80


def test_replay_stream_equals_batch(spark, folder, tmp_path):
    formats.register(spark)
    chunks = spark.readStream.format("byte_replay").option("chunk", "100").option("chunks_per_batch", "4").load(str(folder / "bytes"))
    frames = processors.frames(chunks.withColumn("srcid", F.col("srcid").cast("long")))
    q = frames.writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    stream = spark.table("replayed").select("srcid", "body").toPandas()
    batch = spark.read.format("rtcm3").load(str(folder / "bytes")).select("srcid", "body").toPandas()
    key = lambda df: sorted((int(s), bytes(b)) for s, b in df.itertuples(index=False))
    assert key(stream) == key(batch) and len(stream) == 80


def test_epochs_as_a_stream(spark, folder, tmp_path):
    formats.register(spark)
    obs = spark.readStream.format("rinex_replay").option("epochs_per_batch", "2").load(str(folder / "obs"))
    q = obs.writeStream.format("memory").queryName("epochs").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    batch = spark.read.format("rinex_obs").load(str(folder / "obs"))
    assert same(map(tuple, spark.table("epochs").collect()), map(tuple, batch.collect())) and batch.count() == 28


def test_control_files(spark, tmp_path):
    (tmp_path / "src").write_text("A,1.2.3.4,2101,u,p,M1,30.0,110.0,50.0#\nA,9.9.9.9,1,u,p,M2#\nbad,line#\n")
    got = configs.read(spark, str(tmp_path / "src"), "sources").collect()
    assert len(got) == 1 and got[0]["address"] == "1.2.3.4" and "password" not in got[0].asDict() and got[0]["z"] > 3e6
    (tmp_path / "opt").write_text("pos1-elmask = 15 # degrees\n# note\nmode=kinematic\n")
    assert configs.read_options(spark, str(tmp_path / "opt")) == {"pos1-elmask": "15", "mode": "kinematic"}


@pytest.mark.parametrize("kind", ["llh", "xyz", "enu"])
def test_solution_files(spark, tmp_path, kind):
    names = solutions.KINDS[kind][0]
    rows = [(1.7e9 + i * 30.5, *[1.5 + i] * 3, i % 3, 9, *[0.5] * 6, 1.0, 3.5) for i in range(5)]
    sol = spark.createDataFrame(rows, "t double, " + ", ".join(f"{n} {'int' if n in ('quality', 'ns') else 'double'}" for n in names))
    solutions.write(sol, str(tmp_path / "out"), kind)
    text = spark.read.text([str(tmp_path / "out" / d) for d in ("header", "solution")]).toDF("line")
    got = solutions.parse(text, "line", kind).orderBy("t").collect()
    assert [round(r["t"], 3) for r in got] == [r[0] for r in rows if r[4] > 0] and got[0][names[0]] == 2.5
    assert solutions.parse(text, "line", kind, since=1.7e9 + 100, quality=1).count() == 1


def test_receiver_correction_formats(spark):
    msg = "53" * 29
    lines = spark.createDataFrame([(f"2000 1000 120  2 : {msg}",), (f"#RAWWAASFRAMEA,COM1,0,0,FINE,1400,2000.0;0,121,3,{msg}",), (f"$FRMA,1300,3000,122,0,{msg}*7F",), ("junk",)], "line string")
    got = {r["prn"]: (r["week"], r["tow"], len(r["msg"])) for r in tables.correction_log(lines, "line").collect()}
    assert got == {120: (2000, 1000, 29), 121: (1400, 2000, 29), 122: (1300, 3000, 29)}
    assert tables.correction_log(lines, "line", prn=121).count() == 1


def test_earth_orientation(spark):
    got = tables.earth_orientation(spark.createDataFrame([("60000.0 100000 200000 -300000 12",), ("title line",)], "line string"), "line").collect()
    assert len(got) == 1 and abs(got[0]["xp"] - 0.1) < 1e-12 and abs(got[0]["ut1_utc"] + 0.03) < 1e-12


def _obs_lines(first: int, last: int) -> list[str]:
    rows = [(1.7e9 + 30 * t, f"G{s:02}", c, 2e7 + t * 10 + s, 0, 7) for t in range(first, last) for s in range(1, 7) for c in ("C1C", "L1C")]
    return rinex.write_observations(rows)


def _run(stream, path, name):
    q = stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return [p["numInputRows"] for p in q.recentProgress]


@pytest.mark.parametrize("part", ["200", "100000"])
def test_growing_observation_file_resumes(spark, tmp_path, part):
    """A query that was stopped in the middle of an epoch goes on with what is new, by ranges that cut epochs anywhere."""
    formats.register(spark)
    (tmp_path / "obs").mkdir()
    whole = "".join(v if v.endswith("\n") else v + "\n" for v in _obs_lines(0, 40)).encode()
    path, cut = tmp_path / "obs" / "A.obs", len(whole) * 3 // 5 + 7
    path.write_bytes(whole[:cut])
    stream = lambda: spark.readStream.format("rinex_replay").option("part_bytes", part).load(str(tmp_path / "obs"))
    first = sum(_run(stream(), tmp_path, "out"))
    assert 0 < first < 40 * 12
    path.write_bytes(whole)
    second = sum(_run(stream(), tmp_path, "out"))
    assert first + second == 40 * 12 and sum(_run(stream(), tmp_path, "out")) == 0
    got = spark.read.parquet(f"{tmp_path}/out")
    assert same(map(tuple, got.collect()), map(tuple, spark.read.format("rinex_obs").load(str(tmp_path / "obs")).collect()))


def test_a_batch_reads_its_bytes_alone(tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(256)) * 40)
    (tmp_path / "b.bin").write_bytes(b"xyz")
    r = formats.ByteReader({"path": f"file://{tmp_path}", "chunk": "100", "part_bytes": "1000"})
    one = r.latestOffset()
    assert sorted(one.values()) == [3, 10240]
    parts = r.partitions({}, one)
    assert len(parts) == 12 and sum(p.end - p.start for p in parts) == 10243
    rows = [x for p in parts for x in r.read(p)]
    assert b"".join(d for n, _, d in rows if n == 1) == bytes(range(256)) * 40 and [o for n, o, _ in rows if n == 1] == list(range(0, 10240, 100))
    with open(tmp_path / "b.bin", "ab") as f:
        f.write(b"more")
    fresh = formats.ByteReader({"path": str(tmp_path), "chunk": "100"})
    at = {k.removeprefix("file://"): v for k, v in one.items()}
    assert [x for p in fresh.partitions(at, fresh.latestOffset()) for x in fresh.read(p)] == [(2, 3, b"more")]


def test_old_observation_files_are_counted_by_lines(tmp_path):
    """Version 2: the end of the last whole epoch, however the file is cut."""
    head = [rinex._label("     2.11           OBSERVATION DATA    G (GPS)", "RINEX VERSION / TYPE"), rinex._label("     2    C1    L1", "# / TYPES OF OBSERV"), rinex._label("", "END OF HEADER")]
    body = []
    for t in range(5):
        body.append(f" 24  1  1  0  0 {t * 10:10.7f}  0  3G01G02G03")
        body += [f"{2e7 + t:14.3f}  {1e8 + t:14.3f}  " for _ in range(3)]
    text = ("\n".join(head + body) + "\n").encode()
    (tmp_path / "A.24o").write_bytes(text)
    whole = formats.EpochReader({"path": str(tmp_path)})
    end = whole.latestOffset()
    assert list(end.values()) == [len(text)]
    rows = [x for p in whole.partitions({}, end) for x in whole.read(p)]
    assert len(rows) == 30
    for cut in range(len(text) - 200, len(text)):
        (tmp_path / "A.24o").write_bytes(text[:cut])
        r = formats.EpochReader({"path": str(tmp_path)})
        at = r.latestOffset()
        (tmp_path / "A.24o").write_bytes(text)
        again = [x for p in r.partitions({}, at) for x in r.read(p)] + [x for p in r.partitions(at, end) for x in r.read(p)]
        assert sorted(again) == sorted(rows)


def test_ocean_loading_blocks(spark):
    from skylattice.functions import loading
    from skylattice.sources import tables

    row = lambda v: " " + " ".join(f"{v + i / 10:.2f}" for i in range(11))
    text = ["$$ file", "  onsa", "$$ complete", *[row(k) for k in range(6)], row(9), "", "  SHORT", row(1), "  ONSA", *[row(7)] * 6, " wtzr 11001", *["  " + " ".join([".00" + str(k)] * 11) for k in range(6)]]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)] + [("g", 3, row(2)), ("g", 5, "  ALONE")], "file string, at int, line string")
    got = {r["station"]: r["waves"] for r in tables.ocean_loading(lines, "line", "at", "file").collect()}
    assert set(got) == {"ONSA", "WTZR"} and len(got["ONSA"]) == len(loading.WAVES)
    assert [got["ONSA"][3][n] for n in tables.LOADING] == [k + 0.3 for k in range(6)] and got["WTZR"][0]["south_lag"] == 0.005
    assert tables.ocean_loading(lines.limit(0), "line", "at", "file").count() == 0
    moved = loading.with_ocean_loading(spark.createDataFrame([(0.0, None)], "t double, waves array<struct<up:double,west:double,south:double,up_lag:double,west_lag:double,south_lag:double>>"), "t", "waves")
    assert moved.head()["ocean_u"] is None
