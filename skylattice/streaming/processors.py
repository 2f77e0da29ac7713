"""Frames, throttled output, latest epochs, synchronisation and relative positions over streams.

State is kept by source or base line, so partitions follow the keys and a lost executor's state comes back from the checkpoint."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..kernels import relative, rtcm

FRAMES = "srcid long, type int, class int, body binary"


def _feed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rest, dropped = state.get if state.exists else (b"", 0)
    f = rtcm.Framer(bytes(rest), dropped)
    chunks = pd.concat(list(batches)).sort_values("offset")
    bodies = [b for c in chunks["payload"] for b in f.feed(bytes(c))]
    state.update((f.rest, f.dropped))
    kinds = [rtcm.number(b) for b in bodies]
    yield pd.DataFrame({"srcid": key[0], "type": kinds, "class": [rtcm.return_class(k) for k in kinds], "body": bodies})


def frames(chunks: DataFrame) -> DataFrame:
    """chunks: srcid, offset, payload, in order of offset by source across batches. The unfinished frame is the state."""
    return chunks.groupBy("srcid").applyInPandasWithState(_feed, FRAMES, "rest binary, dropped long", "append", GroupStateTimeout.NoTimeout)


def gate(times: np.ndarray, last: float | None, pause: float) -> tuple[np.ndarray, float | None]:
    """Which of the rising times pass when `pause` must lie between two that pass."""
    out = np.zeros(len(times), bool)
    for i, t in enumerate(times):
        if last is None or t - last >= pause:
            out[i], last = True, float(t)
    return out, last


def throttled(df: DataFrame, key: str, t: str, pause: float) -> DataFrame:
    """Rows that pass the gate of their key; streaming and batch. In batch a task passes once over its sorted keys, as many have few rows."""
    if not df.isStreaming:
        def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, now = None, ()
            for some in batches:
                passed = np.zeros(some.num_rows, bool)
                times = some.column(t).to_numpy(zero_copy_only=False).tolist()
                for i, (k, at) in enumerate(zip(some.column(key).to_pylist(), times, strict=True)):
                    k = (k if k == k else "nan",)
                    if k != now:
                        now, last = k, None
                    if last is None or at - last >= pause:
                        passed[i], last = True, at
                yield some.filter(pa.array(passed))

        order = list(dict.fromkeys([key, t, *sorted(df.columns)]))
        return df.repartition(key).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order]).mapInArrow(batch, df.schema)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        pdf = pdf.sort_values(list(dict.fromkeys([t, *sorted(pdf.columns)])))
        passed, last = gate(pdf[t].to_numpy(), state.get[0] if state.exists else None, pause)
        if last is not None:
            state.update((last,))
        yield pdf[passed]

    return df.groupBy(key).applyInPandasWithState(step, df.schema, "last double", "append", GroupStateTimeout.NoTimeout)


def latest(df: DataFrame, key: str, t: str) -> DataFrame:
    """The newest row of each key; in streams for update mode. A row with an older time never replaces a newer one."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), t).alias("_row")).select(key, "_row.*")


def synchronised(rover: DataFrame, base: DataFrame, keys: list[str], tolerance: str, late: str) -> DataFrame:
    """Rover and base rows of equal keys at most `tolerance` apart; t and base_t are timestamps. Rows later than `late` are dropped by
    watermark, which the network itself hasn't: there a late epoch overwrites."""
    r, b = rover.withWatermark("t", late), base.withWatermark("base_t", late)
    near = F.col("base_t").between(F.col("t") - F.expr(f"INTERVAL {tolerance}"), F.col("t") + F.expr(f"INTERVAL {tolerance}"))
    for k in keys:
        b = b.withColumnRenamed(k, f"base_{k}")
    cond = near
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"base_{k}"))
    return r.join(b, cond)


SOLUTIONS = "baseline string, epoch double, x double, y double, z double, status string, ratio double"
#: Observation rows of a base line: epoch, sat, satellite position, elevation (rad), ranges and phases of both ends, slip, base position.
OBSERVATIONS = ("epoch", "sat", "sx", "sy", "sz", "el", "pr", "pb", "lr", "lb", "slip", "bx", "by", "bz")


def solve(name: str, rows: pd.DataFrame, saved: bytes | None, wavelength: float = 0.190293672798365) -> tuple[pd.DataFrame, bytes | None]:
    """Epochs in order through the filter of a base line; returns solutions and the filter's state."""
    f = pickle.loads(saved) if saved else None
    out = []
    for epoch, g in rows.sort_values(["epoch", "sat"]).groupby("epoch", sort=True):
        base = g[["bx", "by", "bz"]].iloc[0].to_numpy(float)
        if f is None:
            f = relative.Filter(base, wavelength, base + 1.0)
        status = f.epoch(g["sat"].to_numpy(), g[["sx", "sy", "sz"]].to_numpy(float), g["el"].to_numpy(float), (g["pr"].to_numpy(float), g["pb"].to_numpy(float)), (g["lr"].to_numpy(float), g["lb"].to_numpy(float)), g["slip"].to_numpy(bool))
        at = f.fixed if f.fixed is not None and status == "fixed" else f.position
        out.append((name, float(epoch), *map(float, at), status, f.ratio))
    columns = [c.split()[0] for c in SOLUTIONS.split(", ")]
    return pd.DataFrame(out, columns=columns), pickle.dumps(f) if f is not None else None


def relative_positions(obs: DataFrame) -> DataFrame:
    """obs: baseline and OBSERVATIONS. Batch: all epochs of a base line in one task; stream: the filter is the state."""
    if not obs.isStreaming:
        return obs.groupBy("baseline").applyInPandas(lambda pdf: solve(pdf["baseline"].iloc[0], pdf, None)[0], SOLUTIONS)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, saved = solve(key[0], pd.concat(list(batches)), bytes(state.get[0]) if state.exists else None)
        if saved is not None:
            state.update((saved,))
        yield out

    return obs.groupBy("baseline").applyInPandasWithState(step, SOLUTIONS, "filter binary", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run all that is there through the stream into Parquet under path, and read that."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
