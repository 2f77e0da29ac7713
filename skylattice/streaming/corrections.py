"""Corrections and ephemerides of one stream, matched in a keyed state.

A satellite's ephemerides, orbit corrections and waiting clock corrections are lists, to which a batch's rows go in one call each. One timer of event
time stands for the clock correction that is due next; when it fires, all that are due are decided in one pass over the lists in order of time. So what
is chosen doesn't depend on the order in which rows came, and the result is that of the batch form as long as rows aren't later than the wait. What is
too old to be chosen any more, or came again, goes when the timer fires, so a satellite's state is bounded by what the network sends in two hours."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..operators.corrections import AGE, AWAY, MATCHED

COLUMNS = [c.split()[0] for c in MATCHED.split(", ")]


def _kept(state) -> list[tuple]:
    return list(state.get()) if state.exists() else []


def _by_issue(rows: Iterable[tuple]) -> dict[int, tuple[list[float], list[tuple]]]:
    """For each issue (the first field) the rows in order of time (the second), and these times."""
    found = defaultdict(lambda: ([], []))
    for r in sorted(rows, key=lambda r: r[1]):
        found[r[0]][0].append(r[1])
        found[r[0]][1].append(r)
    return found


class Matcher(StatefulProcessor):
    def __init__(self, wait: float):
        self.wait = wait

    def init(self, handle) -> None:
        self.handle = handle
        self.ephemerides = handle.getListState("ephemerides", "iode long, t0 double, numbers array<double>")
        self.orbits = handle.getListState("orbits", "iod long, t0 double, iode long, numbers array<double>, udi double")
        self.clocks = handle.getListState("clocks", "due long, t0 double, iod long, numbers array<double>, udi double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ephemerides, orbits, clocks = [], [], []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if pd.isna(r.t0):
                    continue
                numbers = [float(v) for v in r.numbers]
                if r.kind == "ephemeris":
                    ephemerides.append((int(r.iode), r.t0, numbers))
                elif r.kind == "orbit":
                    orbits.append((int(r.iod), r.t0, int(r.iode), numbers, r.udi))
                elif r.kind == "clock":
                    clocks.append((int((r.t0 + self.wait) * 1000), r.t0, int(r.iod), numbers, r.udi))
        for state, new in ((self.ephemerides, ephemerides), (self.orbits, orbits), (self.clocks, clocks)):
            if new:
                state.appendList(new)
        if clocks:
            self.handle.registerTimer(min(c[0] for c in clocks))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        # of rows with one issue and time the last one counts
        clocks = {c[:3]: c for c in _kept(self.clocks)}
        due = [c for c in clocks.values() if c[0] <= now]
        if not due:  # decided with an earlier one
            return iter(())
        orbits, ephemerides = {o[:2]: o for o in _kept(self.orbits)}, {e[:2]: e for e in _kept(self.ephemerides)}
        orbit, ephemeris, out = _by_issue(orbits.values()), _by_issue(ephemerides.values()), []
        for _, t0, iod, drift, udi in sorted(due, key=lambda c: c[:3]):
            times, found = orbit[iod]
            k = bisect_right(times, t0) - 1
            if k < 0 or t0 - times[k] > AGE:
                continue
            _, at, iode, shift, orbit_udi = found[k]
            times, found = ephemeris[iode]
            k = bisect_right(times, t0)
            near = min((e for e in found[max(k - 1, 0) : k + 1] if abs(e[1] - t0) <= AWAY), key=lambda e: (abs(e[1] - t0), -e[1]), default=None)
            if near:
                out.append((key[0], t0, iod, iode, at, list(shift), orbit_udi, list(drift), udi, list(near[2])))
        last = max(c[1] for c in due)  # every clock row with an earlier time has been due before
        waiting = [c for c in clocks.values() if c[0] > now]
        for state, rows in ((self.clocks, waiting), (self.orbits, [o for o in orbits.values() if o[1] >= last - AGE]), (self.ephemerides, [e for e in ephemerides.values() if e[1] >= last - AWAY])):
            state.put(rows) if rows else state.clear()
        if waiting:
            self.handle.registerTimer(min(c[0] for c in waiting))
        return iter([pd.DataFrame(out, columns=COLUMNS)] if out else ())

    def close(self) -> None:
        pass


def matched(events: DataFrame, late: str, wait: float) -> DataFrame:
    """The stream form of operators.corrections.matched. events: EVENTS, where `at` is t0 as a timestamp for corrections and the time from which an
    ephemeris is there for those; rows later than `late` may be missed. A clock row is decided when the watermark is `wait` seconds past its time.
    The session's state store has to be the one with column families (RocksDB)."""
    return events.withWatermark("at", late).groupBy("sat").transformWithStateInPandas(statefulProcessor=Matcher(wait), outputStructType=MATCHED, outputMode="Append", timeMode="EventTime")
