"""The life of sources and subscriptions as a keyed state of a stream: rows wait in a list until the watermark has passed them, so that they
are taken in order however they come; one timer stands for the next thing that is due, a row's turn, silence or a try."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.lifecycle import QUIET, STATES, retries

ORDER = {"add": 0, "data": 1, "delete": 2}
COLUMNS = [c.split()[0] for c in STATES.split(", ")]


class Life(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle, self.tries = handle, retries()
        self.waiting = handle.getListState("waiting", "at long, turn int")
        self.life = handle.getValueState("life", "last long, silent boolean, attempt int")  # exists while the name is there

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(at), ORDER[kind]) for pdf in rows for at, kind in zip(pdf["at"], pdf["kind"], strict=True) if kind in ORDER]
        if new:
            self.waiting.appendList(new)  # one call, not one for each row
            self.handle.registerTimer(min(at for at, _ in new))
        return iter(())

    def _deadline(self, life: tuple | None) -> int | None:
        if life is None:
            return None
        last, silent, attempt = life
        if not silent:
            return last + QUIET
        return last + QUIET + self.tries[attempt] if attempt < len(self.tries) else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        queue = sorted({(int(r[0]), int(r[1])) for r in self.waiting.get()}) if self.waiting.exists() else []
        life, out, k = (tuple(self.life.get()) if self.life.exists() else None), [], 0
        while True:
            due = self._deadline(life)
            row = queue[k] if k < len(queue) else None
            if row and row[0] <= now and (due is None or row[0] <= due):
                k += 1
                at, turn = row
                if turn == 0 and life is None:
                    life = (at, False, 0)
                    out.append((key[0], at, "added", 0))
                elif turn == 1 and life is not None:
                    if life[1]:
                        out.append((key[0], at, "up", life[2]))
                    life = (at, False, 0)
                elif turn == 2 and life is not None:
                    out.append((key[0], at, "deleted", life[2]))
                    life = None
            elif due is not None and due <= now:
                last, silent, attempt = life
                life = (last, True, attempt + 1 if silent else 0)
                out.append((key[0], due, "retry" if silent else "silent", life[2]))
            else:
                break
        if queue[k:]:
            self.waiting.put(queue[k:])
        else:
            self.waiting.clear()
        if life is None:
            self.life.clear()
        else:
            self.life.update(life)
        ahead = [t for t in (due, row[0] if row else None) if t is not None]
        if ahead:
            self.handle.registerTimer(min(ahead))
        return iter([pd.DataFrame(out, columns=COLUMNS)] if out else ())

    def close(self) -> None:
        pass


def states(log: DataFrame, late: str) -> DataFrame:
    """STATES of a stream of name, at (ms), kind; rows later than `late` may be missed. Needs the state store with column families (RocksDB)."""
    x = log.filter("name IS NOT NULL AND at IS NOT NULL").withColumn("_at", F.timestamp_millis("at")).withWatermark("_at", late)
    return x.groupBy("name").transformWithStateInPandas(statefulProcessor=Life(), outputStructType=STATES, outputMode="Append", timeMode="EventTime")
