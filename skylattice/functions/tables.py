"""User-defined table functions: messages of frames as rows, for SQL and lateral joins."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..kernels import rtcm


@udtf(returnType="type int, class int, fields string")
class DecodedMessage:
    """One row for a message body: its type, return class, and its fields as JSON."""

    def eval(self, body: bytes):
        if body is not None:
            m = rtcm.decode(bytes(body))
            yield m.pop("type", 0), m.pop("class", 0), json.dumps(m, default=float)


@udtf(returnType="system string, station int, epoch long, sat int, sig int, p double, l double, snr double, lock int, half int")
class ObservationCells:
    """One row for each cell of an observation message; none for other messages."""

    def eval(self, body: bytes):
        if body is not None and rtcm.number(bytes(body)) in rtcm.MSM_SYSTEM:
            m = rtcm.decode(bytes(body))
            for c in m.get("cells", []):
                yield m["system"], m["station"], m["epoch"], c["sat"], c["sig"], c["p"], c["l"], float(c["snr"]), c["lock"], c["half"]


def register(spark: SparkSession) -> None:
    spark.udtf.register("decoded_message", DecodedMessage)
    spark.udtf.register("observation_cells", ObservationCells)
