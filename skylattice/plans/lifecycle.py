"""Life of sources and subscriptions (operators A18, B07) over the events: a user is a name, and its events are its log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lifecycle
from ..streaming import lifecycle as stream
from ..streaming import processors
from .corrections import column_families
from .registry import register
from .streams import _events, _scratch
from .surrogate import table

#: How late rows may be, ms.
LATE = 86_400_000
_TRIES = ", ".join(map(str, lifecycle.retries()))


def _log(events: DataFrame) -> DataFrame:
    """Two of five types add and delete, the others are data."""
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "purchase", "delete").otherwise("data")
    return events.select(F.col("user_id").alias("name"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at"), kind.alias("kind"))


LIFE = f"""WITH g AS (SELECT DISTINCT user_id AS name, epoch_us(ts) // 1000 AS at_ms, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 2 ELSE 1 END AS turn FROM events),
s AS (SELECT *, coalesce(last_value(CASE WHEN turn <> 1 THEN turn END IGNORE NULLS) OVER (PARTITION BY name ORDER BY at_ms, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0, false) AS was FROM g),
f AS (SELECT name, at_ms, turn, lag(at_ms) OVER w AS prev, lead(at_ms) OVER w AS nxt FROM s WHERE (turn = 0 AND NOT was) OR (turn > 0 AND was) WINDOW w AS (PARTITION BY name ORDER BY at_ms, turn)),
tr AS (SELECT unnest([{_TRIES}]) AS off, unnest(range({lifecycle.TRIES})) + 1 AS attempt),
r AS (SELECT name, at_ms, CASE turn WHEN 0 THEN 'added' WHEN 2 THEN 'deleted' ELSE 'up' END AS state, CASE WHEN turn = 0 THEN 0 ELSE (SELECT count(*) FROM tr WHERE off + {lifecycle.QUIET} < at_ms - prev) END AS attempt FROM f WHERE turn <> 1 OR at_ms - prev > {lifecycle.QUIET}
  UNION ALL SELECT name, at_ms + {lifecycle.QUIET}, 'silent', 0 FROM f WHERE turn <> 2 AND (nxt IS NULL OR at_ms + {lifecycle.QUIET} < nxt)
  UNION ALL SELECT name, at_ms + {lifecycle.QUIET} + off, 'retry', attempt FROM f, tr WHERE turn <> 2 AND (nxt IS NULL OR at_ms + {lifecycle.QUIET} + off < nxt))
SELECT name, at_ms AS "at", state, CAST(attempt AS INTEGER) AS attempt FROM r"""


@register("a18_source_life", LIFE)
def source_life(spark, sf_dir) -> DataFrame:
    return lifecycle.states(_log(table(spark, sf_dir, "events")))


@register("a18_source_life_stream", f"{LIFE} WHERE at_ms <= (SELECT max(epoch_us(ts) // 1000) FROM events) - {LATE}")
def source_life_stream(spark, sf_dir) -> DataFrame:
    """The stream form to its end; what the last watermark hasn't reached is still to come."""
    with column_families(spark):
        return processors.run_to_table(stream.states(_log(_events(spark, sf_dir)), f"{LATE} milliseconds"), _scratch(spark))
