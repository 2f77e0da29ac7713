"""Life of sources and subscriptions: added, silent, tried again with rising pauses, up again, deleted.

A log has rows name, at (ms) and kind: 'add', 'data' or 'delete'. A name that is there and sends nothing for QUIET is silent; it is tried again
after PAUSE, then after twice that and so on up to LONGEST, TRIES times at most. Data of a silent name bring it up. Adding what is there, and data of or
deleting what isn't, change nothing. Out come rows name, at, state ('added', 'silent', 'retry', 'up', 'deleted') and attempt. Rows of one
time go in the order add, data, delete.

In batch this is gaps and islands: whether a name is there depends on its last add or delete alone, and what happens in a pause on
its length alone. In streams (streaming/lifecycle.py) it is a keyed state with timers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds.
QUIET, PAUSE, LONGEST, TRIES = 21_600_000, 3_600_000, 28_800_000, 8
STATES = "name long, at long, state string, attempt int"


def rank(kind: Column) -> Column:
    return F.when(kind == "add", 0).when(kind == "data", 1).otherwise(2)


def retries() -> list[int]:
    """Milliseconds from silence to each try."""
    out, at, pause = [], 0, PAUSE
    for _ in range(TRIES):
        at += pause
        out.append(at)
        pause = min(2 * pause, LONGEST)
    return out


def states(log: DataFrame, until: int | None = None) -> DataFrame:
    """STATES from a whole log. A name that is silent when the log ends is tried up to `until` (ms), by default through all its tries. The only
    shuffle is by name; rows of a name are sorted and passed over once, so what is held of a name doesn't grow."""
    known = log.filter("name IS NOT NULL AND at IS NOT NULL AND kind IN ('add', 'data', 'delete')").select("name", "at", "kind").distinct()
    w = Window.partitionBy("name").orderBy("at", rank(F.col("kind")))
    switch = F.when(F.col("kind") != "data", F.col("kind"))
    x = known.withColumn("_was", F.coalesce(F.last(switch, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) == "add", F.lit(False)))
    x = x.filter(F.when(F.col("kind") == "add", ~F.col("_was")).otherwise(F.col("_was")))  # what changes something
    x = x.withColumn("_last", F.lag("at").over(w)).withColumn("_next", F.lead("at").over(w))
    tries = F.array(*[F.lit(t).cast("long") for t in retries()])
    before = F.when(F.col("kind") != "add", F.col("at") - F.col("_last"))
    tried = F.size(F.filter(tries, lambda t: t + QUIET < before))
    own = F.when(F.col("kind") == "add", F.struct(F.col("at"), F.lit("added").alias("state"), F.lit(0).alias("attempt"))).when(
        F.col("kind") == "delete", F.struct(F.col("at"), F.lit("deleted").alias("state"), tried.alias("attempt"))
    ).when(before > QUIET, F.struct(F.col("at"), F.lit("up").alias("state"), tried.alias("attempt")))
    end = F.coalesce(F.col("_next"), F.lit(until if until is not None else 1 << 62).cast("long") + 1)
    silent = F.when((F.col("kind") != "delete") & (F.col("at") + QUIET < end), F.struct((F.col("at") + QUIET).alias("at"), F.lit("silent").alias("state"), F.lit(0).alias("attempt")))
    again = F.filter(F.transform(tries, lambda t, i: F.struct((F.col("at") + QUIET + t).alias("at"), F.lit("retry").alias("state"), (i + 1).alias("attempt"))), lambda r: (F.col("kind") != "delete") & (r["at"] < end))
    return x.select("name", F.explode(F.array_compact(F.concat(F.array(own, silent), again))).alias("_s")).select("name", "_s.at", "_s.state", "_s.attempt")
