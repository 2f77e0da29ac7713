"""Preference formatting of conversations, in DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (same role, same text) is rendered
once as the prompt; what follows in each is its completion. A completion's mask lists the spans (start:end, code
points from the completion's start) that are to be learned: the texts of assistant turns with their end marks.

Defined cases. Columns besides those of `conversations`, whatever their names, aren't read. Very long texts are rendered whole. Turns are put in order of (turn, role, text), nulls first; repeated rows stay. Null role or text: rendered
as empty; two nulls are equal. A pair whose one side has no turns has an empty prompt and an empty completion there. Turns
without a pair are left out. An empty table gives an empty result. A conversation is one record by nature: its
turns meet in one row, as its rendered text does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks of the template.
HEAD, BODY, END = "<|", "|>\n", "<|end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), F.coalesce(t["role"], F.lit("")), F.lit(BODY), F.coalesce(t["text"], F.lit("")), F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """start:end of the assistant turns' texts, comma-joined."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(HEAD) + len(BODY) + F.length(F.coalesce(t["role"], F.lit("")))
        end = start + F.length(F.coalesce(t["text"], F.lit(""))) + len(END)
        learned = F.coalesce(t["role"] == "assistant", F.lit(False))
        here = F.array(F.concat_ws(":", start.cast("string"), end.cast("string")))
        return F.struct(end.cast("long").alias("at"), F.when(learned, F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step, lambda acc: acc["spans"]), ",")


def format_preferences(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """turns: turn, role, text. pair: the pair's id; chosen: whether the turn is of the chosen conversation. Returns
    pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    x = turns.select(pair.alias("pair_id"), chosen.alias("_chosen"), F.struct(F.col("turn"), F.col("role"), F.col("text")).alias("_t")).filter("pair_id IS NOT NULL AND _chosen IS NOT NULL")
    side = lambda yes: F.sort_array(F.collect_list(F.when(F.col("_chosen") if yes else ~F.col("_chosen"), F.col("_t"))))
    g = x.groupBy("pair_id").agg(side(True).alias("_c"), side(False).alias("_r"))
    same = F.zip_with("_c", "_r", lambda a, b: F.coalesce(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]) & a["turn"].isNotNull().eqNullSafe(b["turn"].isNotNull()), F.lit(False)))
    shorter = F.least(F.size("_c"), F.size("_r"))
    differs = F.array_position(F.slice(same, F.lit(1), shorter), False)
    g = g.withColumn("n_common", F.when(differs > 0, differs - 1).otherwise(shorter).cast("long"))
    rest = lambda c: F.slice(c, F.col("n_common").cast("int") + 1, F.greatest(F.size(c) - F.col("n_common").cast("int"), F.lit(0)))
    return g.select(
        "pair_id", "n_common", _render(F.slice("_c", F.lit(1), F.col("n_common").cast("int"))).alias("prompt"),
        _render(rest("_c")).alias("chosen"), _render(rest("_r")).alias("rejected"), _mask(rest("_c")).alias("chosen_mask"), _mask(rest("_r")).alias("rejected_mask"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """conversations holds no preferences, so its conversations 2k and 2k + 1 are taken as pair k."""
    from .common import table

    x = table(spark, sf_dir, "conversations")
    return format_preferences(x, F.floor(F.col("conv_id") / 2).cast("long"), F.pmod("conv_id", F.lit(2)) == 0)


ORACLE = r"""
WITH t AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS ch, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT pair_id, least(count(*) FILTER (ch), count(*) FILTER (NOT ch)) AS shorter FROM t GROUP BY pair_id),
d AS (SELECT a.pair_id, min(a.i) AS first FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.ch AND NOT b.ch AND a.i = b.i
      WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY a.pair_id),
p AS (SELECT n.pair_id, CAST(coalesce(d.first - 1, n.shorter) AS BIGINT) AS n_common FROM n LEFT JOIN d USING (pair_id)),
r AS (SELECT t.pair_id, p.n_common, ch, i, role, '<|' || coalesce(role, '') || '|>' || chr(10) AS head,
             coalesce(text, '') || '<|end|>' || chr(10) AS body FROM t JOIN p USING (pair_id)),
o AS (SELECT *, CASE WHEN i > n_common THEN coalesce(sum(length(head) + length(body)) FILTER (i > n_common) OVER (PARTITION BY pair_id, ch ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) END AS s FROM r)
SELECT pair_id, n_common,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (ch AND i <= n_common), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (ch AND i > n_common), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (NOT ch AND i > n_common), '') AS rejected,
  coalesce(string_agg(CAST(s AS BIGINT) || ':' || CAST(s + length(body) AS BIGINT), ',' ORDER BY i) FILTER (ch AND i > n_common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(s AS BIGINT) || ':' || CAST(s + length(body) AS BIGINT), ',' ORDER BY i) FILTER (NOT ch AND i > n_common AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY pair_id, n_common
"""
