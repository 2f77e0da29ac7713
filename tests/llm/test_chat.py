import random

from pyspark.sql import functions as F

from skylattice.llm import chat
from tests.compare import SMALL, connect, rows


def plain(turns):
    pairs = {}
    for pair, chosen, turn, role, text in turns:
        if pair is not None and chosen is not None:
            pairs.setdefault(pair, ([], []))[0 if chosen else 1].append((turn, role, text))
    out = []
    key = lambda t: tuple((v is not None, v if v is not None else 0) for v in t)
    for pair, sides in pairs.items():
        c, r = (sorted(s, key=key) for s in sides)
        n = 0
        while n < min(len(c), len(r)) and c[n][1:] == r[n][1:] and (c[n][0] is None) == (r[n][0] is None):
            n += 1
        show = lambda ts: "".join(f"<|{ro or ''}|>\n{te or ''}<|end|>\n" for _, ro, te in ts)

        def mask(ts):
            at, spans = 0, []
            for _, ro, te in ts:
                start = at + len(f"<|{ro or ''}|>\n")
                at = start + len(f"{te or ''}<|end|>\n")
                if ro == "assistant":
                    spans.append(f"{start}:{at}")
            return ",".join(spans)

        out.append((pair, n, show(c[:n]), show(c[n:]), show(r[n:]), mask(c[n:]), mask(r[n:])))
    return sorted(out)


def test_equals_plain_version(spark):
    r = random.Random(4)
    turns = []
    for pair in range(30):
        base = [(k, r.choice(["user", "assistant", None]), r.choice(["é", "hello there", "", None])) for k in range(r.randint(0, 5))]
        for chosen in (True, False):
            own = base[: r.randint(0, len(base))] + [(k + 9, "assistant", f"t{r.randint(0, 2)}") for k in range(r.randint(0, 3))]
            turns += [(pair, chosen, *t) for t in own] + ([(pair, chosen, *own[-1])] if own and pair % 7 == 0 else [])
    turns += [(None, True, 1, "user", "x"), (99, None, 1, "user", "x"), (100, True, None, "user", "x"), (100, False, None, "user", "x")]
    df = spark.createDataFrame(turns, "p long, c boolean, turn long, role string, text string").withColumn("n_common", F.lit("clash"))
    got = sorted(map(tuple, chat.format_preferences(df, F.col("p"), F.col("c")).collect()))
    assert got == plain(turns)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_preferences(df, F.col("conv_id"), F.lit(True)).count() == 0


def test_query_equals_sql(spark):
    assert rows(chat.query(spark, SMALL).toPandas()) == rows(connect().sql(chat.ORACLE).df())


def test_native(spark):
    plan = chat.query(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
