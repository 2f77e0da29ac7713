import pandas as pd

from skylattice.llm import mixing
from tests.compare import SMALL, connect, rows


def check(spark, df):
    con = connect()
    pdf = df.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})
    con.register("given", pdf)
    con.sql("create or replace view documents as select * from given")
    got = mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    assert rows(got) == rows(con.sql(mixing.ORACLE).df())
    return got


def test_odd_documents(spark, odd_docs):
    got = check(spark, odd_docs)
    assert (got["taken"] <= 3 * got["size"]).all() and len(got) == odd_docs.count()


def test_query_equals_sql(spark):
    got = mixing.query(spark, SMALL).toPandas()
    assert rows(got) == rows(connect().sql(mixing.ORACLE).df())
    docs = connect().sql("select doc_id, source from documents").df().merge(got, on="doc_id")
    for _, g in docs.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()


def test_small_and_hot_sources(spark):
    rows_ = [(i, "w " * (1 + i % 5), "hot") for i in range(3000)] + [(5000 + i, "a b c", "tiny") for i in range(3)] + [(6000, None, "none")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    got = check(spark, df)
    by = pd.DataFrame(rows_, columns=["doc_id", "t", "source"]).merge(got, on="doc_id").groupby("source")["taken"].sum()
    assert by["tiny"] == 27 and by["none"] == 0  # three times its size, by its cap


def test_only_empty_texts_and_empty_table(spark, no_docs):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(df).collect()] == [0, 0]
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_documents_are_repeated_as_taken(spark, odd_docs):
    m = mixing.mix(odd_docs).filter("size > 0").groupBy("doc_id").sum("copies").toPandas()
    d = mixing.mixed_documents(odd_docs)
    assert d.columns == odd_docs.columns
    n = d.filter("length(trim(text)) > 0").groupBy("doc_id").count().toPandas()
    a, b = ({(None if pd.isna(k) else int(k)): int(v) for k, v in t.itertuples(index=False) if v} for t in (m, n))
    assert a == b
    plan = mixing.mix(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_reruns_take_the_same_of_equal_ids_and_sizes(spark):
    """Many different texts of one id and size: whatever order they come in, the same are repeated."""
    rows = [(i % 3, f"word{i} " + "w " * (i % 2), "a" if i % 5 else "b") for i in range(60)] + [(1, "w " * 5000, "b")]
    takes = []
    for part in (1, 7):
        docs = spark.createDataFrame(rows if part == 1 else rows[::-1], "doc_id long, text string, source string").repartition(part)
        takes.append(sorted((r["doc_id"], r["text"]) for r in mixing.mixed_documents(docs).collect()))
    assert takes[0] == takes[1] and len(takes[0]) != len(set(takes[0]))


def test_texts_of_a_hot_id_are_spread(spark):
    """A third of all rows under one id, and a tenth without an id: no bucket of the running sums is much larger than others."""
    data = [(7 if i % 3 == 0 else None if i % 10 == 1 else i, f"text {i} " + "w " * (i % 4), "a") for i in range(30_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    sizes = [r["count"] for r in mixing._queued(docs, 7, False).groupBy("rank", "_b").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 1.25 * sum(sizes) / len(sizes)
    check(spark, docs.limit(3000))
