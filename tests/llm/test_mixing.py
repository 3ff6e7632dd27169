"""Mixing against SQL, and the properties of the raking."""

import pytest

from gaplens.llm import mixing

from .oracle import assert_same


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert_same(mixing.op6_mixing(spark, d), mixing.OP6_SQL, d)


def test_marginals_meet_targets(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = mixing.mixed(docs).select("row.lang", "tokens", "probability", "kept").collect()
    total = sum(r.tokens for r in rows)
    expected = sum(r.tokens * r.probability for r in rows)
    assert abs(expected / total - mixing.FRACTION) < 1e-6
    kept = sum(r.tokens for r in rows if r.kept)
    assert abs(kept / total - mixing.FRACTION) < 0.08
    cells = [{"source": f"s{i % 3}", "lang": f"l{i % 2}", "topic": f"t{i}", "tokens": 100 * (i + 1)} for i in range(6)]
    raked = mixing.rake(cells, {"source": 0.0, "lang": {"0": 0.5}, "topic": 1.0}, rounds=1)
    assert abs(sum(c["weight"] for c in raked) - 2100) < 1e-6


def test_topics_come_from_the_texts(spark):
    texts = ["apples apples Plums", "apples, plums", "plums grow on trees", "éclair éclair", None, "", "plums", "x y z", "apples", "words", "words words plums apples"] + ["nothing"] * 12
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    # "nothing" is in more than a fifth
    names = mixing.topic_terms(df, count=3)
    assert names == ["apples", "words", "trees"]
    got = [r.topic for r in df.orderBy("doc_id").select(mixing.topic_of(mixing.F.col("text"), ["plums", "apples", "words"]).alias("topic")).collect()]
    assert got[:11] == ["apples", "apples", "plums", "other", "other", "other", "plums", "other", "apples", "words", "words"]
    assert mixing.topic_terms(df.limit(0)) == []


def test_many_cells_give_the_same(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    few = {r.row.doc_id: r for r in mixing.mixed(docs).collect()}
    old, mixing.ROUNDS = mixing.ROUNDS, 20
    many = {r.row.doc_id: r for r in mixing.mixed(docs, cells_bound=1).collect()}
    mixing.ROUNDS = old
    assert few.keys() == many.keys()
    assert all(abs(few[k].probability - many[k].probability) < 1e-6 for k in few)


def test_edge_cases(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n", "en", "a"), (None, "some words here", "en", "a"), (5, "w " * 100_000, "xx", "b"), (5, "w " * 100_000, "xx", "b"), (6, "1", "de", None)]
    df = spark.createDataFrame([(*r, 3, 0.1) for r in rows], "doc_id long, text string, lang string, source string, tokens int, p double")
    out = mixing.mixed(df).collect()
    assert len(out) == len(rows) and all(0 <= r.probability <= 1 and r.row.tokens == 3 for r in out)
    assert {r.row.doc_id: r.tokens for r in out} == {1: 0, 2: 0, 3: 0, None: 3, 5: 100_000, 6: 1}
    assert mixing.mixed(df.limit(0)).count() == 0
