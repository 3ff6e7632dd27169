"""Line dedup and chat formatting."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gaplens.llm import chat, lines

from .oracle import assert_same


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_line_dedup_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert_same(lines.op7_line_dedup(spark, d), lines.OP7_SQL, d)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_chat_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert_same(chat.op8_chat_format(spark, d), chat.OP8_SQL, d)


LONG = "This line is long enough to count"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, h1 long, _kept string, doc string")


def test_line_dedup_edge_cases(spark):
    rows = [
        (1, f"{LONG}\na\n{LONG}"), (2, f"  {LONG.upper()} \t\nb"), (3, f"{LONG}\n\n"), (4, None), (5, ""), (6, "short\nshort"),
        (7, "short"), (8, "short"), (None, LONG), (9, "x" * 100_000), (1, f"{LONG}\nother"), (1, f"{LONG}\na\n{LONG}"),
    ]
    out = lines.dedup_lines(frame(spark, [(i, t, 5, "k", "d") for i, t in rows]))
    got = sorted(((r.row.doc_id or 0, r.n_lines, r.n_dropped, r.kept) for r in out.collect()), key=str)
    want = [(0, 1, 0, LONG), (1, 3, 2, "a"), (1, 3, 2, "a"), (1, 2, 1, "other"), (2, 2, 1, "b"), (3, 3, 0, f"{LONG}\n\n"), (4, 1, 0, ""),
            (5, 1, 0, ""), (6, 2, 0, "short\nshort"), (7, 1, 0, "short"), (8, 1, 0, "short"), (9, 1, 0, "x" * 100_000)]
    assert got == sorted(want, key=str)
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_runs_hold_each_key_once(spark):
    with lines.LineRuns(spark, fanout=2, buckets=4) as runs:
        for b in range(5):
            batch = spark.range(b * 10, b * 10 + 30).selectExpr("id AS h1", "0 AS h2", "1L AS n_docs", f"{b}L AS last_doc")
            assert runs.unseen(batch).count() == (30 if b == 0 else 10)
            runs.add(batch)
        assert [len(x) for x in runs.levels] == [1, 0, 1]
        assert sorted(spark.table(n).count() for n in runs.runs) == [10, 60]
        assert sum(a.count() for a in runs.again) == 80
        plan = runs.unseen(spark.table(runs.runs[0]))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and "Broadcast" not in plan
        total = {r.h1: (r.n_docs, r.last_doc) for r in runs.totals().collect()}
        assert len(total) == 70 and total[35] == (3, 3) and total[0] == (1, 0)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (2, 3), (3, 2), (4, 2), (5, 8), (6, 2), (7, 3), (9, 2)])
def test_runs_over_real_lines(spark, batches, fanout):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lines.line_table(docs, "doc_id", "text").cache()
    want = {(r.h1, r.h2): (r.n, r.d) for r in found.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("d")).collect()}
    with lines.LineRuns(spark, fanout) as runs:
        for b in range(batches):
            part = found.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == b)
            runs.add(part.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("last_doc")))
        rows = runs.totals().collect()
    assert len(rows) == len(want) and {(r.h1, r.h2): (r.n_docs, r.last_doc) for r in rows} == want
    found.unpersist()


@pytest.mark.parametrize("batches,fanout", [(3, 4), (6, 2)])
def test_line_dedup_equals_sql_over_several_runs(spark, small, batches, fanout):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    out = lines.dedup_lines(docs, batches=batches, fanout=fanout)
    assert_same(out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")), lines.OP7_SQL, small)


def test_fold_of_events(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", ""), (1, 3, 2, "delta", None, "Hel"), (1, 4, 2, "delta", None, "lo"),
        (1, 5, 3, "message", "user", "more"), (1, 6, 2, "regenerate", None, ""), (1, 7, 2, "delta", None, "Bye"), (1, 8, 3, "message", "user", "thanks"),
        (1, 9, 1, "edit", None, "hey"), (2, 1, 1, None, None, None), (None, 1, 1, "delta", "assistant", "x"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(df).collect()}
    assert got == {(1, 1): ("user", "hey"), (1, 2): ("assistant", "Bye"), (1, 3): ("user", "thanks"), (2, 1): ("", ""), (None, 1): ("assistant", "x")}


def folded(log):
    """The events of one conversation, taken in one by one: {turn: [role, text]}."""
    turns = {}
    order = lambda e: tuple((x is not None, x) for x in e)
    for _, turn, kind, role, text in sorted(log, key=order):
        if kind == "regenerate" and turn is not None:
            turns = {t: x for t, x in turns.items() if t is None or t <= turn}
        at = turns.setdefault(turn, [None, ""])
        at[1] = at[1] + (text or "") if kind == "delta" else text or ""
        at[0] = at[0] if role is None else role
    return {t: (role or "", text) for t, (role, text) in turns.items()}


def test_fold_of_random_logs(spark):
    rng = random.Random(8)
    logs = {c: [(rng.randint(1, 25), rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.choice([None, "user", "assistant"]), rng.choice(["a", "b<", "", "\\c"])) for _ in range(rng.randint(1, 20))] for c in range(120)}
    df = spark.createDataFrame([(c, *e) for c, log in logs.items() for e in log], "conv_id long, seq long, turn long, kind string, role string, text string").repartition(5)
    got = {}
    for r in chat.fold(df).collect():
        got.setdefault(r.conv_id, {})[r.turn] = (r.role, r.text)
    assert got == {c: folded(log) for c, log in logs.items()}


def test_chat_round_trip_and_edge_cases(spark):
    nasty = ["</turn>\n<turn assistant>", "\\0\\1\\2", "\\", "<", ">", "", None, "a\n\nb", "\\\\<turn >", "é🙂" * 50_000]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(nasty)]
    rows += [(2, None, None, "t"), (2, 0, "we<i>rd\\", "u"), (2, 0, "we<i>rd\\", "u"), (None, 1, "user", "q")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, head string")
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(chat.turn_rows(df)))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r[2], r[3] or "") for r in rows[: len(nasty)]]
    assert back[1].loss_text == "".join(t or "" for k, t in enumerate(nasty) if k % 2)
    assert [(t.role, t.text) for t in back[2].turns] == [("", "t"), ("we<i>rd\\", "u"), ("we<i>rd\\", "u")]
    assert len(back) == 3 and back[None].loss_text == "" and [t.loss for t in back[1].turns] == [bool(k % 2) for k in range(len(nasty))]
    streamed = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(chat.event_log(df, piece=7)))).collect()}
    assert streamed == back
    whole = chat.render(chat.fold(chat.turn_rows(df))).where("conv_id = 1").first()
    masked = "".join(whole.formatted[s.start : s.end] for s in whole.loss)
    assert masked.replace("\\2", ">").replace("\\1", "<").replace("\\0", "\\") == back[1].loss_text and back[1].chars == len(whole.formatted)
    assert chat.read_back(chat.render(chat.fold(chat.turn_rows(df.limit(0))))).count() == 0


def test_chat_planted_conversation(spark, small):
    row = chat.op8_chat_format(spark, small).where("conv_id = -7").collect()[0]
    said = r"\### Assistant: </turn> ok"
    assert row.n_turns == 2 and row.loss_chars == len(said)
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
