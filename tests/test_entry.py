"""The driver contract."""

import subprocess
import sys

import __spark_entry__ as entry


def test_names_and_sql_agree():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 60
    assert all(callable(f) for f in names.values())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1500 and set(rows[0].asDict()) == {"o_orderkey", "price", "price_was_missing"}


def test_library_does_not_import_the_corpus_part():
    code = "import sys, gaplens, gaplens.plans.registry, gaplens.streaming.apply, gaplens.operators.charts; sys.exit(any(m.startswith('gaplens.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rpartition("/")[0], timeout=120).returncode == 0


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from pyspark.sql import SparkSession

    from gaplens.__main__ import main

    rows = [(float(i), None if i % 4 == 0 else i * 2.0, "ab"[i % 2]) for i in range(60)]
    spark.createDataFrame(rows, "a double, b double, c string").coalesce(1).write.csv(f"{tmp_path}/in.csv", header=True)
    monkeypatch.setattr(SparkSession, "stop", lambda self: None)
    assert main(["--data", f"{tmp_path}/in.csv", "--out", f"{tmp_path}/out"]) == 0
    assert "strategies:" in capsys.readouterr().out
