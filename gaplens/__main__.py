"""``python -m gaplens --data FILE | --train FILE --predict FILE [--target C] [--out DIR] [--json-summary]``"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans.audit import Audit
from .sources.files import read_csv


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gaplens", description="Audit missing values and plan their imputation.")
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("--data", help="one CSV file or Parquet folder")
    one.add_argument("--train", help="training rows")
    p.add_argument("--predict", help="rows to predict")
    p.add_argument("--target")
    p.add_argument("--out", default="outputs")
    p.add_argument("--json-summary", action="store_true", help="print the plan as JSON")
    a = p.parse_args(argv)
    if a.predict and not a.train:
        p.error("--predict needs --train")
    spark = SparkSession.builder.appName("gaplens").getOrCreate()
    read = lambda x: read_csv(spark, x) if x.endswith(".csv") else spark.read.parquet(x)
    audit = Audit(read(a.data or a.train), read(a.predict) if a.predict else None, target=a.target)
    r = audit.run()
    audit.save(a.out, {"data": a.data or a.train})
    if a.json_summary:
        print(json.dumps(r["plan"], indent=2, default=str))
    else:
        print("strategies:", *(f"{k}={v}" for k, v in r["plan"]["summary"]["strategy_counts"].items()))
        print("leakage:", *(f"{k}={v}" for k, v in r["leakage"]["summary"].items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
