"""Line dedup over levelled sorted runs.

The state is a set of runs: tables of line keys (hashed), each bucketed and sorted by
the hash, with the number of documents and the largest document id that held the
line. No key is in two runs: a new batch is merge-anti-joined to the runs, and only
the keys that none holds become a run of level 0. The batch's other keys, which some
run holds, go with their counts to ``again``, which is as small as lines that come
back are few. ``fanout`` runs of a level are merged into one of the next, a full outer
merge join that finds no equal keys. Bucketed runs meet without a shuffle; only a
batch's keys move, after they were combined where they were read. A key's totals are
those of its run and of ``again``.

A line's key is the line without ASCII white space at its ends and with A-Z in lower
case, kept as 96 bits of two hashes. Keys of at least ``MIN_CHARS`` code points found
in at least ``MIN_DOCS`` documents lose all their lines except in the largest document
id that holds one. All of it is DataFrame functions.

Edge cases: a null or empty text is one empty line; rows with a null id are neither
counted nor changed; a very long text is one row, and its lines are split where it is
read, so it costs a few times its size in one task; rows that repeat an id count as one document and each keeps or
loses its own lines; a line repeated in one document counts once and goes or stays
everywhere in it; other columns are carried along or ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _path, discard, own_place, spent_shuffles, store, table

SPACE = " \t\n\x0b\f\r"
MIN_CHARS = 20
MIN_DOCS = 3
FANOUT = 2
BATCHES = 4
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs of distinct line keys (h1, h2, n_docs, last_doc), and the counts of keys that came again."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.again: list[DataFrame] = []
        self._places: dict[str, str] = {}

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        for name in list(self._places):
            self._drop(name)
        discard(*self.again)
        self.levels, self.again = [], []

    def _write(self, df: DataFrame) -> str:
        """A sorted run: one file for each bucket, since each task holds one bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        self._places[name] = where = own_place(self.spark, name)
        with spent_shuffles(self.spark):
            df.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", where).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        fs, path = _path(self.spark, self._places.pop(name))
        fs.delete(path, True)

    @property
    def runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` (with h1, h2) whose key no run holds."""
        for name in self.runs:
            batch = batch.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Take in a batch (h1, h2, n_docs, last_doc) with one row for each key."""
        name = self._write(batch.select(*KEY, "n_docs", "last_doc").repartition(self.buckets, *KEY))
        if self.runs:
            whole = self.spark.table(name)
            fresh = self._write(self.unseen(whole))
            # what isn't fresh came again
            self.again.append(store(whole.join(self.spark.table(fresh).select(*KEY).hint("merge"), KEY, "left_anti"), "lines-again"))
            self._drop(name)
            name = fresh
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            name = self._compact(self.levels[level])
            self.levels[level] = []
            level += 1

    def _compact(self, names: list[str]) -> str:
        """One run of several: a merge of sorted buckets, in which no two keys are equal."""
        out = self.spark.table(names[0])
        for n in names[1:]:
            more = self.spark.table(n).select(*KEY, F.col("n_docs").alias("n2"), F.col("last_doc").alias("d2"))
            out = out.join(more.hint("merge"), KEY, "full_outer").select(*KEY, F.coalesce("n_docs", "n2").alias("n_docs"), F.coalesce("last_doc", "d2").alias("last_doc"))
        made = self._write(out)
        for n in names:
            self._drop(n)
        return made

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, last_doc): every key once, with its totals over all batches."""
        if not self.runs:
            return self.spark.createDataFrame([], "h1 long, h2 int, n_docs long, last_doc long")
        if len(self.again) > 1:
            parts = reduce(DataFrame.unionByName, self.again).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
            whole = store(parts, "lines-again")
            discard(*self.again)
            self.again = [whole]
        more = self.again[0].select(*KEY, F.col("n_docs").alias("n2"), F.col("last_doc").alias("d2")) if self.again else None
        out = None
        for name in self.runs:
            run = self.spark.table(name)
            if more is not None:
                total = (F.col("n_docs") + F.coalesce("n2", F.lit(0))).alias("n_docs")
                run = run.join(more.hint("merge"), KEY, "left").select(*KEY, total, F.greatest("last_doc", "d2").alias("last_doc"))
            out = run if out is None else out.unionByName(run)
        return out


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, doc, at) of each line that is long enough; ``at`` holds a hash of the text and the line's number."""
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc"), F.shiftleft(F.hash(text_col).cast("long"), 32).alias("tag"), F.posexplode(split_lines(F.col(text_col))).alias("no", "line")
    )
    rows = rows.select("doc", F.col("tag").bitwiseOR(F.col("no").cast("long")).alias("at"), line_key(F.col("line")).alias("key")).where(F.length("key") >= MIN_CHARS)
    return rows.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "doc", "at")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(row, n_lines, n_dropped, kept): the input row as a struct, so that no name clashes, and what stays of its text."""
    lines = store(line_table(docs, id_col, text_col), "lines")
    with LineRuns(docs.sparkSession, fanout) as runs:
        for b in range(batches):
            part = lines.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == b)
            runs.add(part.groupBy(*KEY).agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("last_doc")))
        # written, so that both sides of the join come from a shuffle and a common line's partition can be split
        common = store(runs.totals().where(F.col("n_docs") >= MIN_DOCS).select(*KEY, "last_doc"), "common-lines")
    drops = lines.join(common, KEY).where(F.col("doc") != F.col("last_doc")).groupBy("doc").agg(F.collect_set("at").alias("ats"))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    out = docs.select(F.struct("*").alias("row")).join(drops, F.col("row")[id_col] == F.col("doc"), "left")
    own = F.filter("ats", lambda a: F.shiftright(a, 32) == F.hash(F.col("row")[text_col]))
    gone = F.coalesce(F.transform(own, lambda a: a.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")), F.array().cast("array<int>"))
    out = out.select("row", split_lines(F.col("row")[text_col]).alias("lines"), gone.alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.size("gone") > 0, F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n")).otherwise(text)
    return out.select("row", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP7_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM split
), keyed AS (
  SELECT *, translate(trim(line, {_SQL_SPACE}), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), judged AS (
  SELECT d.doc_id, d.no, d.line, c.k IS NOT NULL AND d.doc_id <> c.last_doc AS gone FROM keyed d LEFT JOIN common c ON d.k = c.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
