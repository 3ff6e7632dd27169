"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts.
A text is cut into fixed chunks, each compressed once with either dictionary; the
difference of the summed sizes over their sum, and the logarithm of the compressed
share of the text, become a score by logistic calibration on labelled texts that
neither dictionary has seen. The share tells repetitive texts, which both dictionaries
compress to nearly nothing, so that the difference says little.

Training uses at most ``per_class`` labelled texts of each class (those with the
smallest hashed ids), skipping texts over ``longest`` code points and stopping at
``class_bytes``; the bounds are parameters. Texts are chosen by their sizes, and only
the chosen ones are fetched. Scoring covers every text as a whole, chunk by chunk, so
a very long text takes no more memory than itself.

Edge cases: a null or empty text tells nothing and scores ``prior``, the share of good
labels; null and repeated ids are scored row by row, and a text that rows of one id
repeat is learnt from once; labels that are null are not learnt from; several labels
of one id each count; without a label of either class every score is the prior (0.5
where there is no label). Other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, encode, per_row, store, table

CHUNK = 512
DICTIONARY = 64 * 1024
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slopes: tuple[float, float]
    offset: float
    prior: float

    def packers(self):
        made = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return made


def measures(raw: bytes, packers) -> tuple[float, float]:
    """(bad - good) / (bad + good) of the chunk-wise compressed sizes, and log(good / bytes)."""
    good = bad = 0
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK]
        good += len(packers[0].compress(part))
        bad += len(packers[1].compress(part))
    return (bad - good) / (bad + good), math.log(good / len(raw))


def chance(raw: bytes, model: Model, packers) -> float:
    """The score of a text."""
    if not raw:
        return model.prior
    x = measures(raw, packers)
    z = model.slopes[0] * x[0] + model.slopes[1] * x[1] + model.offset
    return 1 / (1 + math.exp(-min(max(z, -50.0), 50.0)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with smoothed targets by Newton's method: the slopes, then the offset."""
    ones, zeros = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(len(w)), a.T @ (p - goal) + 1e-4 * w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def _dictionary(texts: list[bytes]) -> bytes:
    """Chunks of the texts as samples; with too few for training, their raw content."""
    samples = [t[at : at + CHUNK] for t in texts for at in range(0, len(t), CHUNK)]
    size = min(DICTIONARY, max(256, sum(map(len, samples)) // 10))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:] or b"\x00" * 8


def _sample(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, per_class: int, longest: int, class_bytes: int) -> dict[int, list[bytes]]:
    """Labelled texts by class, in the order of their hashed ids: sizes are looked at first, and only texts within the bounds fetched."""
    order = ["h", "_id", "tag"]
    ids = [marks.where(F.col("_y") == y).select("_id", "_y").orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (1, 0)]
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.xxhash64(text_col).alias("tag"))
    # at most per_class ids of each class are broadcast; the texts stay where they are
    near = texts.where(F.length("_t").between(1, longest)).join(F.broadcast(ids[0].unionByName(ids[1])), "_id")
    sizes = store(near.groupBy("_y", "_id", "tag").agg(F.min(F.octet_length("_t")).alias("size")).withColumn("h", F.xxhash64("_id")), "label-sizes")
    chosen = []
    for y in (1, 0):
        size = 0
        for r in sizes.where(F.col("_y") == y).orderBy(*order).limit(per_class).collect():
            if size >= class_bytes:
                break
            chosen.append((r["_y"], r["_id"], r["tag"]))
            size += r["size"]
    discard(sizes)
    keys = docs.sparkSession.createDataFrame(chosen, f"_y int, _id {docs.schema[id_col].dataType.simpleString()}, tag long")
    rows = texts.join(F.broadcast(keys), ["_id", "tag"]).groupBy("_y", "_id", "tag").agg(F.min("_t").alias("t")).withColumn("h", F.xxhash64("_id"))
    found = sorted(rows.collect(), key=lambda r: [r[c] for c in order])
    return {y: [encode(r["t"]) for r in found if r["_y"] == y] for y in (1, 0)}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 6000, longest: int = 20_000, class_bytes: int = 6_000_000) -> Model:
    """Learn from a bounded sample of the labelled rows outside the held-out fold."""
    kind = docs.schema[id_col].dataType
    marks = labels.select(F.col(id_col).cast(kind).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & (F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(5)) != 0))
    counts = {r["_y"]: r["count"] for r in marks.groupBy("_y").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    prior = min(max(n1 / (n1 + n0), 1e-6), 1 - 1e-6) if n1 + n0 else 0.5
    flat = Model(b"\x00" * 8, b"\x00" * 8, (0.0, 0.0), math.log(prior / (1 - prior)), prior)
    sides = _sample(docs, marks, id_col, text_col, per_class, longest, class_bytes) if n1 and n0 else {0: [], 1: []}
    if not sides[0] or not sides[1]:
        return flat
    seen = {y: t[::2] for y, t in sides.items()}
    apart = {y: t[1::2] or t for y, t in sides.items()}
    model = Model(_dictionary(seen[1]), _dictionary(seen[0]), (0.0, 0.0), 0.0, prior)
    packers = model.packers()
    x = np.array([measures(t, packers) for y in (1, 0) for t in apart[y]])
    y = np.array([y for y in (1, 0) for _ in apart[y]])
    *slopes, offset = _calibrate(x, y).tolist()
    # the sample holds the classes in other proportions than the labels do
    offset += math.log(n1 / n0) - math.log((y == 1).sum() / (y == 0).sum())
    model.slopes, model.offset = tuple(slopes), offset
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text", least: float | None = None) -> DataFrame:
    """The input with a ``score`` column in the end; with ``least`` only rows that reach it, without the column."""
    out = "_score"
    while out in docs.columns:
        out += "_"

    def work(rows: dict) -> dict:
        packers = model.packers()
        return {out: [chance(encode(t), model, packers) for t in rows[text_col]]}

    run = per_row([text_col], work, pa.schema([(out, pa.float64())]), keep=True)

    def only(batches):
        for b in run(batches):
            yield b.filter(pc.greater_equal(b.column(out), least)) if least is not None else b

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    found = docs.mapInArrow(only, schema)
    return found.drop(out) if least is not None else found


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; fitted outside the fold crc32(doc_id) mod 5 = 0."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), model)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return out.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
