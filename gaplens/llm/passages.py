"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every window of 50 words the 20-word gram with the
least hash. Equal windows have equal anchors, so documents that share a window meet
when anchors are joined; what shares no anchor shares no window and is done with.

An anchor's reach is the run of windows that chose it: some words before the anchor,
the anchor, some words after it. A place whose reach equals (by 128 bits) that of a
document with a smaller id is a repeat as far as it reaches. Where reaches of one
anchor differ, one place of each distinct reach is compared word by word with a
representative, the place of the smallest document: the match is extended to the left
and to the right as far as words agree, and the windows inside it are repeats. Windows
that go beyond the match can only be shared with places that depart from the
representative at the same word in the same way, so these meet in groups of their
own, with a representative of their own, until nothing is left to compare. Each round
compares a place once, whatever the size of its group. Neighbouring repeats are joined
to maximal ones, which have at least 50 words each.

Texts are shuffled once, into a table bucketed by row number; seeds are made there and
spans come back there. Every meeting of seeds is an aggregation that combines before
it shuffles, or a join with such an aggregate. Aggregates are written first: both
sides of a join then come straight from a shuffle, and Spark can split the partition
of a common key.

Edge cases: a null text has no words; texts under 50 words keep everything; a very
long text is hashed a stretch at a time, and costs a few times its size in one task;
rows with a null id keep everything and are no source; rows that repeat an id are one
document, so they are never a smaller one to each other; other columns are carried
along in ``row``; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, discard, encode, own_place, spent_shuffles, store, table

WINDOW = 50
GRAM = 20
_U = np.uint64
#: Multipliers of the rolling hash and of its final mixing.
BASE = 0x9E3779B97F4A7C15
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    for m in MIX:
        x = (x ^ (x >> _U(33))) * _U(m)
    return x ^ (x >> _U(33))


class Rolling:
    """Hashes of any byte ranges of a buffer, by prefix sums modulo 2^64."""

    symbols = None
    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    @classmethod
    def grow(cls, n: int) -> None:
        if cls.symbols is None:
            cls.symbols = mixed(np.arange(1, 257, dtype=np.uint64) * _U(BASE)) | _U(1)
        if len(cls.powers) < n:
            size = 1 << (n - 1).bit_length()
            for name, step in (("powers", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
                line = np.full(size, step, np.uint64)
                line[0] = 1
                setattr(cls, name, np.multiply.accumulate(line))

    def __init__(self, buf: bytes):
        self.grow(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.symbols[np.frombuffer(buf, np.uint8)] * self.powers[: len(buf)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def range_hashes(buf: bytes, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Hashes of ascending byte ranges, over a stretch of the buffer at a time, so that a long text takes little memory."""
    out = [np.zeros(0, np.uint64)]
    for at in range(0, len(starts), step):
        s, e = starts[at : at + step], ends[at : at + step]
        out.append(Rolling(buf[s[0] : e[-1]]).of(s - s[0], e - s[0]))
    return np.concatenate(out)


def bounds(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text joined by single spaces."""
    cut = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
    return np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(buf)]])


def anchors(text: str | None, window: int = WINDOW, gram: int = GRAM):
    """(anchor, r1, r2, first, n, hi) of each winnowed anchor: its hash, 128 bits of its reach, the first of the
    ``n`` windows that chose it, and how many words before the anchor that window begins."""
    buf = b" ".join(encode(text).split())
    starts, ends = bounds(buf)
    n = len(starts)
    if not buf or n < window:
        return None
    g = range_hashes(buf, starts[: n - gram + 1], ends[gram - 1 :])
    width = window - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(g, width)
    stretches = ((at, view[at : at + (1 << 13), ::-1]) for at in range(0, len(view), 1 << 13))
    choice = np.concatenate([at + width - 1 - part.argmin(axis=1) + np.arange(len(part)) for at, part in stretches])
    first = np.flatnonzero(np.concatenate([[True], choice[1:] != choice[:-1]]))
    last = np.concatenate([first[1:], [len(choice)]]) - 1
    anchor = choice[first]
    hi, count = anchor - first, last - first + 1
    places, begin, end = (hi * 64 + count).tolist(), starts[first].tolist(), ends[last + window - 1].tolist()
    digests = b"".join(xxhash.xxh3_128_digest(buf[b:e], place) for b, e, place in zip(begin, end, places))
    reach = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return g[anchor].view(np.int64), reach[:, 0], reach[:, 1], first.astype(np.int32), count.astype(np.int32), hi.astype(np.int32)


def _anchor_rows(window: int, gram: int):
    """Seeds of (rid, doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "r1", "r2", "doc", "rid", "first", "n", "hi"]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                made = []
                for rid, doc, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                    if (found := anchors(text, window, gram)) is not None:
                        size = len(found[0])
                        made.append((*found[:3], np.full(size, doc, np.int64), np.full(size, rid, np.int64), *found[3:]))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names=names)

    return run


#: A place to compare: its group, its reach, its document, the least and largest number of words before the anchor
#: that a window still in question begins with, the words before the anchor, and those from it on. ``found``
#: marks the result instead: windows that a smaller document has.
PLACE = "k1 long, k2 long, anchor long, r1 long, r2 long, doc long, lo int, hi int, left binary, right binary, found boolean"
_PLACE = pa.schema([*((c, pa.int64()) for c in ("k1", "k2", "anchor", "r1", "r2", "doc")), ("lo", pa.int32()), ("hi", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("found", pa.bool_())])


def _place_rows(window: int):
    """Places of the listed reaches (anchor, r1, r2, doc, first, n, hi) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                part, rows = whole.slice(at, 64), []
                for text, reaches in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = encode(text).split()
                    for x in reaches:
                        middle = x["first"] + x["hi"]
                        left, right = words[x["first"] : middle], words[middle : x["first"] + x["n"] - 1 + window]
                        rows.append((x["anchor"], 0, x["anchor"], x["r1"], x["r2"], x["doc"], x["hi"] - x["n"] + 1, x["hi"], b" ".join(left), b" ".join(right), False))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PLACE)], schema=_PLACE)

    return run


def agreed(a: list[bytes], b: list[bytes]) -> int:
    """How many words two lists have in common at their beginning."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def extended(lo: int, hi: int, left: bytes, right: bytes, rep_left: bytes, rep_right: bytes, window: int):
    """Extend a match both ways: (least, largest) of the windows inside it, if any, and what goes beyond it on
    the left and on the right: (least, largest, the words up to the first that differs), or None."""
    ls, rs = left.split(), right.split()
    l, r = agreed(ls[::-1], rep_left.split()[::-1]), agreed(rs, rep_right.split())
    inside = (max(lo, window - r), min(hi, l))
    over_left = (max(lo, l + 1), hi, b"l" + b" ".join(ls[len(ls) - l - 1 :])) if hi > l else None
    last = min(hi, l, window - r - 1)
    over_right = (lo, last, b"r" + b" ".join(rs[: r + 1])) if lo <= last else None
    return inside if inside[0] <= inside[1] else None, over_left, over_right


def _extend_rows(window: int):
    """Compares places with the representative of their group: what was found, and what is still to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                rows = []
                for *key, doc, lo, hi, left, right, rep_doc, rep_left, rep_right in zip(*(c.to_pylist() for c in whole.slice(at, 512).columns)):
                    inside, *beyond = extended(lo, hi, left, right, rep_left, rep_right, window)
                    if inside and doc > rep_doc:  # another place of the same document goes on, as others may match it
                        rows.append((*key, doc, *inside, None, None, True))
                    for low, high, words in filter(None, beyond):
                        raw = xxhash.xxh3_128_digest(b"%d %d " % (key[0], key[1]) + words)
                        group = int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)
                        rows.append((*group, *key[2:], doc, low, high, left, right, False))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PLACE)], schema=_PLACE)

    return run


def extensions(places: DataFrame, window: int) -> list[DataFrame]:
    """Written tables of places, whose rows marked ``found`` hold the windows that a smaller document has, one for each round."""
    found, now = [], places
    for k in range(2 * window):
        rep = F.min(F.struct("doc", "anchor", "r1", "r2", "left", "right"))
        heads = now.groupBy("k1", "k2").agg(rep.alias("rep"), F.max("doc").alias("most")).where("rep.doc < most")
        heads = store(heads.select("k1", "k2", F.col("rep.doc").alias("rep_doc"), F.col("rep.left").alias("rep_left"), F.col("rep.right").alias("rep_right")), "representatives")
        if heads.isEmpty():
            discard(heads, now if k == 0 else None)
            return found
        met = now.join(heads, ["k1", "k2"]).select("k1", "k2", "anchor", "r1", "r2", "doc", "lo", "hi", "left", "right", "rep_doc", "rep_left", "rep_right")
        after = store(met.mapInArrow(_extend_rows(window), PLACE), "places")
        discard(heads, now if k == 0 else None)
        found.append(after)
        now = after.where("NOT found")
    raise RuntimeError("more rounds than a window has words")


def _windows(codes: np.ndarray) -> np.ndarray:
    """The window numbers that span codes (first * 64 + count) stand for, each once."""
    first, n = codes >> 6, codes & 63
    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.unique(at)


def _cut_rows(text_col: str, window: int, schema: pa.Schema):
    """Adds what is left of each text to (row, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                texts = part.column(0).field(text_col).to_pylist() if part.column(0).null_count == 0 else [r[text_col] for r in part.column(0).to_pylist()]
                n_words, n_removed, kept, repeats = [], [], [], []
                for text, spans in zip(texts, part.column(1)):
                    words = encode(text).split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    if spans.is_valid and len(spans.values):
                        first = _windows(spans.values.to_numpy())
                        np.add.at(gone, first, 1)
                        np.add.at(gone, first + window, -1)
                    stay = np.cumsum(gone)[:-1] == 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]]).astype(np.int8)))
                    n_words.append(len(words))
                    n_removed.append(int((~stay).sum()))
                    kept.append(b" ".join(compress(words, stay.tolist())).decode("utf-8", "surrogatepass"))
                    repeats.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                arrays = [pa.array(x, f.type) for x, f in zip((n_words, n_removed, kept, repeats), schema)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["row", *schema.names])

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """(rid, row): the rows, each with a number of its own, in a table bucketed by it."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"numbered_{uuid.uuid4().hex}"
    rows = docs.select(F.struct("*").alias("row")).select(F.monotonically_increasing_id().alias("rid"), "row").repartition(parts, "rid")
    with spent_shuffles(spark):
        rows.write.bucketBy(parts, "rid").option("path", own_place(spark, name)).saveAsTable(name)
    return spark.table(name)


def repeated_spans(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Written (rid, spans) for (rid, doc, text): span codes (first * 64 + count) of the windows that a smaller document has."""
    seeds = store(texts.select("rid", "doc", "text").mapInArrow(_anchor_rows(window, gram), "anchor long, r1 long, r2 long, doc long, rid long, first int, n int, hi int"), "seeds")
    ends = [f(c).alias(f"{c}_{k}") for c in ("r1", "r2") for k, f in enumerate((F.min, F.max))]
    met = seeds.groupBy("anchor").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), *ends).where("least < most")
    met = store(met.select("anchor", "least", F.expr("r1_0 = r1_1 AND r2_0 = r2_1").alias("alike")), "met")
    shared = store(seeds.join(met, "anchor").where("NOT alike OR doc > least"), "shared-seeds")
    discard(seeds, met)

    # one place of each distinct reach is compared; where a smaller document has the same reach, all of it is a repeat
    key = ["anchor", "r1", "r2"]
    differ = shared.where("NOT alike").drop("least", "alike")
    heads = store(differ.groupBy(*key).agg(F.min(F.struct("doc", "rid", "first", "n", "hi")).alias("head")), "heads")
    lists = heads.groupBy("head.rid").agg(F.collect_list(F.struct(*key, "head.doc", "head.first", "head.n", "head.hi")).alias("reaches"))
    listed = texts.join(lists.hint("merge"), "rid").select("text", "reaches")
    found = extensions(store(listed.mapInArrow(_place_rows(window), PLACE), "places"), window)
    placed = store(differ.join(heads.select(*key, F.col("head.doc").alias("head")), key).select(*key, "rid", "first", "n", F.col("hi").alias("top"), (F.col("doc") > F.col("head")).alias("copy")), "placed")
    discard(heads)

    code = lambda first, n: (first.cast("long") * 64 + n).alias("span")
    whole = code(F.col("first"), F.col("n"))
    spans = shared.where("alike").select("rid", whole).unionByName(placed.where("copy").select("rid", whole))
    for part in found:
        inside = placed.where("NOT copy").join(part.where("found").select(*key, "lo", "hi"), key)
        spans = spans.unionByName(inside.select("rid", code(F.col("first") + F.col("top") - F.col("hi"), F.col("hi") - F.col("lo") + 1)))
    spans = store(spans.groupBy("rid").agg(F.collect_list("span").alias("spans")), "spans")
    discard(shared, placed, *found)
    return spans


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(row, n_words, n_removed, kept, repeats): the input row as a struct, and what is left of its text.

    ``repeats`` holds the maximal repeats as word ranges, ends exclusive.
    """
    if not gram <= window < gram + 63:
        raise ValueError("a window needs 1 to 63 grams")
    rows = numbered(docs)
    texts = rows.select("rid", F.col("row")[id_col].cast("long").alias("doc"), F.col("row")[text_col].alias("text")).where("doc IS NOT NULL")
    spans = repeated_spans(texts, window, gram)
    found = rows.join(spans.hint("merge"), "rid", "left").select("row", "spans")
    made = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("repeats", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    fields = [found.schema["row"], *T._parse_datatype_string("n_words long, n_removed long, kept string, repeats array<struct<start: int, end: int>>").fields]
    return found.mapInArrow(_cut_rows(text_col, window, made), T.StructType(fields))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passage dedup leaves of every document."""
    out = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), starts AS (
  SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS p FROM w
), windows AS (
  SELECT doc_id, p, md5(array_to_string(ws[p:p + {WINDOW - 1}], ' ')) AS k FROM starts
), least AS (
  SELECT k, min(doc_id) AS m FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + {WINDOW - 1})) AS i FROM windows JOIN least USING (k) WHERE doc_id > m
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, (SELECT count(*) FROM gone g WHERE g.doc_id = w.doc_id) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
