"""SimHash near-dedup by deletion-variant signatures.

A text's fingerprint has 64 bits: bit b is 1 if over half of its shingle hashes have
it. Fingerprints that differ in at most three bits are linked. Of two halves of 32
bits, one then differs in at most one bit, so both fingerprints share a variant: that
half with one bit blanked. Each distinct fingerprint is indexed under its 64 variants,
equal variants meet by one sort within partitions, and the pairs are verified.

A variant's group is solved where it is sorted, and only a spanning forest of its
links leaves: fewer rows than members, never all pairs. Halves that over ``GROUP`` / 2
fingerprints have are counted first. Where a variant covers such a half, the variants of
the other half's quarters are added to the key before anything is dealt out: what then
shares a key agrees in 46 bits, so it has at most 2^18 members whatever the data, and
no other key has more than ``GROUP``.

Links are joined into components by alternating star contraction over written tables.
Copies are folded into one fingerprint before any of this.

Edge cases: a null text counts as empty; texts without a word have fingerprint zero,
linked like any other; texts with fewer words than a shingle have one shingle, the
whole; rows with a null id take part and get the component of their fingerprint, but
name none (a component of null ids alone has a null id); repeated rows give repeated
rows; a very long text is hashed a stretch at a time, a few times its size in one task; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, encode, per_row, store, table

BITS = 3
SHINGLE = 3
SEED = 42
#: Members of a variant's group up to which it is solved at once.
GROUP = 2048


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text, as a signed number."""
    buf = b" ".join(encode(text).lower().split())
    if not buf:
        return 0
    cut = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
    starts, ends = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(buf)]])
    n = max(1, len(starts) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.fromiter((digest(buf[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])


def _forest(fp: np.ndarray, reach: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (root, member) that span the components of the links among distinct fingerprints."""
    m = len(fp)
    root = np.full(m, -1)
    for i in range(m):
        if root[i] >= 0:
            continue
        root[i], front = i, np.array([i])
        while len(front):
            free = np.flatnonzero(root < 0)
            near = np.zeros(len(free), bool)
            for part in np.array_split(front, max(1, len(front) * len(free) >> 22)):
                near |= (np.bitwise_count(fp[part][:, None] ^ fp[free][None, :]) <= reach).any(axis=0)
            front = free[near]
            root[front] = i
    other = np.flatnonzero(root != np.arange(m))
    return fp[root[other]], fp[other]


def _dense_forest(fp: np.ndarray, reach: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The same for up to 2^18 fingerprints that differ in 18 known bits: labels spread over a table of all codes."""
    free = [b for b in range(64) if np.bitwise_or.reduce(fp ^ fp[0]) >> np.uint64(b) & np.uint64(1)]
    code = np.zeros(len(fp), np.int64)
    for k, b in enumerate(free):
        code |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    size = 1 << len(free)
    label = np.full(size, size, np.int64)
    label[code] = code
    steps = [1 << a for a in range(len(free))]
    masks = {x for a in steps for b in steps for c in steps for x in (a, a ^ b, a ^ b ^ c)} - {0}
    while True:
        before = label[code].copy()
        for mask in masks:
            label[code] = np.minimum(label[code], label[code ^ mask])
        if (label[code] == before).all():
            break
    whole = np.zeros(size, np.uint64)
    whole[code] = fp
    other = np.flatnonzero(label[code] != code)
    return whole[label[code[other]]], fp[other]


def _links(limit: int):
    """A ``mapInArrow`` function over rows (key, key2, fp) sorted within the partition: links (a, b) that span the components of each group of equal keys."""

    def groups(keys: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All groups of whole keys in sorted arrays."""
        if not len(fp):
            return
        start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        size = np.diff(np.concatenate([start, [len(fp)]]))
        # small groups all at once: compare neighbours at every distance
        a, b = [], []
        little = start[(size > 1) & (size <= 8)], size[(size > 1) & (size <= 8)]
        for gap in range(1, 8):
            for first in range(8 - gap):
                at = little[0][little[1] > first + gap] + first
                x, y = fp[at], fp[at + gap]
                hit = np.bitwise_count(x ^ y) <= BITS
                a.append(x[hit])
                b.append(y[hit])
        for s, n in zip(start[size > 8].tolist(), size[size > 8].tolist()):
            x, y = _forest(fp[s : s + n]) if n <= limit else _dense_forest(fp[s : s + n])
            a.append(x)
            b.append(y)
        if sum(map(len, a)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = None, np.zeros(0, np.uint64)
        for got in batches:
            if not got.num_rows:
                continue
            keys = np.column_stack([got.column(0).to_numpy(), got.column(1).to_numpy()])
            fp = got.column(2).to_numpy().view(np.uint64)
            if len(held_fp):
                keys, fp = np.concatenate([np.repeat(held_key[None, :], len(held_fp), axis=0), keys]), np.concatenate([held_fp, fp])
            last = len(fp) - int((keys == keys[-1]).all(axis=1).sum())
            yield from groups(keys[:last], fp[:last])
            held_key, held_fp = keys[-1], fp[last:]
        if len(held_fp):
            yield from groups(np.repeat(held_key[None, :], len(held_fp), axis=0), held_fp)

    return run


#: The halves of a fingerprint.
LOW, HIGH = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"


def hot_variants(prints: DataFrame, group: int) -> DataFrame:
    """Written (side, half, mask): the bits of a half (0 low, 1 high) whose variants cover a half that over ``group`` / 2 fingerprints have."""
    halves = prints.select(F.explode(F.expr(f"array(struct(0 AS side, {LOW} AS half), struct(1 AS side, {HIGH} AS half))")).alias("h")).select("h.*")
    hot = store(halves.groupBy("side", "half").count().where(F.col("count") * 2 > group).select("side", "half"), "hot-halves")
    sides = hot.select("side", F.col("half").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    near = sides.select("side", F.expr("own ^ shiftleft(1L, bit)").alias("half"), F.expr("shiftleft(1L, bit)").alias("mask"))
    every = hot.select("side", "half", F.lit(2**32 - 1).cast("long").alias("mask"))
    out = store(every.unionByName(near).groupBy("side", "half").agg(F.bit_or("mask").alias("mask")), "hot-variants")
    discard(hot)
    return out


def links(prints: DataFrame, group: int = GROUP) -> DataFrame:
    """Written pairs (a, b), each in one component, that connect all linked fingerprints of ``prints`` (fp, distinct)."""
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_variants(prints, group)
    marked = prints.selectExpr("fp", f"{LOW} AS low", f"{HIGH} AS high")
    for side, name in enumerate(("low", "high")):
        of = hot.where(F.col("side") == side).select(F.col("half").alias(name), F.col("mask").alias(f"mask{side}"))
        marked = marked.join(of, name, "left")
    marked = marked.select("fp", "low", "high", F.coalesce("mask0", F.lit(0)).alias("mask0"), F.coalesce("mask1", F.lit(0)).alias("mask1"))
    v = marked.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("bit", F.col("v") % 32)
    lower = F.col("v") < 32
    v = v.select("fp", "v", "bit", F.when(lower, F.col("low")).otherwise(F.col("high")).alias("half"), F.when(lower, F.col("high")).otherwise(F.col("low")).alias("other"), F.when(lower, F.col("mask0")).otherwise(F.col("mask1")).alias("mask"))
    blank = "shiftleft(cast({0} as bigint), 32) | ({1} & ~shiftleft(1L, {2}))"
    # hot variants go on to those of the quarters of the other half
    quarters = F.when(F.expr("mask & shiftleft(1L, bit)") != 0, F.sequence(F.lit(0), F.lit(31))).otherwise(F.array(F.lit(-1)))
    keyed = v.select("fp", F.expr(blank.format("v", "half", "bit")).alias("key"), "other", F.explode(quarters).alias("q"))
    second = F.expr(blank.format("q", "(shiftright(other, 16 * cast(q div 16 as int)) & 65535L)", "q % 16"))
    keyed = keyed.select("key", F.when(F.col("q") < 0, F.lit(-1).cast("long")).otherwise(second).alias("key2"), "fp")
    keyed = keyed.repartition(parts, "key", "key2").sortWithinPartitions("key", "key2", "fp")
    out = store(keyed.mapInArrow(_links(group), "a long, b long").distinct(), "links")
    discard(hot)
    return out


def stars(edges: DataFrame) -> DataFrame:
    """Written rows (v, root): the smallest member of the component of every vertex that has an edge and isn't it.

    Alternating large-star and small-star rounds until nothing changes. A centre's least
    neighbour is aggregated and written before it is joined, so that a centre with very
    many neighbours can be split.
    """
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).distinct(), "stars")
    sums = (F.count("*"), F.bit_xor(F.xxhash64("v", "root")), F.sum(F.xxhash64("v", "root") % 1000003))
    mark, seen = now.agg(*sums).first(), None
    while mark[0] and mark != seen:
        both = now.unionByName(now.select(F.col("root").alias("v"), F.col("v").alias("root")))
        least = store(both.groupBy("v").agg(F.min("root").alias("m")).select(F.col("v").alias("c"), F.least("v", "m").alias("m")), "least")
        # large star: neighbours above a centre move to the centre's least neighbour
        large = both.where("root > v").join(least, F.col("v") == F.col("c")).select(F.col("root").alias("v"), F.col("m").alias("root")).where("v <> root")
        large = store(large.distinct(), "large-stars")
        # small star: neighbours below a centre, and the centre, move to the least
        low = store(large.groupBy("v").agg(F.min("root").alias("m")).select(F.col("v").alias("c"), "m"), "least")
        small = large.join(low, F.col("v") == F.col("c")).select(F.col("root").alias("v"), F.col("m").alias("root")).where("v <> root")
        after = store(small.unionByName(low.select(F.col("c").alias("v"), F.col("m").alias("root"))).distinct(), "stars")
        discard(now, least, large, low)
        now, seen, mark = after, mark, after.agg(*sums).first()
    return now


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, tag, fp) of every row; ``tag`` is a hash of the text, to find the row again."""
    schema = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("fp", pa.int64())])
    work = lambda rows: {"id": rows["id"], "tag": rows["tag"], "fp": [fingerprint(t, shingle) for t in rows["text"]]}
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    return rows.mapInArrow(per_row(["id", "tag", "text"], work, schema), "id long, tag long, fp long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(id, tag, fp, component, root) of every row: its fingerprint, the smallest id that links reach, and the least fingerprint there."""
    marked = store(fingerprints(docs, id_col, text_col), "fingerprints")
    prints = store(marked.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    edges = links(prints.select("fp"), group)
    root = stars(edges)
    discard(edges)
    placed = prints.join(root, F.col("fp") == F.col("v"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("least").alias("component"))
    known = placed.join(heads, "root").select(F.col("fp").alias("_fp"), "component", "root")
    return marked.join(known, F.col("fp") == F.col("_fp")).select("id", "tag", "fp", "component", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, one for each component: the smallest id, of its texts that with the least hash, once."""
    least = -(2**63)
    found = components(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("component")))
    heads = store(found.groupBy("root").agg(F.min("component").alias("id"), F.min("tag").alias("tag")).select(F.coalesce("id", F.lit(least)).alias("key"), "tag").distinct(), "heads")
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", F.coalesce(F.col("row")[id_col].cast("long"), F.lit(least)).alias("key"), F.xxhash64(F.col("row")[text_col]).alias("tag"))
    again = F.row_number().over(Window.partitionBy("key", "tag").orderBy("key"))
    return rows.join(heads, ["key", "tag"]).withColumn("again", again).where("again = 1").select("row.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
