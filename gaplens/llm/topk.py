"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors are assigned to the nearest of a few pivots. Each cell's summary is its pivot
p, the radius r around it, and the cylinder along p that holds the cell: the range of
the components along p and the greatest distance b from that line. For a vector x of
the cell, q.x is at most q.p + |q| r, and at most what the cylinder allows.

A query gets a floor, its k-th score among the vectors of its own block and of the
pivots' sample. It is first solved in the ``NEAR`` cells of the greatest bounds, which
raises the floor; then it is sent to those of the other cells whose bound reaches the
floor. Cells are cut into blocks of about ``BLOCK`` vectors, and the queries of a cell
into chunks of about ``CHUNK``; a block is copied to the chunks of its own cell, so a
cell that no query needs is not moved, and a cell that holds most vectors is many
small tasks. Pivots are fitted on the ``SAMPLE`` rows with the least hashed row
numbers; any pivots give exact results. Components become floor(64 x) first.

Edge cases: vectors that are null or hold null or non-finite components, and null ids,
take no part; rows that repeat an id are vectors of their own, each a query if the id
is one, and each a candidate for the other; vectors of different length have no score
with each other; an empty vector scores 0 with other empty ones; a very long vector
makes its block as many times larger, so ``block`` and ``chunk`` should be set for
their length; ties go to the smaller id; fewer candidates than k give fewer rows;
other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, store, table

K = 20
EVERY = 20
SCALE = 64
PIVOTS = 64
SAMPLE = 4096
BLOCK = 4096
CHUNK = 4096
NEAR = 2
LEAST = -(2**63)


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(rid, id, v): the rows that take part, numbered, with integer components."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return found.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine).select("rid", "id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; in floating point where 53 bits hold them all."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def fit_pivots(sample: list[list[int]], count: int, rounds: int = 8) -> dict[int, np.ndarray]:
    """By vector length: means of a few rounds of Lloyd's method, spread over a sample."""
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    out = {}
    for size, vs in by.items():
        x = np.unique(np.array(vs, np.float64).reshape(len(vs), size), axis=0)
        p = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)].copy()
        for _ in range(rounds):
            near = _distances(x, p).argmin(axis=1)
            for k in np.unique(near):
                p[k] = x[near == k].mean(axis=0)
        out[size] = np.unique(p, axis=0)
    return out


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] - 2 * x @ p.T + (p * p).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(square, 0))


class Cells:
    """Pivots by vector length, and the summaries of their cells."""

    def __init__(self, pivots: dict[int, np.ndarray], count: int):
        self.pivots, self.count = pivots, count
        self.sizes: dict[int, int] = {}  # vectors
        self.limits: dict[int, tuple[np.ndarray, ...]] = {}

    def of(self, size: int) -> np.ndarray:
        return self.pivots.get(size, np.zeros((1, size)))

    def lines(self, size: int) -> np.ndarray:
        """The pivots at length 1, or 0."""
        p = self.of(size)
        return p / np.maximum(np.sqrt((p * p).sum(axis=1)), 1e-12)[:, None]

    def learn(self, found: list) -> None:
        """Take in (cell, n, radius, low, high, off) of each cell; some slack makes up for rounding."""
        rows = {r["cell"]: r for r in found}
        self.sizes = {c: r["n"] for c, r in rows.items()}
        for size in {c // self.count for c in rows}:
            here = [rows.get(size * self.count + k) for k in range(len(self.of(size)))]
            pick = lambda f, none: np.array([f(r) if r else none for r in here], np.float64)  # noqa: E731,B023
            slack = lambda x: x + 1e-9 * np.abs(x) + 1e-6
            self.limits[size] = (
                slack(pick(lambda r: r["radius"], -np.inf)), -slack(pick(lambda r: -r["low"], 0.0)), slack(pick(lambda r: r["high"], 0.0)), slack(pick(lambda r: r["off"], -np.inf)),
            )

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For each row of ``x`` and each cell of its length, what no score in the cell exceeds; -inf for cells without vectors."""
        size = x.shape[1]
        if size not in self.limits:
            return np.full((len(x), len(self.of(size))), -np.inf)
        radius, low, high, off = self.limits[size]
        with np.errstate(invalid="ignore"):
            square = (x * x).sum(axis=1)
            norm, along = np.sqrt(square), x @ self.lines(size).T
            across = np.sqrt(np.maximum(square[:, None] - along * along, 0)) + 1e-6 * (1 + norm[:, None])
            ball = x @ self.of(size).T + (norm[:, None] + 1e-9) * radius
            best = np.minimum(ball, np.maximum(low * along, high * along) + across * off)
            return np.where(np.isneginf(radius), -np.inf, best + 1e-9 * (np.abs(best) + norm[:, None] + 1))


def _by_length(column: pa.Array):
    """(length, rows) of the vectors in a column."""
    sizes = np.diff(column.offsets.to_numpy())
    return [(size, np.flatnonzero(sizes == size)) for size in np.unique(sizes).tolist()]


def _assign(cells: Cells):
    """Adds to (rid, id, v) the cell, the distance to its pivot, the component along the pivot and the distance from its line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n = batch.column(2), batch.num_rows
            cell, far, along, off = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n)
            for size, at in _by_length(column):
                x = _matrix(column.take(pa.array(at))).astype(np.float64)
                d = _distances(x, cells.of(size))
                near = d.argmin(axis=1)
                cell[at], far[at] = size * cells.count + near, d[np.arange(len(at)), near]
                along[at] = (x * cells.lines(size)[near]).sum(axis=1)
                off[at] = np.sqrt(np.maximum((x * x).sum(axis=1) - along[at] ** 2, 0)) + 1e-6 * np.sqrt((x * x).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (cell, far, along, off))], names=["rid", "id", "v", "cell", "far", "along", "off"])

    return run


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one row of scores, ties to the smaller id; ``ids`` ascend."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        over, even = np.flatnonzero(score > least), np.flatnonzero(score == least)
        return np.concatenate([over, even[: k - len(over)]])
    return np.lexsort((ids, -score))[:k]


def _floors(cells: Cells, sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int, every: int, near: int):
    """Queries of one block (rid, id, v, floor, near): their k-th score among the block and the sample, and the cells of the greatest bounds."""

    def run(block: pa.Table) -> pa.Table:
        rids, ids = block.column("rid").to_numpy(), block.column("id").to_numpy()
        mine = np.flatnonzero(ids % every == 0)
        x = _matrix(block.column("v"))
        other_rids, other = sample.get(x.shape[1], (np.zeros(0, np.int64), np.zeros((0, x.shape[1]), np.int64)))
        more = ~np.isin(other_rids, rids)
        known = np.concatenate([x, other[more]])
        floor, cell = np.full(len(mine), LEAST, np.int64), np.zeros((len(mine), min(near, len(cells.of(x.shape[1])))), np.int64)
        for at in range(0, len(mine), 512):
            part = mine[at : at + 512]
            if len(known) > k:
                score = products(x[part], known)
                score[np.arange(len(part)), part] = LEAST
                floor[at : at + 512] = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            order = np.argsort(-cells.bounds(x[part].astype(np.float64)), axis=1, kind="stable")
            cell[at : at + 512] = x.shape[1] * cells.count + order[:, : cell.shape[1]]
        chosen = pa.array(cell.tolist(), pa.list_(pa.int64()))
        return pa.table({"rid": rids[mine], "id": ids[mine], "v": block.column("v").take(pa.array(mine)), "floor": floor, "near": chosen})

    return run


def _needed(cells: Cells, first: bool):
    """(rows, cells) of a batch of queries to solve together: in the first round the near cells, then the others whose bound reaches the floor."""

    def pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        rows, out, floor = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], batch.column(3).to_numpy()
        for size, at in _by_length(batch.column(2)):
            chosen = _matrix(batch.column(4).take(pa.array(at)))
            if first:
                hit = np.zeros((len(at), len(cells.of(size))), bool)
                np.put_along_axis(hit, chosen - size * cells.count, True, axis=1)
            else:
                hit = cells.bounds(_matrix(batch.column(2).take(pa.array(at))).astype(np.float64)) >= floor[at][:, None]
                np.put_along_axis(hit, chosen - size * cells.count, False, axis=1)
            r, c = np.nonzero(hit)
            rows.append(at[r])
            out.append(size * cells.count + c)
        row, cell = np.concatenate(rows), np.concatenate(out)
        there = np.isin(cell, list(cells.sizes))
        return row[there], cell[there]

    return pairs


def _counts(pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, n = np.unique(pairs(batch)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "n"])

    return run


def _route(pairs, shape: dict[int, tuple[int, int]]):
    """Sends each query to one chunk of every block of the cells it needs; ``shape`` has a cell's numbers of blocks and chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell = pairs(batch)
            rid = batch.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
            for c in np.unique(cell).tolist():
                if c not in shape:
                    continue
                blocks, chunks = shape[c]
                need = np.repeat(row[cell == c], blocks)
                for at in range(0, len(need), 4096):
                    part = need[at : at + 4096]
                    block = (np.arange(at, at + len(part)) % blocks).astype(np.int32)
                    chunk = (rid[part] % np.uint64(chunks)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(part)).columns[:4], pa.array(np.full(len(part), c)), pa.array(block), pa.array(chunk)], names=["rid", "id", "v", "floor", "cell", "block", "chunk"])

    return run


ANSWER = "rid long, query_id long, vec_id long, score long"


def _solve(k: int):
    """The best of one block for one chunk of queries, down to their floors."""

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, np.int64)] for _ in range(4)]
        if queries.num_rows and block.num_rows:
            block = block.sort_by("id")
            rids, ids = block.column("rid").to_numpy(), block.column("id").to_numpy()
            q_rids, qs, floor = (queries.column(c).to_numpy() for c in ("rid", "id", "floor"))
            x, q = _matrix(block.column("v")), _matrix(queries.column("v"))
            for at in range(0, len(qs), 512):
                score = products(q[at : at + 512], x)
                for n, line in enumerate(score, at):
                    here = np.flatnonzero((line >= floor[n]) & (rids != q_rids[n]))
                    best = here[_best(line[here], ids[here], k)]
                    for column, made in zip(out, (np.full(len(best), q_rids[n]), np.full(len(best), qs[n]), ids[best], line[best])):
                        column.append(made)
        return pa.table({name: np.concatenate(c) for name, c in zip(("rid", "query_id", "vec_id", "score"), out)})

    return run


def _order():
    return Window.partitionBy("rid").orderBy(F.col("score").desc(), "vec_id")


def _round(queries: DataFrame, dealt: DataFrame, cells: Cells, blocks: dict[int, int], k: int, chunk: int, first: bool, pairs_seen: list[int]) -> DataFrame:
    """The answers of the cells that a round needs."""
    pairs = _needed(cells, first)
    # one row for each cell
    wanted = {r["cell"]: r["n"] for r in queries.mapInArrow(_counts(pairs), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    pairs_seen.append(sum(n * cells.sizes[c] for c, n in wanted.items()))
    shape = {c: (blocks[c], -(-n // chunk)) for c, n in wanted.items()}
    sent = queries.mapInArrow(_route(pairs, shape), "rid long, id long, v array<long>, floor long, cell long, block int, chunk int")
    used = queries.sparkSession.createDataFrame([(c, n) for c, (_, n) in shape.items()], "cell long, chunks int")
    copies = dealt.join(F.broadcast(used), "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    keys = ["cell", "block", "chunk"]
    return sent.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(_solve(k), ANSWER)


def search(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, pivots: int = PIVOTS, block: int = BLOCK, chunk: int = CHUNK, near: int = NEAR) -> tuple[DataFrame, float]:
    """(query_id, rank, vec_id, score) as ``top_k`` has it, and the share of pairs of a query and a vector that bounds excluded."""
    spark = rows.sparkSession
    whole = store(whole_vectors(rows, id_col, vector_col), "vectors")
    sample: dict[int, list] = {}
    for r in whole.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).collect():
        sample.setdefault(len(r["v"]), []).append((r["rid"], r["v"]))
    known = {size: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.int64).reshape(len(x), size)) for size, x in sample.items()}
    cells = Cells(fit_pivots([v for x in sample.values() for _, v in x], pivots), pivots)
    placed = store(whole.mapInArrow(_assign(cells), "rid long, id long, v array<long>, cell long, far double, along double, off double"), "cells")
    discard(whole)
    # one row for each pivot and vector length
    cells.learn(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("off").alias("off")).collect())
    blocks = {c: -(-n // block) for c, n in cells.sizes.items()}
    sizes = spark.createDataFrame(list(blocks.items()), "cell long, blocks int")
    dealt = placed.join(F.broadcast(sizes), "cell").select("rid", "id", "v", "cell", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("block"))
    floors = dealt.groupBy("cell", "block").applyInArrow(_floors(cells, known, k, every, near), "rid long, id long, v array<long>, floor long, near array<long>")
    queries, seen = store(floors, "queries"), []
    answers = store(_round(queries, dealt, cells, blocks, k, chunk, True, seen), "answers")
    kth = answers.withColumn("rank", F.row_number().over(_order())).where(F.col("rank") == k).select("rid", F.col("score").alias("kth"))
    raised = store(queries.join(kth, "rid", "left").select("rid", "id", "v", F.greatest("floor", "kth").alias("floor"), "near"), "queries")
    rest = _round(raised, dealt, cells, blocks, k, chunk, False, seen)
    ranked = answers.unionByName(rest).withColumn("rank", F.row_number().over(_order())).where(F.col("rank") <= k)
    lengths: dict[int, int] = {}
    for c, n in cells.sizes.items():
        lengths[c // pivots] = lengths.get(c // pivots, 0) + n
    pairs = sum(lengths.get(r["s"], 0) * r["n"] for r in queries.groupBy(F.size("v").alias("s")).agg(F.count("*").alias("n")).collect())
    discard(queries)
    return ranked.select("query_id", "rank", "vec_id", "score"), 1 - sum(seen) / pairs if pairs else 0.0


def top_k(rows: DataFrame, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row whose id ``every`` divides."""
    return search(rows, **options)[0]


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = f"""
WITH whole AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % {EVERY} = 0 AND c.n <> q.n
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
