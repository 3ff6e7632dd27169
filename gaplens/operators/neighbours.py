"""k nearest neighbours over rows with gaps.

Donors are dealt into cells: first by which numbers they have, then by cuts at medians of the
widest column. The cuts rest on a bounded sample of the donors; every donor goes to its cell, and a
cell's box is that of all its donors. The k nearest of the sample bound how far a row's neighbours can
be, so a row is sent to each cell whose box reaches as near, and no other. In a cell a second tree finds
the k nearest donors, and the best of all cells are averaged. This is exact: what the bounds exclude
cannot be among the k nearest. Where they exclude little (many columns without structure) the work is
rows to fill times donors.

Of donors alike in all numbers only the k with the smallest values are kept, as no others can count. Large
cells and many rows for one cell are dealt into pieces. Donors whose pattern of gaps the sample lacks,
or that have none of its ``PATTERNS`` most frequent ones, share a cell.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import missing, normalise, number, numeric_columns, q

#: Donors in a cell, about; rows of the sample in a cell, and donors in a leaf of its tree.
BLOCK, LEAF = 4096, 64
#: Rows and numbers in the sample, at most. Patterns of gaps with cells of their own.
SAMPLE, NUMBERS, PATTERNS = 1 << 17, 1 << 20, 256
#: Pairs of rows that a task holds at a time, about.
PAIRS = 1 << 20
# workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Tree:
    """Rows in nested boxes. A node without a cut is a leaf; at a cut, larger numbers and gaps go right."""

    def __init__(self, width: int):
        self.width = width
        self.axis, self.cut, self.left, self.right, self.rows, self.roots = [], [], [], [], [], []

    def plant(self, x: np.ndarray, rows: np.ndarray, leaf: int | None) -> int:
        """A new root over rows of ``x``, cut down to ``leaf`` rows (None: not cut)."""
        root, todo = len(self.axis), [(rows, None, 0)]
        self.roots.append(root)
        while todo:
            rows, side, up = todo.pop()
            at = len(self.axis)
            if side is not None:
                side[up] = at
            for of, v in ((self.axis, 0), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.rows, rows)):
                of.append(v)
            if leaf is None or len(rows) <= leaf:
                continue
            part = x[rows]
            with np.errstate(invalid="ignore", over="ignore"):
                wide = np.nan_to_num(np.fmax.reduce(part) - np.fmin.reduce(part))
            j = int(np.argmax(wide))
            if wide[j] > 0:
                v = np.sort(part[~np.isnan(part[:, j]), j])
                cut = v[len(v) // 2]
                cut = cut if cut > v[0] else v[np.searchsorted(v, v[0], "right")]
                less = part[:, j] < cut
                self.axis[at], self.cut[at], self.rows[at] = j, cut, None
                todo += [(rows[less], self.left, at), (rows[~less], self.right, at)]
        return root

    def close(self, boxes) -> _Tree:
        """Set the boxes: of each leaf its lowest and highest numbers, how many rows have each, and how many there are."""
        size = len(self.axis)
        low, high, have, n = np.full((size, self.width), np.nan), np.full((size, self.width), np.nan), np.zeros((size, self.width), int), np.zeros(size, int)
        for at, *box in boxes:
            low[at], high[at], have[at], n[at] = box
        for at in reversed(range(size)):
            if (a := self.left[at]) >= 0:
                b = self.right[at]
                low[at], high[at], have[at], n[at] = np.fmin(low[a], low[b]), np.fmax(high[a], high[b]), have[a] + have[b], n[a] + n[b]
        self.low, self.high, self.n, self.always, self.ever = low, high, n, have == n[:, None], have > 0
        self.axis, self.cut, self.left, self.right = map(np.array, (self.axis, self.cut, self.left, self.right))
        return self

    def bound(self, node: int, a: np.ndarray) -> np.ndarray:
        """No row of the node is nearer (squared); infinite where none shares a number. Less a margin for rounding."""
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            d = np.where(self.always[node], np.fmax(np.fmax(self.low[node] - a, a - self.high[node]), 0), 0)
            shared = (~np.isnan(a) & self.ever[node]).sum(1)
            return np.where(shared > 0, np.square(np.nan_to_num(d, posinf=np.inf)).sum(1) * self.width / shared * (1 - 1e-12), np.inf)

    def home(self, a: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaf below the root ``at`` where each row belongs."""
        at = at.copy()
        while len(rows := np.flatnonzero(self.left[at] >= 0)):
            node = at[rows]
            at[rows] = np.where(a[rows, self.axis[node]] < self.cut[node], self.left[node], self.right[node])
        return at

    def visit(self, a: np.ndarray, limit: np.ndarray, act) -> None:
        """``act`` on each leaf and the rows that it may hold neighbours of, within ``limit``, which may sink meanwhile."""
        todo = [(root, np.arange(len(a))) for root in self.roots]
        while todo:
            node, who = todo.pop()
            far = self.bound(node, a[who])
            who = who[(far <= limit[who]) & np.isfinite(far)]
            if len(who):
                if self.left[node] < 0:
                    act(node, who)
                else:
                    todo += [(self.right[node], who), (self.left[node], who)]


def _matrix(t: pa.Table, width: int) -> np.ndarray:
    return np.column_stack([t.column(f"x{j}").to_numpy().astype(float) for j in range(width)])


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances over the numbers both rows have, scaled up to all."""
    ok_a, ok_b = ~np.isnan(a), ~np.isnan(b)
    square = np.zeros((len(a), len(b)))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for j in np.flatnonzero(ok_a.any(0) & ok_b.any(0)):
            d = np.square(a[:, j, None] - b[None, :, j])
            square += d if ok_a[:, j].all() and ok_b[:, j].all() else np.where(ok_a[:, j, None] & ok_b[None, :, j], d, 0)
        shared = ok_a.astype(float) @ ok_b.T.astype(float)
        far = square * a.shape[1] / shared
    far[np.isnan(far) | (shared == 0)] = np.inf
    return far


def _groups(at: np.ndarray):
    """Each value and where it is."""
    order = np.argsort(at, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        if len(rows):
            yield int(at[rows[0]]), rows


def _slices(batches, rows: int):
    for batch in batches:
        for at in range(0, batch.num_rows, max(1, rows)):
            yield pa.Table.from_batches([batch.slice(at, max(1, rows))])


def _box(x: np.ndarray) -> tuple:
    return np.fmin.reduce(x), np.fmax.reduce(x), (~np.isnan(x)).sum(0), len(x)


class _Cells:
    """The cells, as the sample cuts them; a cell is named by its leaf."""

    def __init__(self, sample: np.ndarray, leaf: int, k: int):
        self.sample, self.k, self.width = sample, k, sample.shape[1]
        self.tree, self.root = _Tree(self.width), {}
        names = self._patterns(sample)
        kinds = sorted(((rows, name) for name in set(names) if len(rows := np.flatnonzero(names == name))), key=lambda x: (-len(x[0]), x[1]))
        for rows, name in kinds[:PATTERNS]:
            self.root[name] = self.tree.plant(sample, rows, leaf)
        rest = [rows for rows, _ in kinds[PATTERNS:]]
        self.other = self.tree.plant(sample, np.concatenate([np.empty(0, int), *rest])[:LEAF], None)  # these give bounds only
        self.tree.close([])
        self.step = PAIRS // (self.tree.left < 0).sum()

    @staticmethod
    def _patterns(x: np.ndarray) -> np.ndarray:
        packed = np.packbits(~np.isnan(x), axis=1)
        kinds, which = np.unique(packed, axis=0, return_inverse=True)
        names = np.empty(len(kinds), object)
        names[:] = [row.tobytes() for row in kinds]
        return names[which.ravel()]

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.tree.home(x, np.array([self.root.get(name, self.other) for name in self._patterns(x)], int))

    def reached(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds on the k-th neighbours of rows; pairs of a row and a cell that may hold one."""
        near = np.full((len(a), self.k), np.inf)
        for root in self.tree.roots:
            for node, who in _groups(self.tree.home(a, np.full(len(a), root))):
                near[who] = np.sort(np.concatenate([near[who], _far(a[who], self.sample[self.tree.rows[node]])], axis=1), axis=1)[:, : self.k]
        rows, cells = [np.empty(0, int)], [np.empty(0, int)]
        self.tree.visit(a, near[:, -1], lambda node, who: (rows.append(who), cells.append(np.full(len(who), node))))
        return near[:, -1], np.concatenate(rows), np.concatenate(cells)

    def measure(self, batches):
        """The boxes of a batch's rows, a row for each cell and column."""
        for t in _slices(batches, PAIRS):
            x, out = _matrix(t, self.width), []
            for cell, rows in _groups(self.of(x)):
                low, high, have, n = _box(x[rows])
                out.append((np.full(self.width, cell), np.arange(self.width), low, high, have, np.full(self.width, n)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), from_pandas=True) for v in zip(*out)], names=["cell", "j", "low", "high", "have", "n"])

    def count(self, batches):
        for t in _slices(batches, self.step):
            cells, n = np.unique(self.reached(_matrix(t, self.width))[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    def deal(self, parts: np.ndarray, chunks: np.ndarray) -> None:
        """A cell's donors go to so many parts, its rows to so many chunks; each part meets each chunk under a key."""
        self.parts, self.chunks = parts, chunks
        self.first = np.cumsum(parts * chunks) - parts * chunks

    def _copies(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which row, and which of its copies."""
        rows = np.repeat(np.arange(len(n)), n)
        return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)

    def settle(self, batches):
        for t in _slices(batches, PAIRS // self.chunks.max()):
            cell = self.of(_matrix(t, self.width))
            part = t.column("id").to_numpy() % self.parts[cell]
            rows, copy = self._copies(self.chunks[cell])
            key = self.first[cell[rows]] + part[rows] * self.chunks[cell[rows]] + copy
            yield from t.take(pa.array(rows)).add_column(0, "key", pa.array(key)).combine_chunks().to_batches()

    def send(self, batches):
        for t in _slices(batches, self.step // self.parts.max()):
            limit, who, cell = self.reached(_matrix(t, self.width))
            pairs, copy = self._copies(self.parts[cell])
            who, cell = who[pairs], cell[pairs]
            key = self.first[cell] + copy * self.chunks[cell] + t.column("id").to_numpy()[who] % self.chunks[cell]
            yield from t.take(pa.array(who)).add_column(0, "key", pa.array(key)).add_column(1, "far", pa.array(limit[who])).combine_chunks().to_batches()


def _nearest(k: int, width: int):
    def run(rows: pa.Table, donors: pa.Table) -> pa.Table:
        ids, fars, values = [np.empty(0, int)], [np.empty(0)], [np.empty(0)]
        if rows.num_rows and donors.num_rows:
            a, b, y, rid = _matrix(rows, width), _matrix(donors, width), donors.column("y").to_numpy(), rows.column("id").to_numpy()
            tree = _Tree(width)
            tree.plant(b, np.arange(len(b)), LEAF)
            tree.close([(at, *_box(b[own])) for at, own in enumerate(tree.rows) if own is not None])
            for at in range(0, len(a), 1024):
                x, limit = a[at : at + 1024], rows.column("far").to_numpy()[at : at + 1024].copy()
                far, value = np.full((len(x), k), np.inf), np.full((len(x), k), np.inf)

                def take(node, who, x=x, limit=limit, far=far, value=value):
                    own = tree.rows[node]
                    for who in np.array_split(who, 1 + len(who) * len(own) // PAIRS):
                        d = _far(x[who], b[own])
                        close = d.min(1) <= limit[who]
                        who, d = who[close], d[close]
                        f, v = np.concatenate([far[who], d], axis=1), np.concatenate([value[who], np.broadcast_to(y[own], d.shape)], axis=1)
                        best = np.lexsort((v, f), axis=1)[:, :k]
                        far[who], value[who] = np.take_along_axis(f, best, 1), np.take_along_axis(v, best, 1)
                        limit[who] = np.minimum(limit[who], far[who, -1])

                home = tree.home(x, np.zeros(len(x), int))
                for node, who in _groups(home):
                    take(node, who)
                tree.visit(x, limit, lambda node, who, home=home, take=take: take(node, who[home[who] != node]))
                found = np.isfinite(far)
                ids.append(np.repeat(rid[at : at + 1024], found.sum(1)))
                fars.append(far[found])
                values.append(value[found])
        return pa.table({"id": pa.array(np.concatenate(ids), pa.int64()), "far": np.concatenate(fars), "value": np.concatenate(values)})

    return run


def knn_fill(df: DataFrame, donors: DataFrame, columns: list[str], k: int = 5, block: int = BLOCK) -> DataFrame:
    """``columns`` filled with the mean of the k nearest donors that have a value, by distance over the numbers both rows have.

    Of equally near donors those with the smaller value count first. Where no donor shares
    a number, the mean of the column is used. ``block``: donors in a cell, about.
    """
    df, donors = normalise(df), normalise(donors)
    names = numeric_columns(donors)
    for c in columns:
        df = _fill_one(df, donors, c, names, k, block)
    return df


def _fill_one(df: DataFrame, donors: DataFrame, c: str, names: list[str], k: int, block: int) -> DataFrame:
    number_of = lambda d, n: number(n) if n in d.columns else F.lit(None).cast("double")
    vector = lambda d: [number_of(d, n).alias(f"x{j}") for j, n in enumerate(names)]
    # a hash passes over nulls, so it takes where they are as well
    same = lambda d: F.xxhash64(*(number_of(d, n) for n in names), *(number_of(d, n).isNull() for n in names))
    all_columns, width = df.columns, len(names)
    xs = [f"x{j}" for j in range(width)]
    given = donors.where(~missing(donors, c)).select(same(donors).alias("id"), *vector(donors), number(c).alias("y"))
    mean, n = given.agg(F.avg("y"), F.approx_count_distinct("id")).first()

    leaf = max(1, min(LEAF, block))
    every = max(1, block // leaf, -(-n // min(SAMPLE, max(leaf, NUMBERS // width))))
    sample = given.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(every)) == 0).select(*xs).distinct().toArrow()
    cells = _Cells(_matrix(sample, width), leaf, k)

    # equal vectors have equal neighbours, and of equal donors no more than k count
    gaps = df.where(missing(df, c)).select(same(df).alias("id"), *vector(df)).dropDuplicates(["id"])
    pool = given.withColumn("n", F.row_number().over(Window.partitionBy(*xs).orderBy("y"))).where(F.col("n") <= k).select(F.xxhash64("id", "y").alias("id"), *xs, "y")
    boxes: dict = {}
    for r in pool.mapInArrow(cells.measure, "cell long, j long, low double, high double, have long, n long").groupBy("cell", "j").agg(F.min("low"), F.max("high"), F.sum("have"), F.sum("n")).collect():
        box = boxes.setdefault(r[0], [np.full(width, np.nan), np.full(width, np.nan), np.zeros(width, int), r[5]])
        box[0][r[1]], box[1][r[1]], box[2][r[1]] = np.nan if r[2] is None else r[2], np.nan if r[3] is None else r[3], r[4]
    cells.tree.close([(at, *box) for at, box in boxes.items()])
    asked = np.zeros(len(cells.tree.n), int)
    for at, m in gaps.mapInArrow(cells.count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        asked[at] = m
    most = max(4 * block, min(4 * leaf * every, (1 << 22) // width))
    held = np.where(cells.tree.left < 0, cells.tree.n, 0)
    cells.deal(np.maximum(1, -(-held // most)), np.maximum(1, -(-asked // (4 * block))))

    numbers = ", ".join(f"{x} double" for x in xs)
    left, right = gaps.mapInArrow(cells.send, f"key long, far double, id long, {numbers}"), pool.mapInArrow(cells.settle, f"key long, id long, {numbers}, y double")
    near = left.groupBy("key").cogroup(right.groupBy("key")).applyInArrow(_nearest(k, width), "id long, far double, value double")
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("far", "value"))).where(F.col("n") <= k).groupBy("id").agg(F.avg("value").alias("value"))
    # all rows have a key, so that those without a gap are dealt evenly too
    rows = df.select(F.struct(*(F.col(q(n)) for n in all_columns)).alias("row"), missing(df, c).alias("gap"), same(df).alias("key")).join(best, F.col("gap") & (F.col("key") == F.col("id")), "left")
    full = F.coalesce(F.col("row").getField(c).cast("double"), F.col("value"), F.lit(0.0 if mean is None else float(mean)))
    return rows.select(*(full.alias(n) if n == c else F.col("row").getField(n).alias(n) for n in all_columns))
