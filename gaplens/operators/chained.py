"""Multiple imputation by chained equations.

Every regression needs only sums and cross-products, so a round over one column is one
aggregation; the p x p algebra runs on the driver. A fitted chain is a list of linear
models: applying it is a projection, with posterior noise drawn from a hash of the row's
key, so draws do not depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import bayesian_ridge, pool_rubin
from .columns import missing, normalise, number, numeric_columns, q


#: Rounds after which the lineage is cut, where a folder for checkpoints is set.
CUT = 4


@dataclass
class Link:
    """One regression of the chain: column ~ intercept + coefficients of the others."""

    column: str
    others: list[str]
    coef: np.ndarray
    intercept: float
    alpha: float
    cov: np.ndarray
    means: np.ndarray


@dataclass
class Chain:
    columns: list[str]
    start: dict[str, float]
    links: list[Link] = field(default_factory=list)


def _normal(seed: Column, key: Column, step: Column) -> Column:
    """A standard normal number from a hash of the key, by Box and Muller."""
    unit = lambda k: (F.shiftrightunsigned(F.xxhash64(key, seed, step, F.lit(k)), 11).cast("double") + 0.5) / float(2**53)
    return F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * np.pi * unit(2))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def _numbers(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values)).cast("array<double>")


class ChainedImputer:
    """``fit`` learns m chains from training data; ``fill`` and ``draws`` apply them.

    ``key`` names the columns that identify a row for the noise; without it all columns
    do, so equal rows get equal draws. A row's numbers are one array, and links are
    applied to it by a fold, so plans grow with the links and not with their powers.
    """

    def __init__(self, m: int = 5, max_iter: int = 10, seed: int = 0, sample_posterior: bool = True, tol: float = 1e-3, key: list[str] | None = None):
        self.m, self.max_iter, self.seed, self.sample, self.tol, self.key = m, max_iter, seed, sample_posterior, tol, key
        self.chains: list[Chain] = []

    def fit(self, train: DataFrame, columns: list[str] | None = None) -> ChainedImputer:
        df = normalise(train)
        columns = columns or numeric_columns(df)
        seen = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(~missing(df, c)).alias(f"c{k}") for k, c in enumerate(columns)), *(F.avg(number(c)).alias(f"a{k}") for k, c in enumerate(columns))).first()
        # a column without a value has nothing to learn from or to teach
        kept = [(c, k) for k, c in enumerate(columns) if seen[f"c{k}"]]
        start = {c: float(seen[f"a{k}"]) for c, k in kept}
        order = [c for *_, c in sorted((seen["n"] - seen[f"c{k}"], k, c) for c, k in kept if seen[f"c{k}"] < seen["n"])]
        base = self._state(df, [c for c, _ in kept], start).select("s", "gone", "key").persist()
        self.chains = [self._chain(base, [c for c, _ in kept], start, order, i) for i in range(self.m)]
        base.unpersist()
        return self

    def _state(self, df: DataFrame, columns: list[str], start: dict[str, float]) -> DataFrame:
        """(row, s, gone, key): the numbers with means for gaps, which of them are gaps, and the hash of the row."""
        have = {c: F.col(q(c)).cast("double") if c in df.columns else F.lit(None).cast("double") for c in columns}
        key = F.xxhash64(*(F.col(q(c)) for c in (self.key or df.columns)))
        filled = F.array(*(F.coalesce(v, F.lit(start[c])) for c, v in have.items())).cast("array<double>")
        return df.select(F.struct(*(F.col(q(c)) for c in df.columns)).alias("row"), filled.alias("s"), F.array(*(v.isNull() for v in have.values())).cast("array<boolean>").alias("gone"), key.alias("key"))

    def _chain(self, base: DataFrame, columns: list[str], start: dict[str, float], order: list[str], i: int) -> Chain:
        chain = Chain(columns, start)
        scale = max((abs(v) for v in start.values()), default=1.0) or 1.0
        frame, before, old = base, None, {}
        for turn in range(1, self.max_iter + 1):
            change, first = 0.0, len(chain.links)
            for c in order:
                link = self._regress(frame, chain, first, c, i)
                chain.links.append(link)
                coef = np.append(link.coef, link.intercept)
                change = max(change, float(np.abs(coef - old.get(c, np.zeros_like(coef))).max()))
                old[c] = coef
            if before is not None:
                before.unpersist()
            before = frame if frame is not base else None
            frame = frame.withColumn("s", self._applied(chain, first, i))
            if turn % CUT == 0 and frame.sparkSession.sparkContext.getCheckpointDir():
                frame = frame.checkpoint()  # a lost executor then costs a few rounds, not all
            frame = frame.persist()
            if not self.sample and change < self.tol * scale:
                break
        for done in (before, frame):
            if done is not None and done is not base:
                done.unpersist()
        return chain

    def _regress(self, frame: DataFrame, chain: Chain, first: int, c: str, i: int) -> Link:
        columns = chain.columns
        others = [o for o in columns if o != c]
        names = [*others, c]
        rows = frame.where(~F.col("gone")[columns.index(c)]).select(self._applied(chain, first, i).alias("s"))
        rows = rows.select(*(F.col("s")[columns.index(o)].alias(f"v{k}") for k, o in enumerate(names)))
        p = len(names)
        pairs = [(a, b) for a in range(p) for b in range(a, p)]
        # covar_pop centres as it goes, which keeps large values from cancelling
        got = rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"v{k}").alias(f"a{k}") for k in range(p)), *(F.covar_pop(f"v{a}", f"v{b}").alias(f"c{a}_{b}") for a, b in pairs)).first()
        n = got["n"]
        full = np.zeros((p, p))
        for a, b in pairs:
            full[a, b] = full[b, a] = (got[f"c{a}_{b}"] or 0.0) * n
        mean = np.array([got[f"a{k}"] for k in range(p)], float)
        if not others:
            spread = full[-1, -1] / max(n - 1, 1)
            return Link(c, [], np.zeros(0), float(mean[-1]), 1 / (spread + 1e-12), np.zeros((0, 0)), np.zeros(0))
        coef, intercept, alpha, cov = bayesian_ridge(full[:-1, :-1], full[:-1, -1], full[-1, -1], n, mean[:-1], mean[-1])
        return Link(c, others, coef, intercept, alpha, cov, mean[:-1])

    def _applied(self, chain: Chain, first: int, i: int) -> Column:
        """The numbers ``s`` after the links from ``first`` on."""
        if first == len(chain.links):
            return F.col("s")
        p = len(chain.columns)
        made = []
        for step in range(first, len(chain.links)):
            link = chain.links[step]
            at = [chain.columns.index(o) for o in link.others]
            coef, mean, cov = np.zeros(p), np.zeros(p), np.zeros((p, p))
            coef[at], mean[at] = link.coef, link.means
            cov[np.ix_(at, at)] = link.cov
            made.append(F.struct(
                F.lit(chain.columns.index(link.column)).alias("at"), F.lit(step + 1).alias("step"), F.lit(float(link.intercept)).alias("base"), _numbers(coef).alias("coef"),
                F.lit(float(1 / link.alpha)).alias("noise"), _numbers(mean).alias("mean"), (F.array(*map(_numbers, cov)) if self.sample else F.array(_numbers([]))).alias("cov"),
            ))

        def moved(s: Column, link: Column) -> Column:
            guess = link["base"] + _dot(s, link["coef"])
            if self.sample:
                centred = F.zip_with(s, link["mean"], lambda x, m: x - m)
                spread = link["noise"] + _dot(centred, F.transform(link["cov"], lambda row: _dot(row, centred)))
                guess = guess + F.sqrt(F.greatest(spread, F.lit(0.0))) * _normal(F.lit(self.seed + i), F.col("key"), link["step"])
            return F.transform(s, lambda x, k: F.when((k == link["at"]) & F.get("gone", k), guess).otherwise(x))

        return F.aggregate(F.array(*made), F.col("s"), moved)

    def fill(self, df: DataFrame, columns: list[str] | None = None, i: int = 0) -> DataFrame:
        """``df`` with the missing values of ``columns`` (all modelled ones) from chain ``i``; other columns are untouched."""
        chain = self.chains[i]
        df = normalise(df)
        want = [c for c in (columns or chain.columns) if c in chain.columns and c in df.columns]
        work = self._state(df, chain.columns, chain.start).select("row", self._applied(chain, 0, i).alias("s"))
        return work.select(*((F.col("s")[chain.columns.index(c)] if c in want else F.col("row").getField(c)).alias(c) for c in df.columns))

    def draws(self, df: DataFrame, columns: list[str] | None = None, target: str | None = None) -> DataFrame:
        """All m completed tables, one under the other, with ``imputation_id`` from 0; the target stays as it is."""
        want = [c for c in (columns or self.chains[0].columns) if c != target]
        out = None
        for i in range(self.m):
            part = self.fill(df, want, i).withColumn("imputation_id", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out


def pool_means(df: DataFrame, columns: list[str] | None = None, target: str | None = None, m: int = 5, max_iter: int = 10, seed: int = 0, key: list[str] | None = None) -> list[dict]:
    """The pooled mean of each column with missing values over m imputations, by Rubin's rules."""
    df = normalise(df)
    every = numeric_columns(df)
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(missing(df, c)).alias(f"m{k}") for k, c in enumerate(every))).first()
    want = [c for k, c in enumerate(every) if 0 < counts[f"m{k}"] < counts["n"] and c != target and (columns is None or c in columns)]
    if not want:
        return []
    made = ChainedImputer(m, max_iter, seed, key=key).fit(df, every).draws(df, want, target)
    rows = made.groupBy("imputation_id").agg(*(F.avg(number(c)).alias(f"a{k}") for k, c in enumerate(want)), *(F.var_samp(number(c)).alias(f"v{k}") for k, c in enumerate(want))).orderBy("imputation_id").collect()
    out = []
    for k, c in enumerate(want):
        pooled = pool_rubin([r[f"a{k}"] for r in rows], [(r[f"v{k}"] or 0.0) / counts["n"] for r in rows])
        out.append({"column": c, "missing_rate": counts[f"m{every.index(c)}"] / counts["n"], "naive_se": pooled["within_variance"] ** 0.5, **pooled})
    return out
