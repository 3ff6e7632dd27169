"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells (source, language, topic) by their tokens (words).
Cell weights are raked: scaled in turn so that each marginal meets its target shares,
``ROUNDS`` times. A cell's weight over its tokens gives the relative chance of its
documents; the chances are scaled, with those over 1 set to 1, so that the expected
tokens are the stated fraction of all. A document stays if a hash of its id, as a
number from 0 to 1, is below its chance, so any rerun or partitioning agrees.

Topics come from the texts, since the tables have none: of the terms (runs of five or
more letters, A-Z lowered) that at most a fifth of all documents hold, the ``TOPICS``
most widespread ones are the topics, counted over all documents. A document's topic is
the one of them that it holds most often, of equals the rarer; ``other`` without any.

Documents are written once with their tokens and topic, so texts are read twice and
never shuffled. Cells are raked on the driver up to ``CELLS`` of them, otherwise by
DataFrame aggregations over written tables; either way the result is the same. Up to
``CELLS`` cells are broadcast to the documents, more are joined.

Targets: a mapping from values to shares, where values not named keep what they have
between them; or a power of the present shares (1 keeps them, 0 makes them even).

Edge cases: a null source, language or topic is a value of its own; null and empty
texts have no tokens, and cells without tokens get the fraction as their chance; a
very long text is cut into an array of its terms, a few times its size, in one task; a
null id hashes as an empty string; repeated rows each count and stay or go together;
target values that no document has are left out; other columns are carried along in
``row``; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, store, table

ROUNDS = 20
CELLS = 50_000
FRACTION = 0.6
DIMS = ("source", "lang", "topic")
TOPICS = 12
#: One over the largest share of documents that hold a topic's term.
WIDEST = 5
#: Terms: any five or more characters that are a-z or not ASCII.
TERM = r"[^\x00-\x60\x7B-\x7F]{5,}"
#: The mixture of the query and of the pipeline.
TARGETS = {
    "source": 0.5,
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15},
    "topic": 0.7,
}


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def terms(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


def topic_terms(docs: DataFrame, text_col: str = "text", count: int = TOPICS) -> list[str]:
    """The terms that stand for topics, from the most widespread to the rarest, by all documents."""
    held = docs.select(F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    few = held.where(F.col("df") * WIDEST <= docs.count()).orderBy(F.desc("df"), "term").limit(count)
    return [r["term"] for r in few.collect()]


def topic_of(text: Column, names: list[str]) -> Column:
    """The name that a text holds most often, of equals the last; ``other`` without any."""
    if not names:
        return F.lit("other")
    topics = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(n).alias("term")) for k, n in enumerate(names)))

    def most(hits: Column) -> Column:
        counted = F.transform(topics, lambda t: F.struct(F.size(F.filter(hits, lambda h: h == t["term"])).alias("n"), t["rank"].alias("rank"), t["term"].alias("term")))
        return F.when(F.size(hits) > 0, F.array_max(counted)["term"]).otherwise("other")

    # an array of one, so that the hits are found once and not for each topic
    return F.transform(F.array(F.filter(terms(text), lambda t: t.isin(names))), most)[0]


def _value(c: Column) -> Column:
    """A key in which null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def _shares(tokens: dict[str, float], target) -> dict[str, float]:
    """The target share of each present value."""
    total = sum(tokens.values())
    if not isinstance(target, dict):
        power = {v: t**target if t > 0 else 0.0 for v, t in tokens.items()}
        return {v: p / sum(power.values()) for v, p in power.items()}
    named = {v: target[v[1:]] for v in tokens if v[1:] in target and v != "null" and tokens[v] > 0}
    left = sum(t for v, t in tokens.items() if v not in named) / total
    scale = (1 - left) / sum(named.values()) if named else 0.0
    return {v: named[v] * scale if v in named else t / total for v, t in tokens.items()}


def _marginal(cells: list[dict], dim: str, what: str) -> dict[str, float]:
    out: dict[str, float] = {}
    for c in cells:
        out[c[dim]] = out.get(c[dim], 0.0) + c[what]
    return out


def rake(cells: list[dict], targets: dict, rounds: int = ROUNDS) -> list[dict]:
    """Adds ``weight`` to cells (source, lang, topic, tokens); the weights add up to the tokens."""
    total = float(sum(c["tokens"] for c in cells))
    cells = [{**c, "weight": float(c["tokens"])} for c in sorted(cells, key=lambda c: [c[d] for d in DIMS])]
    if not total:
        return cells
    goal = {d: _shares(_marginal(cells, d, "tokens"), targets[d]) for d in DIMS}
    for _ in range(rounds):
        for d in DIMS:
            now = _marginal(cells, d, "weight")
            for c in cells:
                if now[c[d]] > 0:
                    c["weight"] *= goal[d][c[d]] * total / now[c[d]]
    return cells


def _shares_frame(cells: DataFrame, dim: str, target) -> DataFrame:
    """(dim, share) as ``_shares`` has it."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t"))
    every = Window.partitionBy(F.lit(0))
    if not isinstance(target, dict):
        power = F.when(F.col("t") > 0, F.pow("t", F.lit(float(target)))).otherwise(0.0)
        return sums.select(dim, (power / F.sum(power).over(every)).alias("share"))
    value = F.lit(None).cast("double")
    for v, share in target.items():
        value = F.when((F.col(dim) == "=" + v) & (F.col("t") > 0), share).otherwise(value)
    sums = sums.withColumn("named", value)
    left = F.sum(F.when(F.col("named").isNull(), F.col("t")).otherwise(0.0)).over(every) / F.sum("t").over(every)
    return sums.select(dim, F.when(F.col("named").isNotNull(), F.col("named") * (1 - left) / F.sum("named").over(every)).otherwise(F.col("t") / F.sum("t").over(every)).alias("share"))


def rake_frame(cells: DataFrame, targets: dict, rounds: int = ROUNDS) -> DataFrame:
    """The same as ``rake`` for any number of cells."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goal = {d: store(_shares_frame(cells, d, targets[d]), "shares") for d in DIMS}
    now = store(cells.withColumn("weight", F.col("tokens").cast("double")), "weights")
    for _ in range(rounds):
        for d in DIMS:
            sums = now.groupBy(d).agg(F.sum("weight").alias("sum"))
            factor = F.when(F.col("sum") > 0, F.col("share") * total / F.col("sum")).otherwise(1.0)
            after = store(now.join(sums.join(goal[d], d).select(d, factor.alias("factor")), d).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"), "weights")
            discard(now)
            now = after
    return now


def chances(ratios: list[tuple[float, float]], fraction: float) -> float:
    """The scale c for which the tokens t times min(1, c r), over pairs (r, t), add up to the fraction of all."""
    total = sum(t for _, t in ratios)
    budget, capped = fraction * total, 0.0
    rest = sum(r * t for r, t in ratios)
    for r, t in sorted(ratios, reverse=True):
        if rest <= 0:
            break
        scale = (budget - capped) / rest
        if scale * r <= 1:
            return scale
        capped, rest = capped + t, rest - r * t
    return float("inf")


def _scale_frame(cells: DataFrame, fraction: float) -> float:
    """The same for any number of cells, by bisection over aggregates."""
    r = F.col("weight") / F.col("tokens")
    base = cells.where("tokens > 0 AND weight > 0")
    total, most = base.agg(F.sum("tokens"), F.max(r)).first()
    if not total:
        return float("inf")
    low, high = 0.0, 1.0
    reach = lambda c: base.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), c * r))).first()[0]
    goal = fraction * cells.agg(F.sum("tokens")).first()[0]
    for _ in range(200):
        if reach(high) >= goal or high * most > 1e15:
            break
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if reach(mid) < goal else (low, mid)
    return high


def uniform(id_value: Column) -> Column:
    """A number from 0 to 1 by the id: 52 bits of its MD5."""
    digits = F.substring(F.md5(F.coalesce(id_value.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(2**52)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict | None = None, fraction: float = FRACTION, cells_bound: int = CELLS, carry: list[str] | None = None) -> DataFrame:
    """(row, tokens, probability, kept) of each document; ``row`` holds the columns ``carry`` (all, if not given) and the id."""
    targets = targets or TARGETS
    spark = docs.sparkSession
    names = topic_terms(docs, text_col)
    row = F.struct(*(carry or docs.columns))
    rows = docs.select(row.alias("row"), n_tokens(F.col(text_col)).alias("tokens"), _value(F.col("source")).alias("source"), _value(F.col("lang")).alias("lang"), _value(topic_of(F.col(text_col), names)).alias("topic"))
    rows = store(rows, "mixture-rows")
    cells = store(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "mixture")
    few = cells.limit(cells_bound + 1).count() <= cells_bound
    if few:
        raked = rake([c.asDict() for c in cells.collect()], targets)
        scale = chances([(c["weight"] / c["tokens"], c["tokens"]) for c in raked if c["tokens"]], fraction)
        made = [tuple(c[d] for d in DIMS) + (_chance(c, scale, fraction),) for c in raked]
        odds = F.broadcast(spark.createDataFrame(made, ", ".join(f"{d} string" for d in DIMS) + ", p double"))
    else:
        raked = rake_frame(cells, targets)
        scale = _scale_frame(raked, fraction)
        ratio = F.col("weight") / F.col("tokens")
        p = F.when(F.col("tokens") == 0, fraction).when(F.col("weight") <= 0, 0.0).otherwise(F.lit(1.0) if scale == float("inf") else F.least(F.lit(1.0), scale * ratio))
        odds = raked.select(*DIMS, p.alias("p"))
    out = rows.join(odds, list(DIMS)).withColumn("p", F.round("p", 9))
    return out.select("row", "tokens", F.col("p").alias("probability"), (uniform(F.col("row")[id_col]) < F.col("p")).alias("kept"))


def _chance(cell: dict, scale: float, fraction: float) -> float:
    if not cell["tokens"]:
        return fraction
    if cell["weight"] <= 0:
        return 0.0
    return min(1.0, scale * cell["weight"] / cell["tokens"])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance of every document under the target mixture, and whether it stays."""
    out = mixed(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "tokens", "probability", "kept")


def _sql() -> str:
    """The query in SQL: one table for each step of the raking."""
    steps = [
        f"""texts AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS tokens,
      coalesce('=' || source, 'null') AS source, coalesce('=' || lang, 'null') AS lang,
      regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}') AS terms FROM documents)""",
        f"""names AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS rank FROM (SELECT unnest(list_distinct(terms)) AS term FROM texts)
      GROUP BY term HAVING count(*) * {WIDEST} <= (SELECT count(*) FROM texts) ORDER BY rank LIMIT {TOPICS})""",
        """topics AS MATERIALIZED (SELECT n, '=' || term AS topic FROM (SELECT n, term, row_number() OVER (PARTITION BY n ORDER BY count(*) DESC, rank DESC) AS best
      FROM (SELECT n, unnest(terms) AS term FROM texts) JOIN names USING (term) GROUP BY n, term, rank) WHERE best = 1)""",
        "docs AS MATERIALIZED (SELECT texts.*, coalesce(topic, '=other') AS topic FROM texts LEFT JOIN topics USING (n))",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens, CAST(sum(tokens) AS DOUBLE) AS weight FROM docs GROUP BY ALL)",
        "whole AS MATERIALIZED (SELECT sum(tokens) AS total FROM w0)",
    ]
    for d in DIMS:
        target = TARGETS[d]
        steps.append(f"m_{d} AS MATERIALIZED (SELECT {d}, sum(tokens) AS t FROM w0 GROUP BY {d})")
        if isinstance(target, dict):
            cases = " ".join(f"WHEN {d} = '={v}' AND t > 0 THEN {s}" for v, s in target.items())
            steps.append(f"n_{d} AS MATERIALIZED (SELECT *, CASE {cases} END AS named FROM m_{d})")
            steps.append(f"""g_{d} AS MATERIALIZED (SELECT {d}, CASE WHEN named IS NULL THEN t / total ELSE named *
      (1 - (SELECT coalesce(sum(t), 0) FROM n_{d} WHERE named IS NULL) / total) / (SELECT sum(named) FROM n_{d}) END AS share FROM n_{d}, whole)""")
        else:
            steps.append(f"g_{d} AS MATERIALIZED (SELECT {d}, CASE WHEN t > 0 THEN t ^ {target} ELSE 0 END / (SELECT sum(t ^ {target}) FROM m_{d} WHERE t > 0) AS share FROM m_{d})")
    last, k = "w0", 0
    for _ in range(ROUNDS):
        for d in DIMS:
            k += 1
            steps.append(f"""w{k} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * CASE WHEN s > 0 THEN share * total / s ELSE 1 END AS weight
      FROM {last} JOIN (SELECT {d}, sum(weight) AS s FROM {last} GROUP BY {d}) USING ({d}) JOIN g_{d} USING ({d}), whole)""")
            last = f"w{k}"
    steps += [
        f"ratios AS MATERIALIZED (SELECT *, weight / tokens AS r, row_number() OVER (ORDER BY weight / tokens DESC, tokens DESC) AS n FROM {last} WHERE tokens > 0)",
        "running AS MATERIALIZED (SELECT *, coalesce(sum(tokens) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM ratios)",
        f"scale AS MATERIALIZED (SELECT ({FRACTION} * total - capped) / rest AS c FROM running, whole WHERE rest > 0 AND ({FRACTION} * total - capped) / rest * r <= 1 ORDER BY n LIMIT 1)",
        f"odds AS MATERIALIZED (SELECT source, lang, topic, round(CASE WHEN tokens = 0 THEN {FRACTION} WHEN weight <= 0 THEN 0 ELSE least(1, coalesce((SELECT c FROM scale), 1e300) * weight / tokens) END, 9) AS p FROM {last})",
    ]
    return f"""WITH {", ".join(steps)}
    SELECT doc_id, CAST(docs.tokens AS BIGINT) AS tokens, p AS probability,
      CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < p AS kept
    FROM docs JOIN odds USING (source, lang, topic)"""


OP6_SQL = _sql()
