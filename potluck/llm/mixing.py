"""Mixing sources to target weights: iterative proportional fitting, then calibrated Poisson sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potluck.functions.text import let

from .common import cut, drop_cut, fresh

DIMENSIONS = ("source", "lang", "topic")
ITERATIONS, FRACTION, TEMPERATURE, SEED = 20, 0.6, 0.7, "mix-1"
#: Cells of the contingency table up to which the fit runs in numpy on the driver; beyond it the same steps run as joins.
DRIVER_CELLS = 200_000
NONE = "(none)"


#: topic -> (words, marks anywhere in a text); of equal counts the earlier topic wins.
TOPICS: dict[str, tuple[list[str], list[str]]] = {
    "legal": ("contract copyright court jurisdiction liability licence licensed license licenses permission permissions statute trademark warranties warranty".split(), []),
    "contact": ("address contact e-mail email mail phone telephone".split(), ["@"]),
    "technology": ("algorithm computer computers database function http server servers software variable website".split(), []),
    "finance": ("account accounts bank budget credit invest invoice invoices market markets payment payments price prices tax taxes".split(), []),
    "health": ("clinic disease diseases doctor doctors hospital medicine patient patients symptoms therapy".split(), []),
    "food": ("bake bread cook flour ingredients kitchen recipe recipes sugar".split(), []),
    "table": ([], [" | "]),
    "markup": ([], ["***", "###"]),
}
#: Marks that end a word are not part of it.
ENDINGS = ".,;:!?)"
OTHERWISE = "prose"


def topic(text: Column, topics: dict[str, tuple[list[str], list[str]]] = TOPICS) -> Column:
    """The topic with the most of its words (each time) and marks (each once) in the text, "prose" where there are none; case does not count.

    The words are looked up in one set, so a text is cut and searched once, however many words the topics have.
    """
    t = F.coalesce(text, F.lit(""))
    every = sorted({w for words, _ in topics.values() for w in words})
    bare = F.transform(F.split(F.lower(t), r"\s+"), lambda w: F.rtrim(w, F.lit(ENDINGS)))

    def hits(found: Column, words: list[str]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(words))) if words else F.lit(0)

    def choose(found: Column) -> Column:
        scores = F.array(*[sum([F.contains(t, F.lit(m)).cast("int") for m in marks], hits(found, words)) for words, marks in topics.values()])
        names = F.array(*map(F.lit, topics))
        return let(scores, lambda n: F.when(F.array_max(n) == 0, OTHERWISE).otherwise(F.element_at(names, F.array_position(n, F.array_max(n)).cast("int"))))

    return let(F.filter(bare, lambda w: w.isin(every)), choose)


def uniform(id_column: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed only: 52 bits of an MD5."""
    key = F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit("|" + seed))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def smoothed(mass: dict[str, float], temperature: float = TEMPERATURE) -> dict[str, float]:
    """Target shares proportional to mass ** temperature."""
    p = {k: v**temperature for k, v in sorted(mass.items()) if v > 0}
    return {k: v / sum(p.values()) for k, v in p.items()}


def rake(keys: list[np.ndarray], mass: np.ndarray, targets: list[dict[str, float]], iterations: int) -> np.ndarray:
    """Weights of the cells after raking mass to each dimension's target shares in turn."""
    w = mass.astype(np.float64).copy()
    total = w.sum()
    coded = [np.unique(k, return_inverse=True) for k in keys]
    wanted = [np.array([t.get(name, 0.0) for name in names]) * total for (names, _), t in zip(coded, targets)]
    for _ in range(iterations):
        for (names, code), goal in zip(coded, wanted):
            now = np.bincount(code, weights=w, minlength=len(names))
            w *= np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[code]
    return w


def probabilities(mass: np.ndarray, weight: np.ndarray, fraction: float) -> np.ndarray:
    """min(1, s * weight / mass), with s such that the expected mass is fraction of the whole (or as near as 1 allows)."""
    factor = np.divide(weight, mass, out=np.zeros_like(weight), where=mass > 0)
    order = np.argsort(-factor, kind="stable")
    f, m, w = factor[order], mass[order].astype(np.float64), weight[order]
    budget = fraction * m.sum()
    full, rest = np.cumsum(m) - m, np.cumsum(w[::-1])[::-1]
    scale = np.divide(budget - full, rest, out=np.full_like(rest, np.inf), where=rest > 0)
    fits = np.flatnonzero((f <= 0) | (np.where(f > 0, scale, 0.0) * f <= 1))
    s = scale[fits[0]] if len(fits) else np.inf
    p = np.where(factor > 0, np.minimum(1.0, np.where(np.isinf(s), 1.0, s) * factor), 0.0)
    return np.where((factor > 0) & np.isinf(s), 1.0, p)


def _rake_distributed(cells: DataFrame, targets: list[DataFrame], iterations: int) -> DataFrame:
    """rake() over a table of cells too large for the driver; each sweep is a table in the shared folder."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("mass")).first()[0] or 0.0
    now, path = cut(cells.withColumn("w", F.col("mass").cast("double")))
    for _ in range(iterations):
        step = now
        for d, goal in zip(DIMENSIONS, targets):
            sums = step.groupBy(d).agg(F.sum("w").alias("__s"))
            ratio = sums.join(goal, d, "left").select(
                d, F.when(F.col("__s") > 0, F.coalesce("share", F.lit(0.0)) * F.lit(float(total)) / F.col("__s")).otherwise(0.0).alias("__r")
            )
            step = step.join(ratio, d).withColumn("w", F.col("w") * F.col("__r")).drop("__r")
        after, fresh = cut(step)
        drop_cut(spark, path)
        now, path = after, fresh
    return now


def tagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col("source"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("lang"), F.lit(NONE)).alias("lang"),
        topic(F.col(text_col)).alias("topic"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\S+")).cast("long").alias("n_tokens"),
    )


def cell_probabilities(
    cells: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    fraction: float = FRACTION,
    iterations: int = ITERATIONS,
    temperature: float = TEMPERATURE,
    driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """(source, lang, topic, mass, weight, p) of cells (source, lang, topic, mass)."""
    spark = cells.sparkSession
    cells, _ = cut(cells)
    if cells.count() <= driver_cells:
        c = cells.orderBy(*DIMENSIONS).toPandas()
        mass = c["mass"].to_numpy(dtype=np.float64)
        goals = []
        for d in DIMENSIONS:
            goals.append((targets or {}).get(d) or smoothed(c.groupby(d)["mass"].sum().astype(float).to_dict(), temperature))
        w = rake([c[d].to_numpy() for d in DIMENSIONS], mass, goals, iterations)
        c["weight"], c["p"] = w, probabilities(mass, w, fraction)
        schema = "source string, lang string, topic string, mass long, weight double, p double"
        rows = [tuple(r) for r in c[[*DIMENSIONS, "mass", "weight", "p"]].itertuples(index=False)]
        return F.broadcast(spark.createDataFrame(rows, schema))
    goals = []
    for d in DIMENSIONS:
        given = (targets or {}).get(d)
        if given:
            goals.append(spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{d} string, share double"))
        else:
            power = cells.groupBy(d).agg(F.pow(F.sum("mass").cast("double"), F.lit(temperature)).alias("q")).where("q > 0")
            goals.append(power.crossJoin(F.broadcast(power.agg(F.sum("q").alias("__all")))).select(d, (F.col("q") / F.col("__all")).alias("share")))
    fitted = _rake_distributed(cells, goals, iterations).withColumnRenamed("w", "weight")
    fitted = fitted.withColumn("f", F.when(F.col("mass") > 0, F.col("weight") / F.col("mass")).otherwise(0.0))
    # the scale by bisection: the expected mass grows with it, and each probe is one aggregate of the cells
    budget = fraction * (fitted.agg(F.sum("mass")).first()[0] or 0)
    smallest = fitted.where("f > 0").agg(F.min("f")).first()[0]
    lo, hi = 0.0, 1.0 / smallest if smallest else 1.0
    for _ in range(60):
        s = (lo + hi) / 2
        if fitted.agg(F.sum(F.least(F.lit(1.0), F.lit(s) * F.col("f")) * F.col("mass"))).first()[0] >= budget:
            hi = s
        else:
            lo = s
    return fitted.withColumn("p", F.least(F.lit(1.0), F.lit(hi) * F.col("f"))).drop("f")


def sample_to_targets(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    fraction: float = FRACTION,
    iterations: int = ITERATIONS,
    temperature: float = TEMPERATURE,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, p) of the sampled documents.

    Token counts per (source, lang, topic) are raked to the target shares of each dimension
    (given, or proportional to the tokens ** temperature). A cell's documents are sampled with
    p = min(1, s * weight / tokens), s such that `fraction` of all tokens is expected; a document is
    taken if a hash of its id lies below p, so a decision never depends on other rows' order.

    A null source or language is the value "(none)"; a null or empty text has no tokens and, if
    all of its cell's are such, p = 0; a value without a target has p = 0; rows with the same id
    share one decision if they share a cell; a null id hashes as the empty string; an empty
    table gives an empty result; other columns are not read.
    """
    # the narrow rows are written, so texts are read once
    rows, _ = cut(tagged(docs, id_col, text_col))
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("mass"))
    p = cell_probabilities(cells, targets, fraction, iterations, temperature, driver_cells).select(*DIMENSIONS, "p")
    return rows.join(p, list(DIMENSIONS)).where(uniform(F.col("doc_id"), seed) < F.col("p")).select("doc_id", *DIMENSIONS, "n_tokens", "p")


def sample_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The sampled rows of docs with all of its columns; other arguments as for sample_to_targets."""
    id_col, text_col, seed = parameters.get("id_col", "doc_id"), parameters.get("text_col", "text"), parameters.get("seed", SEED)
    rest = {k: v for k, v in parameters.items() if k not in ("id_col", "text_col", "seed")}
    cells = tagged(docs, id_col, text_col).groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("mass"))
    p = cell_probabilities(cells, **rest)
    # a struct has one name, which must not be that of a column of docs
    name = fresh(docs, "cell")
    p = p.select(F.struct(*DIMENSIONS, "p").alias(name))
    on = (
        (F.coalesce(docs["source"], F.lit(NONE)) == p[name]["source"])
        & (F.coalesce(docs["lang"], F.lit(NONE)) == p[name]["lang"])
        & (topic(docs[text_col]) == p[name]["topic"])
    )
    return docs.join(p, on).where(uniform(docs[id_col], seed) < p[name]["p"]).drop(name)


def topic_sql(topics: dict[str, tuple[list[str], list[str]]] = TOPICS) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda words: "[" + ", ".join(map(quoted, words)) + "]"
    scores = []
    for words, marks in topics.values():
        parts = [f"len(list_filter(ws, lambda w: list_contains({listed(words)}, w)))"] if words else []
        scores.append(" + ".join(parts + [f"contains(coalesce(text, ''), {quoted(m)})::INTEGER" for m in marks]))
    return (
        f"(SELECT CASE WHEN list_max(n) = 0 THEN {quoted(OTHERWISE)} ELSE ({listed(topics)})[list_position(n, list_max(n))] END FROM (SELECT [{', '.join(scores)}] AS n FROM "
        f"(SELECT list_transform(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: rtrim(w, {quoted(ENDINGS)})) AS ws)))"
    )


def oracle(fraction: float = FRACTION, iterations: int = ITERATIONS, temperature: float = TEMPERATURE, seed: str = SEED) -> str:
    """DuckDB SQL for the rows of sample_to_targets with default targets over documents."""
    steps, last = [], "c0"
    for i in range(iterations):
        for d in DIMENSIONS:
            name = f"c{i}_{d}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.mass, "
                f"c.w * (g.share * t.total / sum(c.w) OVER (PARTITION BY c.{d})) AS w FROM {last} c JOIN g_{d} g ON c.{d} = g.{d} CROSS JOIN t)"
            )
            last = name
    goals = ", ".join(
        f"g_{d} AS MATERIALIZED (SELECT {d}, pow(sum(mass), {temperature}) / sum(pow(sum(mass), {temperature})) OVER () AS share FROM c0 GROUP BY {d} HAVING sum(mass) > 0)"
        for d in DIMENSIONS
    )
    return f"""
WITH r AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
    {topic_sql()} AS topic,
    CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS BIGINT) AS n_tokens
  FROM documents),
c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS mass, sum(n_tokens)::DOUBLE AS w FROM r GROUP BY ALL),
t AS (SELECT sum(mass)::DOUBLE AS total FROM c0),
{goals},
{", ".join(steps)},
f AS MATERIALIZED (SELECT *, w / mass AS f FROM {last} WHERE mass > 0),
o AS MATERIALIZED (SELECT *, coalesce(sum(mass) OVER (ORDER BY f DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
   sum(w) OVER (ORDER BY f DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM f),
s AS (SELECT arg_max(({fraction} * total - before) / rest, f) AS s FROM o CROSS JOIN t WHERE ({fraction} * total - before) / rest * f <= 1),
p AS (SELECT source, lang, topic, least(1.0, s.s * f) AS p FROM o CROSS JOIN s)
SELECT r.doc_id, r.source, r.lang, r.topic, r.n_tokens, round(p.p, 6) AS p FROM r JOIN p USING (source, lang, topic)
WHERE ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|{seed}'), 1, 13))::BIGINT::DOUBLE / {float(16**13)!r} < p.p
"""
