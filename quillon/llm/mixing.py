"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic by their tokens. Raking scales the
cells in turn until their token weights have the target marginals; the weights, over the tokens
there are, become sampling probabilities, the largest of them 1, so that the expected tokens of a sample stand
in the target proportions. A document's draw is a hash of its id: the same in every run and retry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.spool import Spool

DIMENSIONS = ("source", "lang", "topic")
#: Marginal targets where none are given: natural shares to this power, which lifts small sources and lowers large ones.
POWER = 0.8
STEPS, SEED = 150, 17
#: Cells up to which raking runs on the driver (40 bytes each); more are raked as tables.
DRIVER_CELLS = 500_000
#: Topics of texts without a topic column: the first pattern found.
TOPICS = [("legal", r"(?i)licen[sc]e"), ("technical", r"(?i)token|http|[{}]"), ("contact", r"@|\+[0-9]"), ("table", r"\|")]


def topic_of(text: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in TOPICS:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("general")


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the id alone."""
    digest = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / 4294967296.0


def rake(cells: pd.DataFrame, targets: dict[str, dict], steps: int = STEPS) -> np.ndarray:
    """Weights of cells (one column a dimension, tokens) after so many scalings, one dimension after another."""
    x = cells["tokens"].to_numpy(float)
    codes = {d: cells[d].astype("category").cat for d in DIMENSIONS}
    wanted = {d: np.array([targets[d].get(c, 0.0) for c in codes[d].categories], float) for d in DIMENSIONS}
    index = {d: codes[d].codes.to_numpy() for d in DIMENSIONS}
    for k in range(steps):
        d = DIMENSIONS[k % len(DIMENSIONS)]
        total = np.bincount(index[d], x, len(wanted[d]))
        x = x * (wanted[d] / np.where(total > 0, total, 1))[index[d]]
    return x


def _rake_tables(cells: DataFrame, targets: DataFrame, spool: Spool, steps: int) -> DataFrame:
    """The same as tables, for cells beyond the driver; each scaling is written, which cuts lineage."""
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for k in range(steps):
        d = DIMENSIONS[k % len(DIMENSIONS)]
        total = now.groupBy(d).agg(F.sum("weight").alias("total"))
        wanted = targets.where(F.col("dimension") == d).select(F.col("value").alias(d), "share")
        factor = total.join(wanted, d, "left").select(d, F.when(F.col("total") > 0, F.coalesce("share", F.lit(0.0)) / F.col("total")).otherwise(0.0).alias("factor"))
        now = spool.table(f"raked-{k}", now.join(factor, d).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"))
        if k:
            spool.drop(f"raked-{k - 1}")
    return now


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, steps: int = STEPS, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, source, lang, topic, n_tokens, p_keep, kept.

    targets: for each of source, lang and topic a share for each value; values without one get none. Where a
    dimension has no targets, its natural shares to ``power``, made to sum to 1. n_tokens: words. Null sources and
    languages are the value '', a topic column is used where there is one. Texts without words weigh nothing
    and share their cell's probability; a cell of such texts alone is kept. Rows that repeat a doc_id share
    a draw. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    spool = Spool(spark, "mixing")
    text = F.col("text").cast("string")
    topic = F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else F.coalesce(topic_of(text), F.lit("general"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), topic.alias("topic"), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
    )
    rows = spool.table("rows", rows)
    cells = spool.table("cells", rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    wanted = []
    for d in DIMENSIONS:
        if targets and d in targets:
            wanted += [(d, str(v), float(s)) for v, s in targets[d].items()]
    given = spark.createDataFrame(wanted, "dimension string, value string, share double")
    for d in DIMENSIONS:
        if not (targets and d in targets):
            shares = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("t")).select("value", F.pow(F.col("t").cast("double"), F.lit(power)).alias("w"))
            total = shares.agg(F.sum("w").alias("all"))
            given = given.union(shares.join(F.broadcast(total)).select(F.lit(d), "value", F.when(F.col("all") > 0, F.col("w") / F.col("all")).otherwise(0.0)))
    given = spool.table("targets", given)
    if cells.count() <= DRIVER_CELLS:
        held = cells.orderBy(*DIMENSIONS).toPandas()
        by: dict[str, dict] = {d: {} for d in DIMENSIONS}
        for d, v, s in given.join(_values(cells), ["dimension", "value"], "left_semi").toPandas().itertuples(index=False):
            by[d][v] = s
        held["weight"] = rake(held, by, steps) if len(held) else []
        raked = spark.createDataFrame([tuple(x) for x in held.astype({"tokens": int}).itertuples(index=False)], "source string, lang string, topic string, tokens long, weight double")
    else:
        raked = _rake_tables(cells, given, spool, steps)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    most = raked.agg(F.max(ratio).alias("most"))
    p = raked.join(F.broadcast(most)).select(*DIMENSIONS, F.coalesce(F.when(F.col("most") > 0, ratio / F.col("most")).otherwise(1.0), F.lit(1.0)).alias("p_keep"))
    p = spool.table("probabilities", p)
    p = F.broadcast(p) if p.count() <= DRIVER_CELLS else p
    return rows.join(p, list(DIMENSIONS)).select("doc_id", *DIMENSIONS, "n_tokens", F.round("p_keep", 6).alias("p_keep"), (uniform(F.col("doc_id"), seed) < F.col("p_keep")).alias("kept"))


def _values(cells: DataFrame) -> DataFrame:
    out = None
    for d in DIMENSIONS:
        one = cells.select(F.lit(d).alias("dimension"), F.col(d).alias("value")).distinct()
        out = one if out is None else out.union(one)
    return out


def oracle_sql(power: float = POWER, steps: int = STEPS, seed: int = SEED) -> str:
    """The rows of mix() over documents without targets, for DuckDB."""
    cases = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    scale = ", ".join(f"sum(x) OVER (PARTITION BY {d}) AS t_{d}" for d in DIMENSIONS)
    shares = ", ".join(f"(SELECT {d} AS v, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS s FROM cells GROUP BY 1) AS w_{d}" for d in DIMENSIONS)
    joined = " AND ".join(f"w_{d}.v = c.{d}" for d in DIMENSIONS)
    return f"""
    WITH RECURSIVE rows_ AS (
      SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {cases} ELSE 'general' END AS topic,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
      FROM documents
    ), cells AS MATERIALIZED (
      SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM rows_ GROUP BY ALL
    ), start_ AS MATERIALIZED (
      SELECT c.*, {", ".join(f"w_{d}.s AS s_{d}" for d in DIMENSIONS)} FROM cells c, {shares} WHERE {joined}
    ), raking AS (
      SELECT 0 AS k, source, lang, topic, tokens, {", ".join(f"s_{d}" for d in DIMENSIONS)}, tokens AS x FROM start_
      UNION ALL
      SELECT k + 1, source, lang, topic, tokens, {", ".join(f"s_{d}" for d in DIMENSIONS)},
        x * CASE k % 3 WHEN 0 THEN s_source / t_source WHEN 1 THEN s_lang / t_lang ELSE s_topic / t_topic END
      FROM (SELECT *, {scale} FROM raking) WHERE k < {steps}
    ), p AS (
      SELECT source, lang, topic, x / tokens / max(x / tokens) OVER () AS p FROM raking WHERE k = {steps}
    )
    SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS p_keep,
      CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0 < p AS kept
    FROM rows_ JOIN p USING (source, lang, topic)"""
