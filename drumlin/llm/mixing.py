"""Operator 1, mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). The cells' tokens are raked: in turn,
the cells of each source, language and topic are scaled so that their sum meets its target
share, until all three marginals hold. A cell can give no more than the tokens it has, so
each sweep ends by cutting the cells back to their capacity; the next sweep gives the rest
to the others. A document is then kept with the probability fitted tokens / tokens of its
cell, by a hash of its id and text, so a rerun on any number of executors keeps the same.

Only cells leave the executors, and only up to `cell_limit` of them are raked on the
driver; more are raked by the same sweeps, as many, over DataFrames. Documents meet their cell's
probability in a join that broadcasts up to `cell_limit` cells and shuffles beyond.

Targets that no weights can meet (a cell gives no more than it has) are reported: the fit
ends with the gap between each marginal and its target, and warns where one is left.

Defined cases. Null or empty text has no tokens: it counts nowhere, and a cell without
tokens has probability 0. Null source, language or topic is a value of its own. A value
without a target has target 0 if explicit targets are given; targets of absent values are
dropped and the rest scaled to 1. Repeated rows are drawn alike. An empty table gives an
empty result. Extra columns are kept and may bear any name."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drumlin.llm.common import forget, free_name, materialize, words_of

DIMENSIONS = ("source", "lang", "topic")
CELL_LIMIT = 200_000
SWEEPS, TOLERANCE = 200, 1e-9
#: A share of the budget by which a marginal may miss its target before a warning.
UNMET = 1e-3
# What marks a topic, in order of precedence; at least one mark in `MARK_WORDS` words.
TOPICS = {"tabular": r"\|", "markup": r"[#*$%&<>]+", "numeric": r"[0-9]+", "exclamation": "!+"}
MARK_WORDS = 10


def topic_of(text: Column, tokens: Column) -> Column:
    """A topic by form, for corpora that carry none: the first whose marks are dense enough."""
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS.items()):
        marks = F.size(F.split(text, pattern)) - 1
        out = F.when(marks * MARK_WORDS >= F.greatest(tokens, F.lit(1)), name).otherwise(out)
    return out


def with_cells(docs: DataFrame, *, text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, names: Mapping[str, str]) -> DataFrame:
    """Adds the columns named in `names`: tokens, source, lang and topic of each document."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.withColumn(names["tokens"], F.size(words_of(value)).cast("long"))
    topic = topic_of(value, F.col(names["tokens"])) if topic is None else topic
    return df.withColumns({names["source"]: F.col(f"`{source}`").cast("string"), names["lang"]: F.col(f"`{lang}`").cast("string"), names["topic"]: topic.cast("string")})


def natural_targets(shares: np.ndarray, exponent: float) -> np.ndarray:
    """Shares raised to a power under 1: large values shrink, small ones grow."""
    raised = np.where(shares > 0, shares, 0) ** exponent * (shares > 0)
    return raised / raised.sum() if raised.sum() else raised


def _targets(values: list, sums: np.ndarray, given: Mapping | float) -> np.ndarray:
    if isinstance(given, Mapping):
        wanted = np.array([float(given.get(v, 0)) for v in values])
        return wanted / wanted.sum() if wanted.sum() else wanted
    return natural_targets(sums / sums.sum() if sums.sum() else sums, given)


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], budget: float, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Fitted tokens of each cell; they sum to `budget` as far as capacity allows."""
    fitted = tokens.astype(float) * (budget / tokens.sum() if tokens.sum() else 0)
    for _ in range(sweeps):
        before = fitted
        for code, target in zip(codes, targets, strict=True):
            sums = np.bincount(code, fitted, minlength=len(target))
            fitted = fitted * np.divide(target * budget, sums, out=np.zeros(len(target)), where=sums > 0)[code]
        fitted = np.minimum(fitted, tokens)
        if np.abs(fitted - before).max(initial=0) <= tolerance * max(budget, 1):
            break
    return fitted


def rake_table(cells: DataFrame, targets: Mapping[str, Mapping | float], budget: float, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The same sweeps, by the same stop rule, over a table of cells that is too large for the
    driver; and the marginals' targets, (value, target) by dimension."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    marginals = {}
    for d in DIMENSIONS:
        given = targets[d]
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("sum"))
        if isinstance(given, Mapping):
            spark = cells.sparkSession
            wanted = spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{d} string, raised double")
            sums = sums.join(wanted, sums[d].eqNullSafe(wanted[d]), "left").select(sums[d], F.coalesce("raised", F.lit(0.0)).alias("raised"))
        else:
            sums = sums.select(d, F.when(F.col("sum") > 0, F.pow(F.col("sum") / total, F.lit(given))).otherwise(0.0).alias("raised"))
        whole = sums.agg(F.sum("raised")).first()[0] or 1
        marginals[d] = materialize(sums.select(F.col(d).alias("__v"), (F.col("raised") / whole * budget).alias("__target")), "targets")
    fitted = materialize(cells.withColumn("fitted", F.col("tokens") * (budget / total)), "fitted")
    for _ in range(sweeps):
        new = fitted.withColumn("__before", F.col("fitted"))
        for d in DIMENSIONS:
            factor = new.groupBy(F.col(d).alias("__k")).agg(F.sum("fitted").alias("__sum")).join(marginals[d], F.col("__k").eqNullSafe(F.col("__v")))
            factor = factor.select("__k", F.when(F.col("__sum") > 0, F.col("__target") / F.col("__sum")).otherwise(0.0).alias("__factor"))
            new = new.join(factor, F.col(d).eqNullSafe(F.col("__k"))).withColumn("fitted", F.col("fitted") * F.col("__factor")).drop("__k", "__factor")
        new = materialize(new.withColumn("fitted", F.least("fitted", F.col("tokens").cast("double"))), "fitted")
        moved = new.agg(F.max(F.abs(F.col("fitted") - F.col("__before")))).first()[0] or 0
        forget(fitted)
        fitted = new.drop("__before")
        if moved <= tolerance * max(budget, 1):
            break
    return fitted, {d: m.select(F.col("__v").alias("value"), F.col("__target").alias("target")) for d, m in marginals.items()}


def unmet(fitted: DataFrame, targets: Mapping[str, DataFrame], budget: float) -> DataFrame:
    """(dimension, value, share, target, gap): each marginal's fitted share of the budget and
    the share it should have. A gap that is not near 0 is a target that the cells' capacities
    or their pattern don't allow."""
    rows = []
    for d, wanted in targets.items():
        sums = fitted.groupBy(F.col(d).alias("v")).agg(F.sum("fitted").alias("sum"))
        both = sums.join(wanted, sums["v"].eqNullSafe(wanted["value"]), "left")
        share, target = F.col("sum") / max(budget, 1e-300), F.coalesce("target", F.lit(0.0)) / max(budget, 1e-300)
        rows.append(both.select(F.lit(d).alias("dimension"), F.col("v").alias("value"), share.alias("share"), target.alias("target"), (share - target).alias("gap")))
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


def fit_cells(cells: DataFrame, targets: Mapping[str, Mapping | float], fraction: float, cell_limit: int = CELL_LIMIT) -> tuple[DataFrame, bool, DataFrame]:
    """cells with `fitted` and `probability`; whether they are few enough to broadcast; and
    unmet() of the fit. Where a marginal misses its target by more than UNMET of the budget,
    a warning says by how much: the fit is then the nearest that the sweeps have reached."""
    small = cells.count() <= cell_limit
    spark = cells.sparkSession
    if small:
        frame = cells.select(*DIMENSIONS, "tokens").toPandas()
        tokens = frame["tokens"].to_numpy(dtype=float)
        budget = fraction * tokens.sum()
        codes, wanted, marginals = [], [], {}
        for d in DIMENSIONS:
            column = frame[d].astype(object).where(frame[d].notna(), None)
            values = sorted(set(column), key=lambda v: (v is not None, v))
            at = {v: i for i, v in enumerate(values)}
            codes.append(np.array([at[v] for v in column], dtype=np.int64))
            wanted.append(_targets(values, np.bincount(codes[-1], tokens, minlength=len(values)), targets[d]))
            marginals[d] = spark.createDataFrame([(v, float(t * budget)) for v, t in zip(values, wanted[-1], strict=True)], "value string, target double")
        frame["fitted"] = rake(tokens, codes, wanted, budget)
        rows = [(*(None if v is None or v != v else v for v in r[:3]), int(r[3]), float(r[4])) for r in frame[[*DIMENSIONS, "tokens", "fitted"]].itertuples(index=False)]
        fitted = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, fitted double")
    else:
        total = cells.agg(F.sum("tokens")).first()[0] or 0
        budget = fraction * total
        fitted, marginals = rake_table(cells, targets, budget)
    gaps = unmet(fitted, marginals, budget)
    worst = gaps.orderBy(F.abs("gap").desc(), "dimension", "value").first()
    if worst is not None and abs(worst["gap"]) > UNMET:
        warnings.warn(f"the targets can't be met: {worst['dimension']} {worst['value']} gets {worst['share']:.4f} of the budget, not {worst['target']:.4f}", stacklevel=3)
    return fitted.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.col("fitted") / F.col("tokens"), F.lit(1.0))).otherwise(0.0)), small, gaps


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None,
    targets: Mapping[str, Mapping | float] | None = None, fraction: float = 0.7, seed: int = 7, cell_limit: int = CELL_LIMIT, slim: bool = False,
) -> tuple[DataFrame, Mapping[str, str]]:
    """`docs` with tokens, topic, weight, probability and sampled, and those columns' names.

    `targets` gives each of source, lang and topic either shares or an exponent for the
    natural shares. `fraction` of all tokens is the budget. weight is the factor by which
    the cell's share of the corpus changes. With `slim` only the id column is kept and the
    table is written between the passes; without, each pass reads the documents."""
    targets = targets or {"source": 0.7, "lang": 0.8, "topic": 1.0}
    names = {k: free_name(docs, f"__{k}") for k in ("tokens", "source", "lang", "topic", "draw", "probability", "weight", "sampled")}
    df = with_cells(docs, text=text, source=source, lang=lang, topic=topic, names=names)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), f"`{id_col}`", f"`{text}`"), 11) / float(1 << 53)
    df = df.withColumn(names["draw"], draw)
    if slim:
        df = materialize(df.select(f"`{id_col}`", *(names[k] for k in ("tokens", "source", "lang", "topic", "draw"))), "cells")
    cells = df.groupBy(*(F.col(names[d]).alias(d) for d in DIMENSIONS)).agg(F.sum(names["tokens"]).alias("tokens"))
    fitted, small, _ = fit_cells(materialize(cells, "cell-sums"), targets, fraction, cell_limit)
    whole = fitted.agg(F.sum("tokens"), F.sum("fitted")).first()
    ratio = float(whole[0] or 0) / float(whole[1]) if whole[1] else 0.0
    keys = {d: free_name(df, f"__key_{d}") for d in DIMENSIONS}
    fitted = fitted.select(*(F.col(d).alias(k) for d, k in keys.items()), F.col("probability").alias(names["probability"]), (F.col("probability") * ratio).alias(names["weight"]))
    on = [F.col(names[d]).eqNullSafe(F.col(keys[d])) for d in DIMENSIONS]
    out = df.join(F.broadcast(fitted) if small else fitted, on).drop(*keys.values())
    return out.withColumn(names["sampled"], F.col(names["draw"]) < F.col(names["probability"])), names


def mixing_report(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each document: id, source, lang, topic, tokens, weight, probability, sampled."""
    out, names = mix(docs, id_col=id_col, slim=True, **options)
    return out.select(F.col(f"`{id_col}`"), *(F.col(names[k]).alias(k) for k in ("source", "lang", "topic", "tokens", "weight", "probability", "sampled")))


def sample_to_targets(docs: DataFrame, **options) -> DataFrame:
    """The documents that the calibrated probabilities keep, with their own columns."""
    out, names = mix(docs, **options)
    return out.where(names["sampled"]).select(*(F.col(f"`{c}`") for c in docs.columns))
