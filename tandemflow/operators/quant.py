"""The abundance matrix, in long form: normalisation, missing values, summaries, statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import from_symmetric_ratio, legacy_percentile, symmetric_ratio
from ..functions.numerics import corrected_variance, ratio_fits, welch
from .quantiles import medians, percentiles
from .storage import materialised


def channel_factors(df: DataFrame, row: list[str], channel: str, value: str, first: int) -> DataFrame:
    """(channel, factor): the median over rows of first channel / channel, where both are defined; 1 for the first."""
    reference = df.filter(F.col(channel) == first).select(*row, F.col(value).alias("_ref"))
    return medians(df.join(reference, row).select(channel, (F.col("_ref") / F.col(value)).alias("_ratio")), [channel], "_ratio", "factor")


def normalise(df: DataFrame, row: list[str], channel: str, value: str, first: int, name: str = "abundance") -> DataFrame:
    """``df`` with the value times its channel's factor (1 where no row has both)."""
    factors = materialised(channel_factors(df, row, channel, value, first), "factors")  # few: dealt by channel, few tasks would read all rows
    return df.join(factors, channel, "left").withColumn(name, F.col(value) * F.coalesce("factor", F.lit(1.0))).drop("factor")


def grid(df: DataFrame, row: list[str], channel: str, value: str, channels: list[int], of_row: dict[str, Column] | None = None) -> DataFrame:
    """(row, channel, value) of every row in every channel, null where missing: one group per row, no cross join.

    of_row: aggregates of the whole row that come along.
    """
    more = of_row or {}
    found = df.groupBy(*row).agg(F.map_from_entries(F.collect_list(F.struct(channel, value))).alias("_m"), *(c.alias(n) for n, c in more.items()))
    spread = found.select(*row, F.explode(F.array(*map(F.lit, channels))).alias(channel), "_m", *more)
    return spread.select(*row, channel, F.col("_m")[F.col(channel)].alias(value), *more)


def impute_percentile(df: DataFrame, row: list[str], channel: str, value: str, channels: list[int], percent: float = 0.01, least: int = 10) -> DataFrame:
    """The full grid; missing values get their channel's noise, a low percentile of what it has (of ``least`` rows or more)."""
    noise = percentiles(df, [channel], value, {"_noise": percent})
    noise = noise.filter(F.col(channel).isin(channels)).select(channel, F.when(F.col("n") >= least, F.col("_noise")).alias("_noise"))
    full = grid(df, row, channel, value, channels).join(F.broadcast(noise), channel, "left")  # a row for each of ``channels``
    return full.withColumn("imputed", F.col(value).isNull()).withColumn(value, F.coalesce(value, "_noise")).drop("_noise")


def impute_gaussian(df: DataFrame, row: list[str], channel: str, value: str, channels: list[int], spread: float = 0.05, seed: int = 7) -> DataFrame:
    """The full grid; missing values are drawn around their row's mean with a relative spread.

    The draw is from a hash of the cell, so reruns and lost executors give the same numbers.
    """
    full = grid(df, row, channel, value, channels, {"_mean": F.avg(value)})
    uniform = lambda salt: (F.shiftrightunsigned(F.xxhash64(*row, channel, F.lit(seed + salt)), 11) + 1) / float(2**53 + 1)
    normal = F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * math.pi * uniform(1))
    return full.withColumn("imputed", F.col(value).isNull()).withColumn(value, F.coalesce(F.col(value), F.col("_mean") * (1 + spread * normal))).drop("_mean")


def summarise(df: DataFrame, entity: str, row: str, channel: str, value: str, method: str) -> DataFrame:
    """(entity, channel, value) from an entity's rows. method: sum, mean, median, mean_top3, max_sum."""
    exact = F.sum(F.col(value).cast("decimal(28,6)"))
    how = {"sum": exact.cast("double"), "mean": exact.cast("double") / F.count(value), "median": F.median(value)}
    if method in how:
        return df.groupBy(entity, channel).agg(how[method].alias(value))
    if method == "best_score":
        raise NotImplementedError("no definition of a best score for matrix rows")
    per_row = df.groupBy(entity, row).agg((F.median(value) if method == "mean_top3" else exact.cast("double")).alias("_w"))
    at = F.row_number().over(Window.partitionBy(entity).orderBy(F.col("_w").desc(), row))
    chosen = per_row.withColumn("_at", at).filter(F.col("_at") <= (3 if method == "mean_top3" else 1)).select(entity, row)
    return summarise(df.join(chosen, [entity, row]), entity, row, channel, value, "mean")


def median_profile(df: DataFrame, entity: str, row: str, channel: str, value: str) -> DataFrame:
    """(entity, channel, value): the profile of median ratios between an entity's neighbouring channels.

    Ratios are made symmetric around 0 before their median, where a ratio of exactly 1 is left
    out; the profile is their product and is scaled to the highest mean of the three best rows.
    """
    numbered = F.dense_rank().over(Window.partitionBy(entity).orderBy(channel))
    df = materialised(df.select(entity, row, channel, value).withColumn("_i", numbered), "matrix")
    w = Window.partitionBy(entity, row).orderBy("_i")
    moved = symmetric_ratio(F.col(value) / F.col("_before"))
    stepped = df.repartition(entity).withColumn("_before", F.when(F.lag("_i").over(w) == F.col("_i") - 1, F.lag(value).over(w)))
    profile = stepped.groupBy(entity, channel, "_i").agg(from_symmetric_ratio(F.median(F.nullif(moved, F.lit(0.0)))).alias("_r"))
    logs = F.sum(F.log(F.coalesce("_r", F.lit(1.0)))).over(Window.partitionBy(entity).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    profile = materialised(profile.select(entity, channel, F.exp(logs).alias("_p")), "profile")
    top = summarise(df, entity, row, channel, value, "mean_top3")
    peak = top.join(profile, [entity, channel]).groupBy(entity).agg(F.max_by(F.col(value) / F.col("_p"), F.struct(F.col(value), (-F.col(channel)).alias("c"))).alias("_scale"))
    return profile.join(peak, entity).select(entity, channel, (F.col("_p") * F.col("_scale")).alias(value))


def fitted_ratios(df: DataFrame, entity: str, row: str, channel: str, value: str, tasks: int = 512) -> DataFrame:
    """(entity, channel, value) by the least-squares fit of median pair ratios of each entity's matrix.

    Entities are dealt to ``tasks`` groups by a hash, so a group is a batch of small matrices.
    """

    def places(of: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Each x's place, from 0, among the distinct ones of its group (groups are numbered from 0)."""
        values, code = np.unique(x, return_inverse=True)
        pairs, at = np.unique(of * len(values) + code, return_inverse=True)
        return at - np.searchsorted(pairs // len(values), of)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, e = np.unique(pdf[entity].to_numpy(), return_inverse=True)
        r, c, x = places(e, pdf[row].to_numpy()), places(e, pdf[channel].to_numpy()), pdf[value].to_numpy(dtype=np.float64)
        shape = np.zeros((len(ids), 2), dtype=np.int64)
        np.maximum.at(shape, e, np.stack([r, c], axis=1) + 1)
        out, channels = [], pdf[channel].to_numpy()
        shapes, which = np.unique(shape, axis=0, return_inverse=True)
        for k, (height, width) in enumerate(shapes):  # matrices of one shape are fitted at once
            of = np.flatnonzero(which.ravel() == k)
            mine = which.ravel()[e] == k
            at = np.searchsorted(of, e[mine])
            cells = np.full((len(of), height, width), np.nan)
            cells[at, r[mine], c[mine]] = x[mine]
            names = np.empty((len(of), width), dtype=channels.dtype)
            names[at, c[mine]] = channels[mine]
            out.append(pd.DataFrame({entity: np.repeat(ids[of], width), channel: names.ravel(), value: ratio_fits(cells).ravel()}))
        return pd.concat(out)

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (entity, channel))
    dealt = df.select(entity, row, channel, value, F.pmod(F.xxhash64(entity), F.lit(tasks)).alias("_task"))
    return dealt.groupBy("_task").applyInPandas(fit, f"{kinds}, {value} double")


def best_row(df: DataFrame, entity: str, row: str, value: str, count: str) -> DataFrame:
    """(entity, row): the row with most channels, then most matches, then most abundance, then the smallest id."""
    rows = df.groupBy(entity, row).agg(F.count("*").alias("a"), F.sum(count).alias("b"), F.sum(F.col(value).cast("decimal(28,6)")).alias("c"))
    return rows.groupBy(entity).agg(F.max_by(row, F.struct("a", "b", "c", (-F.col(row)).alias("d"))).alias(row))


def extended_stats(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Quartiles (at p (n + 1)), mean, variance, CV, IQR and inner and outer fences of each key."""
    s = df.groupBy(*key).agg(
        F.collect_list(value).alias("_v"), F.count(value).alias("n"), (F.sum(F.col(value).cast("decimal(28,6)")).cast("double") / F.count(value)).alias("mean"), F.var_samp(value).alias("variance"), F.median(value).alias("median")
    )
    s = s.withColumn("q1", legacy_percentile(F.col("_v"), 0.25)).withColumn("q3", legacy_percentile(F.col("_v"), 0.75)).drop("_v")
    iqr = F.col("q3") - F.col("q1")
    s = s.withColumn("iqr", iqr).withColumn("cv", F.when(F.col("mean") != 0, 100 * F.sqrt("variance") / F.col("mean")))
    for name, k in (("inner", 1.5), ("outer", 3.0)):
        s = s.withColumn(f"{name}_low", F.col("q1") - k * F.col("iqr")).withColumn(f"{name}_high", F.col("q3") + k * F.col("iqr"))
    return s


def error_bins(df: DataFrame, abundance: str, spread: str, bins: int) -> DataFrame:
    """(bin, n, log_abundance, spread): median spread over equal-width bins of log10 abundance, the absolute error model."""
    x = F.log10(abundance)
    logs = df.filter((F.col(abundance) > 0) & F.col(spread).isNotNull()).select(x.alias("x"), F.col(spread).alias("s"))
    ends = logs.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    placed = logs.crossJoin(F.broadcast(ends))  # one row
    at = F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)).cast("int")
    binned = materialised(placed.select(at.alias("bin"), "x", "s"), "error-bins")
    means = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("x").alias("log_abundance"))
    return means.join(medians(binned, ["bin"], "s", "spread"), "bin")


def group_ratio(df: DataFrame, key: list[str], group: str, value: str, numerator: int, denominator: int, over: float = 2.0) -> DataFrame:
    """(key, ratio, state): median of one group over the other's; state 1 over, -1 under, 0 between."""
    median = lambda g: F.median(F.when(F.col(group) == g, F.col(value)))
    out = df.groupBy(*key).agg(median(numerator).alias("_a"), median(denominator).alias("_b"))
    out = out.withColumn("ratio", F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.col("_a") / F.col("_b"))).drop("_a", "_b")
    return out.withColumn("state", F.when(F.col("ratio") >= over, 1).when(F.col("ratio") <= 1 / over, -1).when(F.col("ratio").isNotNull(), 0))


def ratio_z(df: DataFrame, value: str = "ratio") -> DataFrame:
    """``df`` with z of the log ratio, against the IQR of all log ratios."""
    logs = df.filter(F.col(value) > 0).withColumn("log_ratio", F.log(value))
    q = percentiles(logs, [], "log_ratio", {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}).drop("n")
    joined = logs.crossJoin(F.broadcast(q))  # one row
    return joined.withColumn("z", (F.col("log_ratio") - F.col("_q2")) / ((F.col("_q3") - F.col("_q1")) / 1.349)).drop("_q1", "_q2", "_q3")


def cauchy_p(z: Column) -> Column:
    """Two-sided p-value of a standard Cauchy variable."""
    return 1 - 2 / math.pi * F.atan(F.abs(z))


def group_t_test(df: DataFrame, key: list[str], group: str, value: str, a: int, b: int, model: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(key, p_value) of Welch's test between two groups; sums are made by Spark, only the tail is numpy.

    model: an absolute error model (log_abundance, spread; one row a bin, so it is small).  With it the test is
    made once more with variances corrected by what the model expects at that abundance, and the larger p-value
    holds.  Groups of fewer than ``least`` values (three at least, with a model) have none.
    """
    of = lambda g: F.when(F.col(group) == g, F.col(value))
    stats = df.groupBy(*key).agg(*(f(of(g)).alias(f"{n}_{s}") for g, s in ((a, "a"), (b, "b")) for f, n in ((F.avg, "mean"), (F.var_samp, "var"), (F.count, "n"))))
    bins = None
    if model is not None:
        rows = sorted((r["log_abundance"], r["spread"]) for r in model.select("log_abundance", "spread").collect() if r["spread"] is not None)
        bins = (np.array([r[0] for r in rows]), np.array([r[1] for r in rows])) if rows else None

    @F.pandas_udf("double")
    def tail(ma: pd.Series, va: pd.Series, na: pd.Series, mb: pd.Series, vb: pd.Series, nb: pd.Series) -> pd.Series:
        ma, va, na, mb, vb, nb = (x.to_numpy(dtype=np.float64) for x in (ma, va, na, mb, vb, nb))
        p = welch(ma, va, na, mb, vb, nb)
        if bins is not None:
            with np.errstate(all="ignore"):
                fold = np.where(ma > mb, ma / mb, mb / ma)
                expected = [np.interp(np.log10(np.maximum(m, 1e-300)), *bins) for m in (ma, mb)]
            corrected = welch(ma, corrected_variance(ma, va, expected[0], fold), na, mb, corrected_variance(mb, vb, expected[1], fold), nb)
            p = np.where(np.isnan(p) | (corrected > p), corrected, p)
        return pd.Series(p)

    enough = max(least, 3) if model is not None else least
    p = tail("mean_a", "var_a", "n_a", "mean_b", "var_b", "n_b")
    return stats.select(*key, F.when((F.col("n_a") >= enough) & (F.col("n_b") >= enough), p).alias("p_value"))


def sample_group_ratio(df: DataFrame, key: list[str], group: str, sample: str, value: str, numerator: int, denominator: int, over: float = 2.0, least: int = 3) -> DataFrame:
    """:func:`group_ratio` over medians of each sample, where every group has ``least`` samples or more; else over all values.

    What decides is the design (which samples a group has), one row for each group.
    """
    design = df.select(group, sample).distinct().filter(F.col(group).isin(numerator, denominator)).groupBy(group).agg(F.count("*").alias("n"))
    fewest = design.agg(F.min("n").alias("n")).head()["n"] or 0
    level = df.groupBy(*key, group, sample).agg(F.median(value).alias(value)) if fewest >= least else df
    return group_ratio(level, key, group, value, numerator, denominator, over)


def biological_profile(df: DataFrame, entity: str, row: str, channel: str, sample: str, value: str) -> DataFrame:
    """(entity, sample, value): the median profile over samples instead of channels.

    A row takes part if one of its samples has two values or more; a sample's values are left out for an
    entity where fewer rows have one than don't.
    """
    medians_of = df.filter(F.col(value).isNotNull()).groupBy(entity, row, sample).agg(F.median(value).alias(value), F.count("*").alias("_n"))
    several = medians_of.groupBy(entity, row).agg(F.max("_n").alias("_most")).filter("_most >= 2").select(entity, row)
    kept = medians_of.join(several, [entity, row]).drop("_n")
    of_sample = kept.groupBy(entity, sample).agg(F.count("*").alias("_d")).join(several.groupBy(entity).agg(F.count("*").alias("_r")), entity)
    enough = of_sample.filter(2 * F.col("_d") >= F.col("_r")).select(entity, sample)
    return median_profile(kept.join(enough, [entity, sample]), entity, row, sample, value)


def label_free(children: DataFrame, channel: str, value: str, method: str = "sum") -> DataFrame:
    """(peptide_key, channel, value, n_ions): features of runs, by master feature (an ion), then by peptide.

    children: (master_id, peptide_id, channel, value, n_matches).  A master feature without a peptide is a peptide of its
    own, keyed by its id behind a minus. method: sum of the ions, or best_ion.
    """
    key = F.when(F.col("peptide_id").isNotNull(), F.col("peptide_id").cast("string")).otherwise(F.concat(F.lit("-"), F.col("master_id").cast("string")))
    ions = children.groupBy(key.alias("peptide_key"), "master_id", channel).agg(F.sum(F.col(value).cast("decimal(28,6)")).alias("_v"), F.sum("n_matches").alias("_m"))
    n = ions.groupBy("peptide_key").agg(F.count_distinct("master_id").alias("n_ions"))
    if method == "best_ion":
        best = best_row(ions.withColumn("_w", F.col("_v")), "peptide_key", "master_id", "_w", "_m")
        ions = ions.join(best, ["peptide_key", "master_id"])
    return ions.groupBy("peptide_key", channel).agg(F.sum("_v").cast("double").alias(value)).join(n, "peptide_key")


def label_channels(ions: DataFrame, tags: dict[str, list[int]], value: str, key: list[str]) -> DataFrame:
    """(key, form, label, value, n): abundances of residue-labelled peptides by label.

    tags: label -> ids of its PTMs; the label with none is that of peptides without any tag. form: the sequence with the
    PTMs that are no tags, so all labels of a peptide share it. ions: (key, sequence, ptm_ids, value).
    """
    every = F.array(*(F.lit(i) for ids in tags.values() for i in ids)).cast("array<int>")
    held = lambda ids: F.exists("ptm_ids", lambda x: x.isin(*ids))
    label = F.coalesce(*(F.when(held(ids), F.lit(t)) for t, ids in tags.items() if ids), F.lit(next((t for t, ids in tags.items() if not ids), None)))
    form = F.concat_ws("%", "sequence", F.transform(F.array_sort(F.array_except("ptm_ids", every)), lambda x: x.cast("string")))
    out = ions.select(*key, form.alias("form"), label.alias("label"), value).filter("label IS NOT NULL")
    return out.groupBy(*key, "form", "label").agg(F.sum(F.col(value).cast("decimal(28,6)")).cast("double").alias(value), F.count("*").alias("n"))


def relative_error_bins(df: DataFrame, abundance: str, ratio: str, bins: int) -> DataFrame:
    """(bin, n, log_abundance, q1, q2, q3): quartiles of log ratios over equal-width bins of log10 abundance, the relative error model."""
    logs = df.filter((F.col(abundance) > 0) & (F.col(ratio) > 0)).select(F.log10(abundance).alias("x"), F.log(ratio).alias("s"))
    ends = logs.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    at = F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)).cast("int")
    binned = materialised(logs.crossJoin(F.broadcast(ends)).select(at.alias("bin"), "x", "s"), "error-bins")  # one row
    quartiles = percentiles(binned, ["bin"], "s", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return quartiles.join(binned.groupBy("bin").agg(F.avg("x").alias("log_abundance")), "bin")


def corrected_purity(df: DataFrame, row: list[str], channel: str, value: str, impurity: np.ndarray) -> DataFrame:
    """Reporter values with the channels' impurities taken out: the inverse of a small matrix (channels by channels)."""
    inverse = np.linalg.inv(impurity.T)
    n = len(inverse)
    filled = grid(df, row, channel, value, list(range(1, n + 1)))
    entries = F.array(*(F.struct(F.lit(i + 1).alias("to"), F.array(*(F.lit(float(k)) for k in inverse[i])).alias("k")) for i in range(n)))
    spread = filled.withColumn("_e", F.explode(entries))
    term = F.col("_e.k")[F.col(channel).cast("int") - 1] * F.coalesce(F.col(value), F.lit(0.0))
    out = spread.groupBy(*row, F.col("_e.to").alias(channel)).agg(F.sum(term).alias("_x"), F.max(F.when(F.col(channel) == F.col("_e.to"), F.col(value).isNotNull())).alias("_has"))
    return out.select(*row, channel, F.when(F.col("_has"), F.greatest("_x", F.lit(0.0))).alias(value))


def reporter_share(df: DataFrame, ion: list[str], value: str, total: str) -> DataFrame:
    """``df`` with the reporter's share of its ion, times the ion's own abundance."""
    all_of = df.groupBy(*ion).agg(F.sum(F.col(value).cast("decimal(28,6)")).cast("double").alias("_all"))
    return df.join(all_of, ion).withColumn("scaled", F.col(value) / F.col("_all") * F.col(total)).drop("_all")


def merged_fractions(df: DataFrame, key: list[str], value: str, method: str) -> DataFrame:
    """One value for each key over the fractions: their sum, or the most intense one."""
    how = F.sum(F.col(value).cast("decimal(28,6)")).cast("double") if method == "sum" else F.max(value)
    return df.groupBy(*key).agg(how.alias(value))
