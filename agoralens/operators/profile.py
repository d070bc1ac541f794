"""Distribution of a whole-number measure (tokens per post), by label.

Everything but the outlier rows is computed from one histogram
(label, value, n): the corpus is scanned once with a map-side count, and what
follows works on as many rows as there are distinct values. A label that holds
most of the corpus is therefore no heavier than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from agoralens.operators.filters import outside
from agoralens.session import materialise

# Quartiles, whisker length and the upper quantile of the plot range.
FIRST_QUARTILE = 0.25
THIRD_QUARTILE = 0.75
WHISKER = 1.5
PLOT_QUANTILE = 0.99


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first, nulls left out."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def histogram(df: DataFrame, value: str, label: str | None = None) -> DataFrame:
    keys = [label, value] if label else [value]
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))


def quantile(value: str, p: float) -> Column:
    """Exact, interpolated quantile of a histogram."""
    return F.expr(f"percentile({value}, {p}D, n)")


def _mean(value: str) -> Column:
    return F.sum(F.col(value).cast("double") * F.col("n")) / F.sum("n")


def _centred(hist: DataFrame, value: str) -> DataFrame:
    """The histogram with `_off`, how far a value lies from the mean of all: sums of its squares don't cancel where values are large."""
    return hist.withColumn("_off", F.col(value).cast("double") - hist.agg(_mean(value)).scalar())


def _std() -> Column:
    """Sample standard deviation of a centred histogram; null for a single row."""
    v, n = F.col("_off"), F.col("n")
    total, squares = F.sum(v * n), F.sum(v * v * n)
    rest = F.greatest(squares - total * total / F.sum("n"), F.lit(0.0))
    return F.sqrt(F.try_divide(rest, F.sum("n") - 1))


def describe(hist: DataFrame, value: str) -> DataFrame:
    return _centred(hist, value).agg(
        F.sum("n").alias("count"),
        _mean(value).alias("mean"),
        _std().alias("std"),
        F.min(value).alias("min"),
        quantile(value, 0.25).alias("q25"),
        quantile(value, 0.5).alias("q50"),
        quantile(value, 0.75).alias("q75"),
        F.max(value).alias("max"),
    )


def mean_median(hist: DataFrame, value: str, label: str) -> DataFrame:
    return hist.groupBy(label).agg(_mean(value).alias("mean"), quantile(value, 0.5).alias("median"))


def group_sizes(hist: DataFrame, label: str) -> DataFrame:
    return hist.groupBy(label).agg(F.sum("n").alias("size"))


def quartiles(hist: DataFrame, value: str, label: str) -> DataFrame:
    """Quartiles, inter-quartile range and the outlier bounds per label."""
    q1, q3 = quantile(value, FIRST_QUARTILE), quantile(value, THIRD_QUARTILE)
    per_label = hist.groupBy(label).agg(q1.alias("q1"), q3.alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return per_label.select(
        label,
        "q1",
        "q3",
        iqr.alias("iqr"),
        (F.col("q1") - WHISKER * iqr).alias("lower_bound"),
        (F.col("q3") + WHISKER * iqr).alias("upper_bound"),
    )


def approx_quartiles(df: DataFrame, value: str, label: str, accuracy: int = 10_000) -> DataFrame:
    """For continuous measures, whose histogram would be as long as the data."""
    q = F.percentile_approx(value, [FIRST_QUARTILE, THIRD_QUARTILE], accuracy)
    return df.groupBy(label).agg(q.alias("q")).select(label, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))


def global_quantile(hist: DataFrame, value: str, p: float = PLOT_QUANTILE) -> DataFrame:
    return hist.agg(quantile(value, p).alias("quantile"))


def iqr_outliers(df: DataFrame, value: str, label: str) -> DataFrame:
    """Rows outside the bounds of their label.

    The bounds, one row per label, are written first. The join then sees their
    real size: few labels are broadcast, very many are shuffled. `df` is read
    twice, so give it a written frame without the texts.
    """
    bounds = materialise(quartiles(histogram(df, value, label), value, label).select(label, "lower_bound", "upper_bound"))
    joined = df.join(bounds, label)
    is_outlier = outside(F.col(value), F.col("lower_bound"), F.col("upper_bound"))
    return joined.filter(is_outlier).select(*df.columns)


def outlier_share(hist: DataFrame, value: str, label: str) -> DataFrame:
    """Count, share and largest outlier of every label that has outliers."""
    is_outlier = outside(F.col(value), F.col("lower_bound"), F.col("upper_bound"))
    return (
        hist.join(quartiles(hist, value, label), label)
        .groupBy(label)
        .agg(
            F.sum(F.when(is_outlier, F.col("n")).otherwise(0)).alias("outliers"),
            F.sum("n").alias("total"),
            F.max(F.when(is_outlier, F.col(value))).alias("max_outlier"),
        )
        .filter("outliers > 0")
        .withColumn("outlier_pct", F.col("outliers") / F.col("total") * 100)
    )


def box_stats(hist: DataFrame, value: str, label: str) -> DataFrame:
    """Box and whiskers without fliers: a whisker ends at the last value within
    its bound, and never inside the box."""
    v = F.col(value)
    return (
        hist.join(quartiles(hist, value, label), label)
        .groupBy(label)
        .agg(
            F.first("q1").alias("q1"),
            quantile(value, 0.5).alias("median"),
            F.first("q3").alias("q3"),
            F.min(F.when(v >= F.col("lower_bound"), v)).alias("low"),
            F.max(F.when(v <= F.col("upper_bound"), v)).alias("high"),
        )
        .select(
            label,
            "q1",
            "median",
            "q3",
            F.least("low", "q1").alias("whisker_low"),
            F.greatest("high", "q3").alias("whisker_high"),
        )
    )


def density(hist: DataFrame, value: str, label: str, points: int = 51, cut: float = PLOT_QUANTILE) -> DataFrame:
    """Gaussian kernel density per label on a grid from 0 to the cut quantile.

    The bandwidth is std * n^(-1/5) of the label and each curve is scaled by
    the label's share of all rows. Labels without spread have no curve. The
    work is (distinct values) x (grid points), whatever the number of rows.
    """
    per_label = _centred(hist, value).groupBy(label).agg(F.sum("n").alias("size"), _std().alias("std"))
    # Scalar subqueries: one number each, so nothing is joined.
    overall = hist.agg(quantile(value, cut).alias("top"), F.sum("n").alias("rows"))
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    spread = F.col("std") * F.pow(F.col("size").cast("double"), F.lit(-0.2))
    top = overall.select("top").scalar()
    rows = overall.select("rows").scalar()
    z = (F.col("x") - F.col(value)) / F.col("bandwidth")
    return (
        hist.join(per_label.filter("std > 0").select(label, spread.alias("bandwidth")), label)
        .select(label, value, "n", "bandwidth", step.alias("i"), top.alias("top"), rows.alias("rows"))
        .withColumn("x", F.col("top") * F.col("i") / (points - 1))
        .groupBy(label, "i", "x")
        .agg(
            (
                F.sum(F.col("n") * F.exp(-0.5 * z * z) / F.col("bandwidth"))
                / (F.first("rows") * F.sqrt(2 * F.pi()))
            ).alias("density")
        )
    )
