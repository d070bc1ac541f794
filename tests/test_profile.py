import numpy as np
import pandas as pd
import pytest

from agoralens.operators import profile


@pytest.fixture(scope="module")
def lengths(spark):
    rng = np.random.default_rng(7)
    values = [(0, int(v)) for v in rng.poisson(40, 400)] + [(1, int(v)) for v in rng.poisson(90, 100)]
    values += [(0, 500), (0, 600), (1, 1), (2, 10), (None, 30)]
    return spark.createDataFrame(values, "label int, n_tokens int").cache()


@pytest.fixture(scope="module")
def hist(lengths):
    return profile.histogram(lengths, "n_tokens", "label").cache()


def pandas(lengths):
    return lengths.toPandas()


def test_value_counts_leaves_nulls_out_and_sorts(lengths):
    found = [tuple(r) for r in profile.value_counts(lengths, "label").collect()]
    assert found == [(0, 402), (1, 101), (2, 1)]
    assert profile.distinct_values(lengths, "label").count() == 4


def test_describe_equals_pandas(lengths, hist):
    ours = profile.describe(hist, "n_tokens").first()
    theirs = pandas(lengths)["n_tokens"].describe()
    assert list(ours) == pytest.approx(theirs.tolist())


def test_mean_median_and_quartiles_equal_pandas(lengths, hist):
    groups = pandas(lengths).groupby("label")["n_tokens"]
    for row in profile.mean_median(hist, "n_tokens", "label").dropna().collect():
        group = groups.get_group(row.label)
        assert (row["mean"], row["median"]) == pytest.approx((group.mean(), group.median()))
    for row in profile.quartiles(hist, "n_tokens", "label").dropna().collect():
        group = groups.get_group(row.label)
        assert (row.q1, row.q3) == pytest.approx((group.quantile(0.25), group.quantile(0.75)))


def test_outliers_equal_brute_force(lengths, hist):
    expected = []
    for label, group in pandas(lengths).groupby("label")["n_tokens"]:
        q1, q3 = group.quantile(0.25), group.quantile(0.75)
        far = group[(group < q1 - 1.5 * (q3 - q1)) | (group > q3 + 1.5 * (q3 - q1))]
        expected += [(int(label), int(v)) for v in far]
    found = sorted(tuple(r) for r in profile.iqr_outliers(lengths, "n_tokens", "label").collect())
    assert found == sorted(expected) and len(found) >= 3
    share = {r.label: r for r in profile.outlier_share(hist, "n_tokens", "label").collect()}
    assert {k: v.outliers for k, v in share.items()} == pd.Series([e[0] for e in expected]).value_counts().to_dict()
    assert share[0].max_outlier == 600
    assert share[0].outlier_pct == pytest.approx(share[0].outliers / 402 * 100)
    sizes = {r.label: r.size for r in profile.group_sizes(hist, "label").collect()}
    assert all(r.outliers <= sizes[label] == r.total for label, r in share.items())


def test_whiskers_stay_outside_the_box(hist):
    for row in profile.box_stats(hist, "n_tokens", "label").collect():
        assert row.whisker_low <= row.q1 <= row.median <= row.q3 <= row.whisker_high


def test_single_row_label_has_no_curve_and_densities_integrate_to_the_share(hist):
    rows = profile.density(hist, "n_tokens", "label", points=801, cut=1.0).toPandas()
    assert set(rows["label"].dropna()) == {0, 1}
    for label, share in ((0, 402 / 505), (1, 101 / 505)):
        curve = rows[rows["label"] == label].sort_values("x")
        # The curve of label 0 has a bandwidth of several tokens: what lies below 0 or above the maximum is small.
        assert np.trapezoid(curve["density"], curve["x"]) == pytest.approx(share, rel=0.02)


def test_approximate_quartiles(lengths):
    row = profile.approx_quartiles(lengths, "n_tokens", "label").filter("label = 0").first()
    group = pandas(lengths).query("label == 0")["n_tokens"]
    assert (row.q1, row.q3) == pytest.approx((group.quantile(0.25), group.quantile(0.75)), abs=1)


def test_deviation_of_large_values(spark):
    """The spread is tiny beside the values: sums of squares would lose it."""
    df = spark.createDataFrame([(float(10**9 + k % 3),) for k in range(300)], "v double")
    row = profile.describe(profile.histogram(df, "v"), "v").head()
    assert row["std"] == pytest.approx((200 / 299) ** 0.5, rel=1e-9)
