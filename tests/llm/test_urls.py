"""The method of the URL filter by itself: it blocks and allows pages that no rule judges."""

import random

import duckdb
import pandas as pd
import pytest

from agoralens.llm import sql, url_templates as ut

RULES = [("block", "shop.org/spam/"), ("allow", "shop.org/news/"), ("block", "bad.net/"), ("allow", "good.net/"), ("block", "mix.net/a/x/"), ("allow", "mix.net/a/y/"), ("block", "mix.net/b/")]


def judged(spark, urls):
    pages = spark.createDataFrame([(k, u, 1, "t") for k, u in enumerate(urls)], "page_id bigint, url string, n int, template string")
    return {r.page_id: r for r in ut.judge(pages, RULES).collect()}


def test_method_blocks_and_allows_pages_without_a_rule(spark):
    """Unlabelled branches take the share of the branch above, or of siblings that don't differ."""
    urls = [f"http://shop.org/spam/{k}" for k in range(30)] + [f"http://shop.org/news/{k}" for k in range(30)]
    urls += [f"http://mix.net/a/x/{k}" for k in range(40)] + [f"http://mix.net/a/y/{k}" for k in range(40)] + [f"http://mix.net/b/{k}" for k in range(200)]
    asked = ["http://shop.org/other/1", "http://mix.net/a/z/1", "http://mix.net/c/1", "http://mix.net/c/2", "http://new.org/x"]
    got = judged(spark, urls + asked)
    other, z, c1, c2, new = (got[len(urls) + k] for k in range(len(asked)))
    assert all(r.rule is None for r in (other, z, c1, c2, new))
    assert (other.verdict, z.verdict, new.verdict) == ("allow", "allow", "allow")
    assert 0.3 < other.purity < 0.7 and 0.3 < z.purity < 0.7
    # The host is bad for the most part, and its labelled children differ from each other.
    assert c1.verdict == c2.verdict == "block" and c1.purity > ut.PURITY


def test_unlabelled_siblings_of_bad_branches_are_blocked(spark):
    rules = [("block", "x.net/es/"), ("block", "x.net/fr/"), ("allow", "y.net/es/")]
    urls = [f"http://x.net/{lang}/{k}" for lang in ("es", "fr", "de") for k in range(20)] + [f"http://y.net/{lang}/{k}" for lang in ("es", "de") for k in range(20)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {urls[r.page_id]: r for r in ut.judge(pages, rules).collect()}
    assert {got[u].verdict for u in urls if "x.net" in u} == {"block"}
    assert {got[u].verdict for u in urls if "y.net" in u} == {"allow"}
    assert got["http://x.net/de/3"].template == "/de/*" and got["http://x.net/de/3"].rule is None


def test_merging_needs_likeness(spark):
    """A good branch among bad ones keeps its own counts; alike ones share theirs."""
    rules = [("block", "h.net/a/"), ("block", "h.net/b/"), ("allow", "h.net/good/")]
    urls = [f"http://h.net/a/{k}" for k in range(40)] + ["http://h.net/b/1"] + [f"http://h.net/good/{k}" for k in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {urls[r.page_id]: r.purity for r in ut.judge(pages, rules).collect()}
    above = (41 + 2 * 42 / 83) / (81 + 2)
    assert got["http://h.net/good/1"] < 0.1 and got["http://h.net/a/1"] > 0.9
    assert got["http://h.net/b/1"] == pytest.approx((1 + 2 * above) / 3, abs=1e-6)  # one page: it differs from neither half


def test_whole_depth_and_pruning(spark):
    deep = "/a/b/c/d/e/f"
    urls = [f"http://bad.net{deep}/{k}" for k in range(5)] + ["http://bad.net/a/b/c/q/r/s"] + ["http://bad.net/only/one/here"]
    got = judged(spark, urls)
    assert got[0].template == f"{deep}/*" and got[5].template == "/a/b/c/q/**" and got[6].template == "/only/**"


def test_many_children_are_one(spark):
    words = [chr(97 + a) + chr(97 + b) for a in range(4) for b in range(4)]
    got = judged(spark, [f"http://bad.net/u/{w}/page" for w in words] + ["http://bad.net/v/aa/page", "http://bad.net/v/ab/page"])
    assert {got[k].template for k in range(16)} == {"/u/*/page"} and got[16].template == "/v/aa/**"


def test_nulls_repeats_and_no_rows(spark):
    got = judged(spark, [None, "x", "http://bad.net/a", "http://bad.net/a", "http://bad.net"])
    assert [got[k].host for k in range(5)] == ["", "", "bad.net", "bad.net", "bad.net"] and got[2].template == got[3].template
    assert got[0].verdict == "allow" and got[4].verdict == "block" and got[4].rule is None
    assert judged(spark, []) == {}


@pytest.mark.parametrize("seed", range(3))
def test_equals_sql(spark, seed):
    rng = random.Random(seed)
    hosts, words = ["shop.org", "a.mix.net", "mix.net", "bad.net", "free.org"], ["a", "b", "c", "x", "y", "z", "spam", "news", "1", "v2", *(f"w{c}" for c in "abcdefghijklmnop")]
    urls = [f"http://{rng.choice(hosts)}/" + "/".join(rng.choice(words[: rng.choice([3, 6, 10, 26])]) for _ in range(rng.randrange(0, 6))) for _ in range(500)]
    rows = list(enumerate(urls + urls[:40] + [None, "none"]))
    pages = pd.DataFrame(rows, columns=["page_id", "url"])
    query = sql.url_filter(RULES, 6, ut.CHILDREN, ut.LEAST, ut.STRENGTH, ut.ALIKE, ut.PURITY)
    want = {r[0]: r for r in duckdb.sql(query).select("page_id, host, path, rule, verdict, template, purity").fetchall()}
    got = {r.page_id: tuple(r) for r in ut.judge(spark.createDataFrame(rows, "page_id bigint, url string"), RULES).collect()}
    assert len(got) == len(pages) and {k: v[:6] for k, v in got.items()} == {k: v[:6] for k, v in want.items()}
    assert all(got[k][6] == pytest.approx(want[k][6], abs=1e-6) for k in got)
    assert {v[4] for v in got.values() if v[3] is None} == {"block", "allow"}
