"""URL filters: explicit rules, then a path-template tree per host.

Path segments that vary become wildcards, level by level; sibling branches
with like shares of bad pages are merged; shares are smoothed along the tree,
and a page is rejected if that of its template is high.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from agoralens.session import materialise

#: Children that make a level variable, paths of a branch that is split, strength of the branch above, difference of alike branches in standard errors, purity rejected.
CHILDREN, LEAST, STRENGTH, ALIKE, PURITY = 12, 2, 2.0, 2.0, 0.8


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str]], host_: Column, path_: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict. `rules`: (verdict, host/path), a bounded list of the caller's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, start = text.partition("/")
        fits = ((host_ == at) | host_.endswith("." + at)) & path_.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def tree(paths: DataFrame) -> DataFrame:
    """host, path, template, purity of distinct paths with n labelled pages, k of them bad.

    Level by level, paths of one branch go on to its children by their next
    segment. A segment with a digit is a wildcard, and so is every segment below a
    branch with more than CHILDREN different ones. A branch with fewer than LEAST
    paths is not split further; what follows is one wildcard for the rest. So the
    tree ends where paths do, however deep.

    A child's share of bad pages is smoothed towards its parent's, the host's
    towards the share of all, and that towards one half. Children of one parent that don't differ, by a test
    of two samples, are merged: each takes the counts of all of them. Those
    without labelled pages differ from none.
    """
    all_k, all_n = (F.coalesce(F.sum(c), F.lit(0)) for c in "kn")
    prior = paths.agg(_smoothed(all_k, all_n, F.lit(0.5))).head()[0]
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("k").alias("host_k"), F.count("*").alias("paths"))
    hosts = materialise(hosts.select("host", "paths", _smoothed(F.col("host_k"), F.col("host_n"), F.lit(prior)).alias("purity")))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = paths.select("host", "path", "n", "k", segments.alias("segments"), F.lit("").alias("template")).join(hosts, "host")
    level, closed = 0, []
    while True:
        rows = materialise(rows)
        goes_on = (F.size("segments") > level) & (F.col("paths") >= LEAST)
        rest = F.when(F.size("segments") > level, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
        closed.append(rows.filter(~goes_on).select("host", "path", rest.alias("template"), "purity"))
        rows = rows.filter(goes_on)
        if rows.isEmpty():
            break
        segment = F.get("segments", F.lit(level))
        rows = rows.withColumn("child", F.when(segment.rlike("[0-9]"), "*").otherwise(segment))
        named = rows.groupBy("host", "template", "child").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("paths"), F.max("purity").alias("above"))
        many = named.groupBy("host", "template").agg((F.count("*") > CHILDREN).alias("many"))
        named = materialise(named.join(many, ["host", "template"]))
        child = F.when(F.col("many"), "*").otherwise(F.col("child")).alias("to")
        nodes = named.groupBy("host", "template", child).agg(*(F.sum(c).alias(c) for c in ("n", "k", "paths")), F.max("above").alias("above"))
        nodes = _merged(nodes).select("host", "template", "to", "paths", _smoothed(F.col("pool_k"), F.col("pool_n"), F.col("above")).alias("purity"))
        step = materialise(named.select("host", "template", "child", child).join(nodes, ["host", "template", "to"]))
        rows = rows.select("host", "path", "n", "k", "segments", "template", "child").join(step, ["host", "template", "child"])
        rows = rows.select("host", "path", "n", "k", "segments", F.concat("template", F.lit("/"), "to").alias("template"), "paths", "purity")
        level += 1
    return reduce(DataFrame.union, closed)


def _smoothed(bad: Column, n: Column, towards: Column) -> Column:
    return (bad + STRENGTH * towards) / (n + STRENGTH)


def _merged(nodes: DataFrame) -> DataFrame:
    """The nodes with pool_n and pool_k: the counts of all children of the parent that don't differ from the others.

    The window sees the children of one parent, CHILDREN + 1 at most.
    """
    kin = W.partitionBy("host", "template")
    nodes = nodes.withColumns({"kin_n": F.sum("n").over(kin), "kin_k": F.sum("k").over(kin)})
    others_n, others_k, share = F.col("kin_n") - F.col("n"), F.col("kin_k") - F.col("k"), F.col("kin_k") / F.col("kin_n")
    error = F.sqrt(share * (1 - share) * (1 / F.col("n") + 1 / others_n))
    differs = F.when((F.col("n") > 0) & (others_n > 0), F.abs(F.col("k") / F.col("n") - others_k / others_n) > ALIKE * error)
    nodes = nodes.withColumn("alike", ~F.coalesce(differs, F.lit(False)))
    pool = {f"pool_{c}": F.when(F.col("alike"), F.sum(F.when(F.col("alike"), F.col(c)).otherwise(0)).over(kin)).otherwise(F.col(c)) for c in "nk"}
    return nodes.withColumns(pool)


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row.

    `pages` needs page_id and url; other columns are ignored. A null url, or
    one without `://`, has empty host and path. Pages that a rule judges are
    the labelled ones. Every other page has the verdict of its template: blocked
    if the smoothed share of bad pages is PURITY or more. Without any labelled page
    all are allowed. Repeated rows are judged each, and count as pages each; a
    table without rows gives none.
    """
    rows = materialise(pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")))
    distinct = rows.groupBy("host", "path").agg(F.count("*").alias("pages"))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    distinct = materialise(distinct.withColumns({"rule": rule, "ruled": verdict}))
    n = F.when(F.col("ruled").isNotNull(), F.col("pages")).otherwise(0)
    k = F.when(F.col("ruled") == "block", F.col("pages")).otherwise(0)
    found = materialise(tree(distinct.select("host", "path", n.alias("n"), k.alias("k"))))
    method = F.when(F.col("purity") >= PURITY, "block").otherwise("allow")
    judged = found.join(distinct, ["host", "path"]).select("host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
    return rows.join(materialise(judged), ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
