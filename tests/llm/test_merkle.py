"""Manifest against a tree built level by level."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from agoralens.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """Root and, for each leaf, its siblings level by level, of a tree whose last runs may be short."""
    level, members, proofs = list(leaves), [[k] for k in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        runs = range(0, len(level), 3)
        for a in runs:
            for k in range(a, min(a + 3, len(level))):
                for leaf in members[k]:
                    proofs[leaf].append((level[a:k], level[k + 1 : a + 3]))
        members = [sum(members[a : a + 3], []) for a in runs]
        level = [h("".join(level[a : a + 3])) for a in runs]
    return level[0], proofs


def expected(rows):
    """By (source, doc_id, leaf): subroot, root, siblings."""
    groups = {}
    for source, doc_id, leaf in rows:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, over = tree([trees[s][0] for s in order])
    out = {}
    for n, s in enumerate(order):
        for (has_id, doc_id, leaf), below in zip(sorted(groups[s]), trees[s][1]):
            out.setdefault((s, doc_id if has_id else None, leaf), (trees[s][0], root, "".join(x for before, after in below + over[n] for x in before + after)))
    return out


def rows_of(spark, rows):
    return spark.createDataFrame([(s, i, leaf, "x", 1) for s, i, leaf in rows], "source string, doc_id bigint, leaf string, root string, position int")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 243, 244, 245, 730, 2000])
def test_append_gives_the_tree(n):
    leaves = [h(str(k)) for k in range(n)]
    if n <= merkle.BLOCK:
        block = merkle.Append(merkle.levels_of(n))
        for leaf in leaves:
            block.add(leaf)
        root, proofs = tree(leaves)
        assert block.root() == root
        assert block.witnesses == [["".join([*before, ".", *after]) for before, after in p] for p in proofs]


def test_manifest_equals_plain_trees(spark):
    """A hot source of several blocks, one of exactly a block, small ones, a null one, repeated ids and null ids."""
    rng = random.Random(5)
    sizes = {"hot": 800, "whole": 243, "over": 244, "one": 1, "zwei": 2, "ä": 4, None: 5}
    rows = [(s, rng.randrange(10**6) * 1000 + k, h(f"{s} {k}")) for s, n in sizes.items() for k in range(n)]
    rows += [("hot", rows[0][1], h("same id")), ("hot", None, h("no id")), ("one", rows[-1][1], h("x"))]
    rng.shuffle(rows)
    want = expected(rows)
    m = merkle.manifest(rows_of(spark, rows))
    assert m.columns == ["source", "doc_id", "leaf", "position", "subroot", "root", "witness"]
    got = merkle.verified(m).withColumn("siblings", F.replace(F.array_join("witness", ""), F.lit("."), F.lit(""))).withColumn("proof", merkle.proof_digest(F.col("witness"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.subroot, r.root, r.siblings) == want[r.source, r.doc_id, r.leaf]
        assert r.proof == h(r.siblings) and r.verified and r.folded_root == r.root


def test_tampering_is_found(spark):
    rows = [("a", k, h(str(k))) for k in range(300)]
    m = merkle.manifest(rows_of(spark, rows)).withColumn("leaf", F.when(F.col("doc_id") % 7 == 0, F.sha2("leaf", 256)).otherwise(F.col("leaf")))
    assert all(r.verified == (r.doc_id % 7 != 0) for r in merkle.verified(m).collect())


def test_repeated_rows_nulls_and_no_rows(spark):
    got = merkle.manifest(rows_of(spark, [("a", 1, h("x"))] * 4)).collect()
    root, proofs = tree([h("x")] * 4)
    assert [r.subroot for r in got] == [root] * 4 and {r.root for r in got} == {root}
    alone = merkle.manifest(rows_of(spark, [(None, None, h("x"))])).collect()
    assert [(r.subroot, r.root, r.witness) for r in alone] == [(h("x"), h("x"), [])]
    assert merkle.manifest(rows_of(spark, [])).count() == 0


def test_leaf_digest_of_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(7, None, "ä\n"), (None, "", "y" * 300_000)], "a bigint, b string, c string")
    got = [r[0] for r in df.select(merkle.leaf_digest(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [h("1:7-3:ä\n"), h("-0:300000:" + "y" * 300_000)]
