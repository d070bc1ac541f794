"""Merkle manifest of a table: a witness for every row, made by streaming appends.

Rows stand in an order, one tree a group. Blocks of BLOCK rows, aligned in their
tree, are appended leaf by leaf: every open subtree holds what its leaves'
witnesses lack so far, a later sibling adds its digest to those of its run, and
a run that is complete becomes a node above. Blocks are dealt to tasks; their
roots are appended in the same way, and so on, so that no task sees more than
blocks, however many rows a group has.

A witness is an array of strings, one a level, from the leaf up: the digests of
the run that the node stands in, with a point in the node's own place. Replacing
the point by the node's digest gives what its parent is the digest of.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from agoralens.operators.windows import count_window
from agoralens.session import materialise, ship_package

#: Nodes of a run, levels of a block, and leaves of a block.
ARITY = 3
BLOCK_LEVELS = 5
BLOCK = ARITY**BLOCK_LEVELS


def leaf_digest(*fields: Column) -> Column:
    """Digest of the fields: each `-` if null, else its UTF-8 length, a colon and its text."""

    def part(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(part(f) for f in fields)), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and a witness lead to."""
    return F.aggregate(witness, leaf, lambda node, step: F.sha2(F.replace(step, F.lit("."), node), 256))


def proof_digest(witness: Column) -> Column:
    """Digest of all siblings in a witness, level by level, left to right."""
    return F.sha2(F.replace(F.array_join(witness, ""), F.lit("."), F.lit("")), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Append:
    """Leaves appended one by one, each with a witness that grows."""

    def __init__(self, levels: int, arity: int = ARITY):
        #: Of each level the nodes of the open run: digest, first leaf, end, and the step its leaves' witnesses get.
        self.open: list[list[tuple[str, int, int, list[str]]]] = [[] for _ in range(levels + 1)]
        self.witnesses: list[list[str]] = []
        self.levels, self.arity = levels, arity

    def add(self, digest: str) -> None:
        self.witnesses.append([])
        self._node(0, digest, len(self.witnesses) - 1, len(self.witnesses))

    def _node(self, level: int, digest: str, first: int, end: int) -> None:
        run = self.open[level]
        for _, _, _, step in run:
            step.append(digest)
        run.append((digest, first, end, [*(n[0] for n in run), "."]))
        if len(run) == self.arity and level < self.levels:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for _, first, end, step in run:
            text = "".join(step)
            for leaf in range(first, end):
                self.witnesses[leaf].append(text)
        self._node(level + 1, _digest("".join(n[0] for n in run)), run[0][1], run[-1][2])

    def root(self) -> str:
        """Close the runs that are still open, whatever they hold, up to the last level."""
        for level in range(self.levels):
            if self.open[level]:
                self._close(level)
        return self.open[self.levels][0][0]


def levels_of(n: int) -> int:
    """Levels above the leaves of a block in a tree of `n` leaves: all of a small tree, else those of a whole block."""
    levels = 0
    while ARITY**levels < min(n, BLOCK):
        levels += 1
    return levels


def _appended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of tree and position, block by block, with witness and top (the block's root)."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        tree, block = rows["tree"].to_numpy(), rows["position"].to_numpy() // BLOCK
        starts = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (block[1:] != block[:-1])]) if len(rows) else []
        if len(starts) > 1:
            yield from _with_witnesses(rows.slice(0, starts[-1]), starts)
        rest = rows.slice(starts[-1]) if len(starts) else rows
    if rest is not None and len(rest):
        yield from _with_witnesses(rest, np.array([0, len(rest)]))


def _with_witnesses(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    digests, sizes = rows["digest"].to_pylist(), rows["n"].to_pylist()
    witnesses, tops = [], []
    for a, b in zip(starts[:-1], starts[1:]):
        block = Append(levels_of(sizes[a]))
        for digest in digests[a:b]:
            block.add(digest)
        tops += [block.root()] * int(b - a)
        witnesses += block.witnesses
    rows = rows.append_column("witness", pa.array(witnesses, pa.list_(pa.string()))).append_column("top", pa.array(tops, pa.string()))
    yield from rows.combine_chunks().to_batches()


def witnesses(nodes: DataFrame) -> DataFrame:
    """Append the nodes of each tree: all columns, witness and top, the tree's root.

    `nodes` needs tree, n (nodes of the tree), position (from 0 in the tree) and
    digest. Roots of blocks are appended as nodes of a further round; rounds
    grow with the logarithm of the longest tree.
    """
    block = F.expr(f"position div {BLOCK}")
    schema = ", ".join(f"`{name}` {kind}" for name, kind in nodes.dtypes) + ", witness array<string>, top string"
    dealt = nodes.repartition("tree", block).sortWithinPartitions("tree", "position")
    level = materialise(dealt.mapInArrow(_appended, schema))
    above = level.filter(f"n > {BLOCK} and position % {BLOCK} = 0")
    if above.isEmpty():
        return level
    above = above.select("tree", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), block.alias("position"), F.col("top").alias("digest"))
    upper = witnesses(above).select("tree", F.col("position").alias("_block"), F.col("witness").alias("_above"), F.col("top").alias("_top"))
    joined = level.withColumn("_block", block).join(upper, ["tree", "_block"], "left")
    return joined.select(
        *nodes.columns,
        F.concat("witness", F.coalesce("_above", F.array().cast("array<string>"))).alias("witness"),
        F.coalesce("_top", "top").alias("top"),
    )


def manifest(rows: DataFrame, group: str = "source", order: tuple[str, ...] = ("doc_id",), leaf: str = "leaf") -> DataFrame:
    """The columns of `rows` with subroot, root and witness of every row.

    Rows of a group stand by `order`, then by `leaf`; groups by their name. Nulls
    come first in both, so rows without id or group have a place; repeated rows
    are leaves each. A table without rows has no manifest rows. Other columns are
    kept whatever their names, but for subroot, root and witness, which are replaced.
    """
    ship_package(rows.sparkSession)
    names = [c for c in rows.columns if c not in ("subroot", "root", "witness")]
    keyed = rows.select(F.col(group).alias("_group"), *(F.col(c).alias(f"_order{k}") for k, c in enumerate(order)), F.col(leaf).alias("digest"), F.struct(*names).alias("_row"))
    numbered = count_window(keyed, ["_group", *(f"_order{k}" for k in range(len(order))), "digest"]).select("_group", "position", "digest", "_row")
    groups = materialise(numbered.groupBy("_group").agg(F.min("position").alias("start"), F.count("*").alias("n")))
    trees = materialise(count_window(groups, ["start"]).select("_group", "start", "n", F.col("position").alias("tree")))
    leaves = numbered.join(trees, numbered["_group"].eqNullSafe(trees["_group"])).select("tree", "n", (F.col("position") - F.col("start")).alias("position"), "digest", "_row")
    in_tree = materialise(witnesses(leaves).select("tree", "position", "_row", F.col("witness").alias("_below"), F.col("top").alias("subroot")))
    subroots = in_tree.filter("position = 0").select(F.lit(0).cast("long").alias("tree"), F.lit(trees.count()).cast("long").alias("n"), F.col("tree").alias("position"), F.col("subroot").alias("digest"))
    tops = materialise(witnesses(subroots).select(F.col("position").alias("tree"), F.col("witness").alias("_over"), F.col("top").alias("root")))
    return in_tree.join(tops, "tree").select("_row.*", "subroot", "root", F.concat("_below", "_over").alias("witness"))


def verified(rows: DataFrame, leaf: str = "leaf", as_root: str = "folded_root") -> DataFrame:
    """The rows of a manifest with the root that `leaf` folds to, and whether it is the manifest's."""
    return rows.withColumn(as_root, folded(F.col(leaf), F.col("witness"))).withColumn("verified", F.col(as_root) == F.col("root"))
