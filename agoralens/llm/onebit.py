"""Nearest neighbours by randomly rotated one-bit codes.

A vector's direction from the centre of its cell is rotated at random and kept as
the signs of its coordinates, with two scalars: its length, and how well the
signs stand for it. From these the inner product with a rotated query is
estimated without bias, with an error bound. Vectors whose bound reaches the
distances found so far are reranked on the original components.

Equal vectors are one entry of the index with their smallest ids, and one query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from agoralens.session import materialise, ship_package

#: Rows of the sample that cells are fitted on, and rows of it per cell at least.
SAMPLE, PER_CELL = 16_384, 32
#: Share of true neighbours in the probed cells, as measured on held-out rows of the sample.
RECALL = 0.98
#: Signs of a code at least, one for each component of longer vectors; width of the error bound in standard deviations.
BITS, WIDTH = 256, 3.0
#: Entries of a block of a cell, queries that are held at once, and pairs that are reranked at once.
BLOCK, QUERIES, PAIRS = 4096, 256, 1 << 15


@dataclass
class Cells:
    """Centres, how many of the nearest a query visits, and the rotation."""

    centres: np.ndarray
    probes: int
    rotation: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        return squared(x, self.centres)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, length, and inner product of the signs with the direction."""
        direction, length = self.turned(x, cell)
        fit = np.abs(direction).sum(axis=1) / np.sqrt(self.rotation.shape[1])
        return np.packbits(direction > 0, axis=1), length, np.where(length > 0, fit, 1.0)

    def turned(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated direction from the centre, and its length; a vector at the centre has direction 0."""
        rest = x - self.centres[cell]
        length = np.sqrt(np.square(rest).sum(axis=1))
        return rest @ self.rotation / np.maximum(length, 1e-300)[:, None], length


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two small matrices."""
    return np.maximum(np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def fit(sample: np.ndarray, n: int, k: int) -> Cells:
    """Cells for `n` vectors from a sample: half of it places the centres, half measures how many must be probed."""
    rng = np.random.default_rng(13)
    half = max(1, len(sample) // 2)
    learn, held = sample[:half], sample[half:] if len(sample) > half else sample
    number = max(1, min(int(np.sqrt(n)), len(learn) // PER_CELL))
    centres = learn[rng.permutation(len(learn))[:number]].copy()
    for _ in range(8):
        nearest = squared(learn, centres).argmin(axis=1)
        sums, count = np.zeros_like(centres), np.bincount(nearest, minlength=number)
        np.add.at(sums, nearest, learn)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    asked = held[:512]
    order = squared(asked, centres).argsort(axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(number)[None, :], axis=1)
    near = squared(asked, held).argsort(axis=1)[:, : k + 1]
    cell_of = squared(held, centres).argmin(axis=1)
    needed = np.sort(np.take_along_axis(place, cell_of[near], axis=1).ravel())
    probes = 1 + int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))])
    dim = sample.shape[1]
    width = max(BITS, -(-dim // 8) * 8)
    return Cells(centres, probes, np.linalg.qr(rng.standard_normal((width, width)))[0][:dim, :])


def usable(embedding: Column) -> Column:
    """Vectors that take part: finite components, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


@dataclass
class Block:
    """A part of a cell: original vectors, smallest id of each, and what the codes hold."""

    vectors: np.ndarray
    first: np.ndarray
    signs: np.ndarray
    length: np.ndarray
    fit: np.ndarray

    def nearest(self, cells: Cells, cell: int, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and distance of the `k` nearest rows of each query, ties to the smaller id."""
        direction, length = cells.turned(queries, np.full(len(queries), cell))
        inner = direction.astype(np.float32) @ self.signs.T / np.sqrt(self.signs.shape[1]) / self.fit
        scale = 2 * length[:, None] * self.length
        about = np.square(length)[:, None] + np.square(self.length) - scale * inner
        bound = WIDTH * np.sqrt(np.maximum(1 - np.square(self.fit), 0) / np.square(self.fit) / (self.signs.shape[1] - 1))
        k = min(k, len(self.vectors))
        first = np.argpartition(about, k - 1, axis=1)[:, :k]
        reach = np.array([np.square(self.vectors[r] - q).sum(axis=1).max() for r, q in zip(first, queries)])
        chosen = about - scale * bound <= reach[:, None] * (1 + 1e-6) + 1e-9
        np.put_along_axis(chosen, first, True, axis=1)
        query, row = np.nonzero(chosen)
        exact = np.concatenate([np.sqrt(np.square(self.vectors[row[a : a + PAIRS]] - queries[query[a : a + PAIRS]]).sum(axis=1)) for a in range(0, len(row), PAIRS)] or [np.zeros(0)])
        order = np.lexsort((self.first[row], exact, query))
        query = query[order]
        best = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[best], row[order[best]], exact[order[best]]


def neighbours(vectors: DataFrame, asked: Column, k: int = 10) -> DataFrame:
    """query, rank, vec_id, score of the `k` nearest others of every row for which `asked` holds.

    `vectors` needs vec_id and embedding, an array of floats or doubles; other
    columns are ignored. Left out are rows without id, vectors that are null or
    zero or have null or non-finite components, and vectors of another length than
    most (of equally frequent lengths the shorter counts). Repeated rows count
    once; rows with the query's id are never its neighbours. Ties stand by vec_id. A
    query without others, and an empty table, give no rows.
    """
    spark = ship_package(vectors.sparkSession)
    schema = "query bigint, rank int, vec_id bigint, score double"
    kind = dict(vectors.dtypes)["embedding"]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(asked, F.lit(False)).alias("asked")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    dim = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    if dim is None:
        return spark.createDataFrame([], schema)
    dim = dim.dim
    rows = rows.filter(F.size("embedding") == dim).withColumn("hash", F.xxhash64("embedding"))

    by_vector = Window.partitionBy("hash", "embedding").orderBy("vec_id")
    smallest = rows.withColumn("nth", F.dense_rank().over(by_vector)).filter(F.col("nth") <= k + 1)
    entries = materialise(smallest.groupBy("hash", "embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")))
    sample = entries.orderBy(F.xxhash64(F.col("ids")[0], F.lit(13)), F.col("ids")[0]).limit(SAMPLE).select("embedding").toArrow()
    cells = fit(matrix(sample["embedding"].combine_chunks(), dim), entries.count(), k)
    shared = spark.sparkContext.broadcast(cells)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)
            cell = np.concatenate([shared.value.distances(x[a : a + 1024]).argmin(axis=1) for a in range(0, len(x), 1024)] or [np.zeros(0, int)]).astype(np.int32)
            signs, length, fitted = shared.value.codes(x, cell)
            code = pa.array([s.tobytes() for s in signs], pa.binary())
            yield pa.record_batch([pa.array(cell), *batch.columns, code, pa.array(length), pa.array(fitted)], ["cell", "hash", "embedding", "ids", "code", "length", "fit"])

    coding = entries.select("hash", "embedding", "ids").mapInArrow(coded, f"cell int, hash bigint, embedding {kind}, ids array<bigint>, code binary, length double, fit double")
    coding = materialise(coding)
    parts = materialise(coding.groupBy("cell").agg(F.expr(f"int((count(*) + {BLOCK - 1}) div {BLOCK})").alias("blocks")))
    blocks = {r.cell: r.blocks for r in parts.collect()}  # a number for each cell

    queries = materialise(rows.filter("asked").select("hash", "embedding").distinct().withColumn("key", F.monotonically_increasing_id()))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(begin, QUERIES)
                order = shared.value.distances(matrix(batch.column(1), dim)).argsort(axis=1)[:, : shared.value.probes]
                to = [(q, c, b) for q, near in enumerate(order.tolist()) for c in near for b in range(blocks.get(c, 0))]
                q, c, b = np.array(to, dtype=np.int64).reshape(-1, 3).T
                yield pa.record_batch([pa.array(c.astype(np.int32)), pa.array(b.astype(np.int32)), *(x.take(pa.array(q)) for x in batch.columns)], ["cell", "block", "key", "embedding"])

    sent = queries.select("key", "embedding").mapInArrow(visits, f"cell int, block int, key bigint, embedding {kind}")
    held = coding.join(parts, "cell").select("cell", F.pmod("hash", "blocks").cast("int").alias("block"), F.lit(None).cast("long").alias("key"), "embedding", "ids", "code", "length", "fit")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in held.dtypes[4:]]
    both = held.union(sent.select("cell", "block", "key", "embedding", *nothing))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, block = None, [], None
        for batch in batches:
            cell, part, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1]), True]) if len(cell) else []
            for a, b in zip(edges[:-1], edges[1:]):
                if (cell[a], part[a]) != at:
                    at, kept, block = (cell[a], part[a]), [], None
                if not asks[a]:
                    kept.append(batch.slice(a, b - a))
                    continue
                if block is None and kept:
                    block, ids = _block(pa.Table.from_batches(kept).combine_chunks(), dim)
                for begin in range(a, b if kept else a, QUERIES):
                    some = batch.slice(begin, min(QUERIES, b - begin))
                    query, row, distance = block.nearest(shared.value, int(cell[a]), matrix(some.column(3), dim), k + 1)
                    yield pa.record_batch([some.column(2).take(pa.array(query)), ids.take(pa.array(row)), pa.array(distance)], ["key", "ids", "score"])

    dealt = both.repartition("cell", "block").sortWithinPartitions("cell", "block", F.col("key").isNotNull())
    found = dealt.mapInArrow(searched, "key bigint, ids array<bigint>, score double")
    by_distance = Window.partitionBy("key").orderBy("score", F.col("ids")[0])
    best = found.withColumn("nth", F.row_number().over(by_distance)).filter(F.col("nth") <= k + 1)
    lists = best.groupBy("key").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct("score", i.alias("vec_id"))))).alias("near"))
    ordered = lists.select("key", F.slice(F.array_sort("near"), 1, k + 1).alias("near"))
    answers = queries.join(ordered, "key").select("hash", "embedding", "near")
    asked_rows = rows.filter("asked").select("vec_id", "hash", "embedding").distinct()
    joined = asked_rows.join(answers, ["hash", "embedding"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    return joined.select(F.col("vec_id").alias("query"), F.posexplode(others).alias("nth", "other")).select("query", (F.col("nth") + 1).cast("int").alias("rank"), "other.vec_id", "other.score")


def _block(rows: pa.Table, dim: int) -> tuple[Block, pa.Array]:
    column = {name: rows[name].combine_chunks() for name in ("embedding", "ids", "code", "length", "fit")}
    codes = np.frombuffer(b"".join(column["code"].to_pylist()), dtype=np.uint8).reshape(len(rows), -1)
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    first = np.array([i[0] for i in column["ids"].to_pylist()], dtype=np.int64)
    return Block(matrix(column["embedding"], dim), first, signs, column["length"].to_numpy(), column["fit"].to_numpy()), column["ids"]
