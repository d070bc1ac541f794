"""Best-fit packing of token sequences by the sum-of-squares rule.

Each document is put where the sum over gaps of (number of open bins with that
gap) squared becomes smallest. Pieces are dealt by length to shares that are
packed apart, so every share has the lengths of the whole; bins left unfilled
are packed once more among each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from agoralens.llm.common import arrow_ready
from agoralens.llm.encode import encoder
from agoralens.operators.windows import count_window
from agoralens.session import materialise

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class SumOfSquares:
    """Bins of one task. `open[g]` lists the open bins with gap g."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.fill: list[int] = []

    def add(self, length: int) -> tuple[int, int]:
        """The bin and the offset for a piece of 1 to `capacity` tokens."""
        gap = self._choice(length)
        if gap == self.capacity:
            bin_ = len(self.fill)
            self.fill.append(0)
        else:
            bin_ = self.open[gap].pop()
            self.count[gap] -= 1
        offset = self.fill[bin_]
        self.fill[bin_] = offset + length
        if gap > length:
            self.open[gap - length].append(bin_)
            self.count[gap - length] += 1
        return bin_, offset

    def _choice(self, length: int) -> int:
        """The gap to use.

        Moving a bin from gap g to gap g - length changes the sum of squares by
        2 * (count[g - length] - count[g] + 1); a bin that becomes full leaves
        the sum. A new bin is opened only if no open one has room. Ties go to
        the smallest gap.
        """
        had = self.count[length:]
        usable = np.flatnonzero(had)
        if not len(usable):
            return self.capacity
        change = 2 * (self.count[usable] - had[usable] + 1)
        if usable[0] == 0:
            change[0] = 1 - 2 * had[0]
        return length + int(usable[np.argmin(change)])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones after a first that may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]] if n else []


def token_pieces(docs: DataFrame, model: str, end_id: int, capacity: int, key: str = "doc_id") -> DataFrame:
    """The pieces of each document, not yet placed."""
    spark = arrow_ready(docs.sparkSession)
    shared, end = spark.sparkContext.broadcast(model), np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value, keep_blank=True)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for i, tokens in zip(ids, encode([t or "" for t in texts])):
                tokens += end
                for k, (s, n) in enumerate(cut(len(tokens) // 4, capacity)):
                    rows.append((i, k, s, n, zlib.crc32(tokens[4 * s : 4 * (s + n)])))
            yield _batch(rows, PIECE_SCHEMA)

    return docs.select(F.col(key).cast("long"), "text").mapInArrow(run, PIECE_SCHEMA)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _packed(pieces: DataFrame, capacity: int, per_share: int, bin_: str, offset: str, filled: str) -> DataFrame:
    """Place the rows, by their column `length`, into bins, about `per_share` rows at a time.

    Of n shares, each takes every n-th row by length. A share with lengths
    drawn at random would lack partners for many of its pieces.
    """
    names, added = pieces.columns, [bin_, offset, filled]
    schema = ", ".join(f"{n} {t}" for n, t in [*pieces.dtypes, *((x, "bigint") for x in added)])
    shares = max(1, -(-pieces.count() // per_share))

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.select(names).sort_by([("length", "descending"), *((n, "ascending") for n in names if n != "length")])
        bins = SumOfSquares(capacity)
        places = np.array([bins.add(n) for n in rows["length"].to_pylist()], dtype=np.int64).reshape(-1, 2)
        fill = np.array(bins.fill, dtype=np.int64)[places[:, 0]]
        for name, values in zip(added, (places[:, 0] + (key[0].as_py() << 40), places[:, 1], fill)):
            rows = rows.append_column(name, pa.array(values))
        return rows

    numbered = count_window(pieces, ["length", *(n for n in names if n != "length")])
    return numbered.groupBy((F.col("position") % shares).alias("share")).applyInArrow(place, schema)


def pack(pieces: DataFrame, capacity: int, per_task: int = 250_000) -> DataFrame:
    """Place pieces of 1 to `capacity` tokens: their columns, sequence_id and offset.

    Pieces are packed in shares of about `per_task`. Bins that are not full are
    packed again among those of other shares, as items of their filled length;
    what was placed in one moves with it. The result depends only on the rows,
    not on their order. Tables without rows give no rows; equal rows are placed
    one by one.
    """
    arrow_ready(pieces.sparkSession)
    pieces = materialise(pieces)
    level = materialise(_packed(pieces, capacity, per_task, "bin", "place", "filled"))
    loose = level.filter(F.col("filled") < capacity).groupBy("bin").agg(F.max("filled").alias("length"))
    loose = materialise(loose)
    again = _packed(loose, capacity, per_task, "sequence", "shift", "filled")
    return level.join(again.select("bin", "sequence", "shift"), "bin", "left").select(
        *pieces.columns,
        F.when(F.col("sequence").isNull(), F.col("bin") * 2).otherwise(F.col("sequence") * 2 + 1).alias("sequence_id"),
        (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def pack_documents(docs: DataFrame, model: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens.

    `docs` needs doc_id and text; other columns are ignored. A null or empty
    text is its end id alone, a document without id keeps a null id, repeated
    rows are packed each. Only documents above `capacity` are cut, the first
    piece being the short one.
    """
    return pack(token_pieces(docs, model, end_id, capacity), capacity)
