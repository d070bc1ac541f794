"""Token ids as grammar-compressed shards (Re-Pair), with random-access decoding.

The file format is a Parquet table with a row per block of consecutive
documents: their ids and token counts, the grammar's rules, the expansion
length of each rule, the compressed sequence, and the token offset of every
`STRIDE`-th symbol. Any span of a block is decoded from those alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from agoralens.llm.common import arrow_ready
from agoralens.llm.encode import encoder

#: Tokens of a block, rules added at once, rounds, least count of a pair, symbols between two stored offsets.
BLOCK, PER_ROUND, ROUNDS, LEAST, STRIDE = 1 << 20, 2048, 6, 32, 1024

_HASH, _BITS = np.uint64(0x9E3779B97F4A7C15), 18


@dataclass
class Grammar:
    """`sequence` over ids and rules; rule r stands for `base + r` and spells the pair `rules[r]`."""

    base: int
    rules: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray

    def symbol_lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), dtype=np.int64)
        rule = symbols >= self.base
        out[rule] = self.lengths[symbols[rule] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that the symbols spell. Rules are spelled once each, in order of age."""
        sizes = self.symbol_lengths(symbols)
        begins = np.concatenate([[0], np.cumsum(self.lengths)])
        spelled = np.zeros(begins[-1], dtype=np.uint32)
        for r, (left, right) in enumerate(self.rules.tolist()):
            at = begins[r]
            for part in (left, right):
                if part < self.base:
                    spelled[at] = part
                    at += 1
                else:
                    n = begins[part - self.base + 1] - begins[part - self.base]
                    spelled[at : at + n] = spelled[begins[part - self.base] : begins[part - self.base + 1]]
                    at += n
        out = np.repeat(symbols.astype(np.uint32), sizes)
        long = sizes > 1
        ends = np.cumsum(sizes)[long]
        n, first = sizes[long], begins[symbols[long] - self.base]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(ends - n, n) + within] = spelled[np.repeat(first, n) + within]
        return out

    def span(self, offsets: np.ndarray, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n, from the stored offsets and only the symbols that cover them."""
        k = max(0, int(np.searchsorted(offsets, start, side="right")) - 1)
        end = int(np.searchsorted(offsets, start + n))
        skip = start - int(offsets[k]) if len(offsets) else 0
        return self.expand(self.sequence[k * STRIDE : end * STRIDE])[skip : skip + n]


def compress(ids: np.ndarray, end_id: int, base: int) -> Grammar:
    """Replace frequent pairs by new symbols, the most frequent of a round first served.

    No pair holds `end_id`, so no symbol crosses documents. Within a run of
    overlapping pairs every second is replaced.
    """
    seq, rules, lengths = ids.astype(np.int64), [], np.zeros(0, dtype=np.int64)
    for _ in range(ROUNDS):
        if len(seq) < 2:
            break
        key = (seq[:-1] << 32) | seq[1:]
        bucket = ((key.view(np.uint64) * _HASH) >> np.uint64(64 - _BITS)).astype(np.int32)
        often = np.bincount(bucket, minlength=1 << _BITS)[bucket] >= LEAST
        ends = seq == end_id
        at = np.flatnonzero(often & ~ends[:-1] & ~ends[1:])
        which, pairs = pd.factorize(key[at])
        count = np.bincount(which, minlength=len(pairs))
        chosen = np.argsort(-count, kind="stable")[:PER_ROUND]
        chosen = chosen[count[chosen] >= LEAST]
        if not len(chosen):
            break
        number = np.full(len(pairs), -1, dtype=np.int64)
        number[chosen] = np.arange(len(chosen)) + base + len(rules)
        at, to = at[number[which] >= 0], number[which]
        to = to[to >= 0]
        run = np.concatenate([[True], np.diff(at) != 1])
        index = np.arange(len(at))
        keep = (index - np.maximum.accumulate(np.where(run, index, 0))) % 2 == 0
        at, to = at[keep], to[keep]
        seq[at] = to
        stays = np.ones(len(seq), dtype=bool)
        stays[at + 1] = False
        seq = seq[stays]
        new = np.stack([pairs[chosen] >> 32, pairs[chosen] & 0xFFFFFFFF], axis=1)
        size = [np.where(new[:, k] < base, 1, lengths[np.maximum(new[:, k] - base, 0)] if len(lengths) else 1) for k in (0, 1)]
        rules += new.tolist()
        lengths = np.concatenate([lengths, size[0] + size[1]])
    return Grammar(base, np.array(rules, dtype=np.int64).reshape(-1, 2), lengths, seq)


BLOCK_SCHEMA = (
    "shard int, block int, doc_ids array<bigint>, n_tokens array<bigint>, base bigint, rules binary, "
    "lengths binary, sequence binary, offsets binary"
)


def _row(shard: int, block: int, docs: list, sizes: list[int], ids: bytes, end_id: int, base: int) -> pa.RecordBatch:
    g = compress(np.frombuffer(ids, dtype="<u4"), end_id, base)
    sizes_of = g.symbol_lengths(g.sequence)
    offsets = (np.cumsum(sizes_of) - sizes_of)[::STRIDE]
    plain = [a.astype(t).tobytes() for a, t in ((g.rules, "<u4"), (g.lengths, "<u4"), (g.sequence, "<u4"), (offsets, "<u8"))]
    values = [
        pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([docs], pa.list_(pa.int64())),
        pa.array([sizes], pa.list_(pa.int64())), pa.array([base], pa.int64()), *(pa.array([p], pa.binary()) for p in plain),
    ]
    return pa.record_batch(values, [f.split()[0] for f in BLOCK_SCHEMA.split(", ")])


def grammar_of(row: dict) -> tuple[Grammar, np.ndarray]:
    """The grammar and the stored offsets of a block."""
    rules, lengths, sequence = (np.frombuffer(row[c], dtype="<u4").astype(np.int64) for c in ("rules", "lengths", "sequence"))
    return Grammar(row["base"], rules.reshape(-1, 2), lengths, sequence), np.frombuffer(row["offsets"], dtype="<u8")


def write_ids(docs: DataFrame, path: str, model: str, end_id: int, base: int) -> None:
    """Encode texts and write shards in ascending order of doc_id.

    `docs` needs doc_id and text. A null or empty text is its end id alone;
    null ids come first; repeated rows are written each. A shard is one range
    of ids, so shards in order are the corpus in order.
    """
    spark = arrow_ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard, block = encoder(shared.value, keep_blank=False), TaskContext.get().partitionId(), 0
        ids, sizes, tokens, held = [], [], [], 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, t in zip(batch.column(0).to_pylist(), encode(texts)):
                ids.append(i)
                tokens += [t, end]
                sizes.append(len(t) // 4 + 1)
                held += sizes[-1]
                if held >= BLOCK:
                    yield _row(shard, block, ids, sizes, b"".join(tokens), end_id, base)
                    ids, sizes, tokens, held, block = [], [], [], 0, block + 1
        if ids:
            yield _row(shard, block, ids, sizes, b"".join(tokens), end_id, base)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def decode(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from its block."""
    arrow_ready(blocks.sparkSession)
    schema = "shard int, block int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                g, offsets = grammar_of(row)
                n = np.array(row["n_tokens"], dtype=np.int64)
                begins = np.cumsum(n) - n
                ids = g.span(offsets, 0, int(n.sum())).astype("<u4")
                crcs = [zlib.crc32(ids[b : b + m]) for b, m in zip(begins.tolist(), n.tolist())]
                same = [pa.array([row[c]] * len(n), pa.int32()) for c in ("shard", "block")]
                yield pa.record_batch(
                    [*same, pa.array(row["doc_ids"], pa.int64()), pa.array(begins), pa.array(n), pa.array(crcs, pa.int64())],
                    ["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    sizes = blocks.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    per_shard = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    first = per_shard.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))
    in_shard = W.partitionBy("shard").orderBy("block")
    starts = sizes.join(first, "shard").select(
        "shard", "block", (F.col("shard_start") + F.sum("n").over(in_shard) - F.col("n")).alias("block_start")
    )
    return blocks.mapInArrow(run, schema).join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )
