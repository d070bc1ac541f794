"""Ranked lexical search with the roles reversed: items are indexed, documents are streamed.

An inverted index over the terms of the items is broadcast, a block of bounded
size at a time. Every document's counts of those terms stream through it once to
be counted and once to be scored; a task keeps the best documents of each item
in a bounded heap, and the heaps are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from agoralens.llm.common import run_hashes
from agoralens.session import materialise, ship_package

# A term's characters, the weight's scale, and the constants of saturation.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCALE, GAIN, DAMP, BASE, SLOPE = 1000, 1_000_000_000, 8, 10, 90

#: Postings of a block of items; every block is one more pass over the documents.
BLOCK_POSTINGS = 1 << 20
#: Bytes of text that are cut at once, and scores that are held at once.
SEGMENT, SCORES = 2 << 20, 1 << 22
_BITMAP_BITS = 20

_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_OUTSIDE = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

def cut(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and 64-bit hash of the terms in lower-cased UTF-8; a hash depends on the term alone."""
    a = np.frombuffer(data, dtype=np.uint8)
    inside = _IN_TERM[a]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edge[0::2], edge[1::2] - edge[0::2]
    return starts, lengths, run_hashes(a[inside], lengths)


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Stretches of about SEGMENT bytes that end between terms, each with its start."""
    start = 0
    while start < len(data):
        end = start + SEGMENT
        if end < len(data):
            outside = _OUTSIDE.search(data, end)
            end = outside.start() if outside else len(data)
        yield start, data[start:end]
        start = end


@dataclass
class Index:
    """Inverted index of a block of items. Term t is in items[firsts[t]:firsts[t + 1]]."""

    ids: list[int | None]
    hashes: np.ndarray
    lengths: np.ndarray
    firsts: np.ndarray
    items: np.ndarray
    bitmap: np.ndarray

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text, and of the indexed ones: text, term, occurrences."""
        data = b"\n".join(t.lower() for t in texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        total, keys, often = np.zeros(len(texts), dtype=np.int64), [], []
        for begin, part in segments(data):
            starts, lengths, hashes = cut(part)
            of = np.searchsorted(ends, starts + begin, side="right")
            total += np.bincount(of, minlength=len(texts))
            maybe = np.flatnonzero(self.bitmap[hashes >> np.uint64(64 - _BITMAP_BITS)])
            term = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            same = (self.hashes[term] == hashes[maybe]) & (self.lengths[term] == lengths[maybe])
            key, n = np.unique(of[maybe[same]] * len(self.hashes) + term[same], return_counts=True)
            keys.append(key)
            often.append(n)
        if not keys:
            return total, *np.zeros((3, 0), dtype=np.int64)
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(key), dtype=np.int64)
        np.add.at(n, at, np.concatenate(often))
        return total, key // len(self.hashes), key % len(self.hashes), n


def index(items: list[tuple[int | None, str]]) -> Index:
    """Index of the items' terms, each counted once an item; items without a term are in no list."""
    postings: dict[bytes, list[int]] = {}
    for k, (_, text) in enumerate(items):
        for term in {t.encode().lower() for t in TERM.findall(text)}:
            postings.setdefault(term, []).append(k)
    terms = list(postings)
    hashes = np.array([cut(t)[2][0] for t in terms], dtype=np.uint64)
    order = np.argsort(hashes)
    bitmap = np.zeros(1 << _BITMAP_BITS, dtype=bool)
    bitmap[hashes >> np.uint64(64 - _BITMAP_BITS)] = True
    lists = [postings[terms[k]] for k in order]
    firsts = np.cumsum([0, *(len(x) for x in lists)])
    flat = np.concatenate([np.array(x) for x in lists]) if lists else np.zeros(0, np.int64)
    lengths = np.array([len(terms[k]) for k in order], dtype=np.int64)
    return Index([i for i, _ in items], hashes[order], lengths, firsts, flat, bitmap)


def blocks(items: DataFrame) -> Iterator[Index]:
    """Indexes of blocks of items, dealt by a hash; the driver holds one at a time."""
    items = items.select("item_id", "text").filter("text is not null")
    most = F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    n = -(-(items.agg(F.sum(most)).head()[0] or 0) // BLOCK_POSTINGS)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        found = index([(r.item_id, r.text) for r in rows])
        if len(found.hashes):
            yield found


class Heaps:
    """The best `k` documents of each item: by score, then by the smaller id; a null id comes last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.id, self.null = np.zeros((4, 0), dtype=np.int64)
        self.least, self.last = np.zeros(items, dtype=np.int64), np.full(items, np.iinfo(np.int64).max)

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Scores of items (rows) and documents (columns)."""
        better = (scores > self.least[:, None]) | ((scores == self.least[:, None]) & (scores > 0) & (ids[None, :] < self.last[:, None]))
        item, doc = np.nonzero(better)
        if not len(item):
            return
        all_ = [np.concatenate(x) for x in ((self.item, item), (self.score, scores[item, doc]), (self.id, ids[doc]), (self.null, null[doc]))]
        order = np.lexsort((all_[2], all_[3], -all_[1], all_[0]))
        item = all_[0][order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.k]
        self.item, self.score, self.id, self.null = (x[order] for x in all_)
        full = rank[rank < self.k] == self.k - 1
        self.least[self.item[full]], self.last[self.item[full]] = self.score[full], self.id[full]


def score(found: Index, weights: np.ndarray, n_docs: int, n_terms: int, batches: Iterator[pa.RecordBatch], k: int) -> Heaps:
    """Stream documents (doc_id, n, terms, tfs) through the index into heaps."""
    heaps = Heaps(len(found.ids), k)
    step = max(16, SCORES // len(found.ids))
    for whole in batches:
        for begin in range(0, whole.num_rows, step):
            batch = whole.slice(begin, step)
            ids, null = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            damp = np.array([BASE + SLOPE * n * n_docs // n_terms for n in batch.column(1).to_pylist()], dtype=np.int64)
            sizes = batch.column(2).value_lengths().to_numpy()
            doc, term, tf = np.repeat(np.arange(len(ids)), sizes), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
            gain = weights[term] * (GAIN * tf // (SCALE * tf + DAMP * damp[doc]))
            order = np.argsort(term, kind="stable")
            doc, term, gain = doc[order], term[order], gain[order]
            scores = np.zeros((len(found.ids), len(ids)), dtype=np.int64)
            edges = np.flatnonzero(np.r_[True, term[1:] != term[:-1], True]) if len(term) else []
            for a, b in zip(edges[:-1], edges[1:]):
                items = found.items[found.firsts[term[a]] : found.firsts[term[a] + 1]]
                scores[items[:, None], doc[a:b]] += gain[a:b]
            heaps.offer(scores, ids, null)
    return heaps


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the `k` best documents of each item.

    `docs` needs doc_id and text, `items` item_id and text; other columns are
    ignored. Null and empty texts, and texts without a term, have no score and
    count in no statistic; items without a term have no rows. Equal scores stand
    by ascending doc_id, a null id last; repeated documents are ranked each. Every
    row of `items` is an item, also where ids are null or repeated. Empty tables
    give no rows.
    """
    spark = ship_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for found in blocks(items):
        shared = spark.sparkContext.broadcast(found)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total, doc, term, tf = shared.value.counts(batch.column(1).to_pylist())
                some = np.flatnonzero(total)
                offsets = pa.array(np.r_[np.searchsorted(doc, some), len(doc)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.record_batch([batch.column(0).take(pa.array(some)), pa.array(total[some]), *lists], ["doc_id", "n", "terms", "tfs"])

        counted = materialise(texts.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, tfs array<int>"))
        n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).head()
        if not n_docs:
            continue
        holding = np.zeros(len(found.hashes), dtype=np.int64)
        for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            holding[term] = df
        weights = np.array([floor(SCALE * log((2 * n_docs + 2) / (2 * df + 1))) for df in holding.tolist()], dtype=np.int64)
        weighted = spark.sparkContext.broadcast(weights)

        def best(batches: Iterator[pa.RecordBatch], shared=shared, weighted=weighted, n_docs=n_docs, n_terms=n_terms) -> Iterator[pa.RecordBatch]:
            h = score(shared.value, weighted.value, n_docs, n_terms, batches, k)
            ids = pa.array(shared.value.ids, pa.int64()).take(pa.array(h.item))
            yield pa.record_batch([pa.array(h.item), ids, pa.array(h.id, mask=h.null.astype(bool)), pa.array(h.score)], ["item", "item_id", "doc_id", "score"])

        heaps = counted.mapInArrow(best, "item bigint, item_id bigint, doc_id bigint, score bigint")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        out = out.union(heaps.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    return out
