"""Benchmark decontamination under edit distance, by CGK embedding and LSH.

Texts are words; an item is found in a document if a run of words there is
within `tolerance` times the item's words of edits (insert, delete, replace).
Random walks that read words turn edit distance into Hamming distance: after an
edit, two walks over the same words soon read in step again. A walk starts at
every word of a document and of an item; the words that it puts out at sampled
steps are a key, and equal keys of any of several walks make the item-sized
window that lies so a candidate. An exact edit distance confirms candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from agoralens.llm.common import arrow_ready, gram_hashes, mix, word_hashes

#: Share of an item's words that may be edited, walks, words of a block of items.
TOLERANCE, WALKS, BLOCK_WORDS = 0.2, 6, 200_000
#: Of an item some run of words stays whole, for sure; for runs of 1, 2, 3, and 4 or more words: the steps of a walk that
#: are sampled. A walk moves on at every other step, so its last sample is about where such a run ends.
SAMPLED = {1: (0,), 2: (0, 1, 2), 3: (0, 2, 3, 4, 6), 4: (0, 2, 4, 7, 9)}

_OUTSIDE = np.uint64(1)
_FACTOR, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_BITMAP_BITS = 20
#: Bits of the hash by which a block knows which words its items have.
_WORD_BITS = 22

#: Letters lower-cased, other ASCII than letters and digits as blanks.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(_PLAIN)


def _coins(walk: int, step: int, symbols: np.ndarray) -> np.ndarray:
    """The random bit of each symbol at a step of a walk."""
    seed = np.uint64(2 * ((walk + 1) * 0x9E3779B97F4A7C15 + step * 0xD1B54A32D192ED03) % 2**63 + 1)
    return ((symbols ^ seed) * (seed | np.uint64(1))) >> np.uint64(63)


def keys(words: np.ndarray, ends: np.ndarray, walk: int, classes: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each class the key of the walk from every word, and whether its samples lie before `ends`, the text's end.

    A CGK walk puts out the word at its pointer, and moves on if the word's coin
    of that step says so.
    """
    at = np.arange(len(words))
    out, key = {}, {c: np.full(len(words), c, dtype=np.uint64) for c in classes}
    for step in range(1 + max(SAMPLED[c][-1] for c in classes)):
        symbol = words[np.minimum(at, len(words) - 1)]
        for c in classes:
            if step in SAMPLED[c]:
                key[c] = key[c] * _FACTOR + symbol
                if step == SAMPLED[c][-1]:
                    out[c] = mix(key[c]), at < ends
        at = at + _coins(walk, step, symbol).astype(np.int64)
    return out


def edits(words: np.ndarray, lows: np.ndarray, highs: np.ndarray, items: list[np.ndarray]) -> np.ndarray:
    """Least edits that turn each item into some run of words[low:high]."""
    m = np.array([len(i) for i in items])
    width = int((highs - lows).max(initial=0))
    place = lows[:, None] + np.arange(width)
    segment = np.where(place < highs[:, None], words[np.minimum(place, len(words) - 1)], _OUTSIDE)
    padded = np.zeros((len(items), int(m.max(initial=0))), dtype=np.uint64)
    for k, i in enumerate(items):
        padded[k, : len(i)] = i
    row, best, j = np.zeros((len(items), width + 1), dtype=np.int32), np.zeros(len(items), dtype=np.int32), np.arange(width + 1, dtype=np.int32)
    for i in range(1, padded.shape[1] + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, :-1] + (segment != padded[:, i - 1 : i]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - j, axis=1) + j
        done = m == i
        best[done] = row[done].min(axis=1)
    return best


def _place(words: np.ndarray, items: np.ndarray) -> np.ndarray:
    """A hash of word and item, of _WORD_BITS bits."""
    return ((words ^ (items.astype(np.uint64) * _FACTOR)) * _ODD) >> np.uint64(64 - _WORD_BITS)


@dataclass
class Block:
    """Items of one pass over the documents. `tables`: of a walk and class a bitmap of the keys, the keys in order, item and place of each.
    `holds`: a bitmap of items and their words."""

    ids: list[int]
    words: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    allowed: np.ndarray
    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    holds: np.ndarray

    def possible(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether words[begin:end] has so many words of the item that the others may be edits: each of an item's words
        that stays is a word there."""
        n = np.maximum(end - begin, 0)
        before = np.cumsum(n) - n
        at = np.repeat(begin - before, n) + np.arange(n.sum())
        hits = np.concatenate([[0], np.cumsum(self.holds[_place(words[at], np.repeat(item, n))])])
        return hits[before + n] - hits[before] >= self.sizes[item] - self.allowed[item]

    def candidates(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows and items that share a key; a start may lie before its text."""
        classes = sorted({c for _, c in self.tables})
        starts, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for walk in range(WALKS if len(words) and classes else 0):
            for c, (key, inside) in keys(words, ends, walk, classes).items():
                bitmap, known, item, offset = self.tables[walk, c]
                place = np.flatnonzero(inside & bitmap[key >> np.uint64(64 - _BITMAP_BITS)])
                key = key[place]
                low, high = np.searchsorted(known, key), np.searchsorted(known, key, side="right")
                count = high - low
                k = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                starts.append(np.repeat(place, count) - offset[k])
                items.append(item[k])
        pairs = np.unique(np.stack([np.concatenate(starts), np.concatenate(items)]), axis=1)
        return pairs[0], pairs[1]

    def found(self, words: np.ndarray, of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, item, first word of the window within the text, edits: the best of each text and item."""
        first = np.searchsorted(of, np.arange(texts + 1))
        out = []
        for start, item, text in self._by_text(words, first, first[of + 1]):
            size, allowed, low = self.sizes[item], self.allowed[item], np.maximum(start, first[text])
            begin = np.maximum(start - allowed, first[text])
            end = np.minimum(np.maximum(start, first[text]) + size + allowed, first[text + 1])
            may = self.possible(words, begin, end, item)
            item, text, allowed, low, begin, end = (x[may] for x in (item, text, allowed, low, begin, end))
            cost = edits(words, begin, end, [self.words[self.begins[i] : self.begins[i] + self.sizes[i]] for i in item])
            good = cost <= allowed
            out.append(np.stack([text, item, low - first[text], cost.astype(np.int64)])[:, good])
        rows = np.concatenate(out, axis=1) if out else np.zeros((4, 0), dtype=np.int64)
        rows = rows[:, np.lexsort((rows[2], rows[3], rows[1], rows[0]))]
        best = np.ones(rows.shape[1], dtype=bool)
        best[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
        return tuple(rows[:, best])

    def _by_text(self, words: np.ndarray, first: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Candidate windows in groups of bounded size. Keys lie in the text that the window is cut from."""
        starts, items = self.candidates(words, ends)
        # a start before its text's first word still belongs to the text of its key, which is the one after
        text = np.searchsorted(first, np.maximum(starts, 0), side="right") - 1
        owner = np.minimum(np.searchsorted(first, np.maximum(starts + self.allowed[items], 0), side="right") - 1, len(first) - 2)
        for s, i, t in ((starts, items, text), (starts[owner > text], items[owner > text], owner[owner > text])):
            ok = (t >= 0) & (t < len(first) - 1)
            s, i, t = s[ok], i[ok], t[ok]
            for k in range(0, len(s), 20_000):
                part = slice(k, k + 20_000)
                yield s[part], i[part], t[part]


def block(items: list[tuple[int, str]], tolerance: float) -> Block:
    """Items without words can't be found and are left out."""
    hashed = [(i, word_hashes([normalised(t)])[0]) for i, t in items]
    hashed = [(i, w) for i, w in hashed if len(w)]
    ids, sizes = [i for i, _ in hashed], np.array([len(w) for _, w in hashed], dtype=np.int64)
    words = np.concatenate([w for _, w in hashed]) if hashed else np.zeros(0, np.uint64)
    allowed, begins = (tolerance * sizes).astype(np.int64), np.cumsum(sizes) - sizes
    # Few edits leave few runs, so the keys of an item of few words read less: of one without edits, none reads beyond it.
    whole = np.minimum.reduce([-(-(sizes - allowed) // (allowed + 1)), np.minimum(2 + allowed, max(SAMPLED)), np.maximum(1, sizes - 1)])
    item, offset = np.repeat(np.arange(len(ids)), sizes), np.arange(len(words)) - np.repeat(begins, sizes)
    tables = {}
    for walk in range(WALKS if len(words) else 0):
        for c, (key, inside) in keys(words, np.repeat(begins + sizes, sizes), walk, sorted(set(whole.tolist()))).items():
            chosen = np.flatnonzero(inside & (whole[item] == c))
            chosen = chosen[np.argsort(key[chosen], kind="stable")]
            bitmap = np.zeros(1 << _BITMAP_BITS, dtype=bool)
            bitmap[key[chosen] >> np.uint64(64 - _BITMAP_BITS)] = True
            tables[walk, c] = bitmap, key[chosen], item[chosen], offset[chosen]
    holds = np.zeros(1 << _WORD_BITS, dtype=bool)
    holds[_place(words, item)] = True
    return Block(ids, words, begins, sizes, allowed, tables, holds)


def blocks(items: DataFrame, tolerance: float = TOLERANCE) -> Iterator[Block]:
    """The items in blocks of about BLOCK_WORDS words, dealt by a hash of the id; one block is held at a time."""
    items = items.select("item_id", "text").filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).head()[0] or 0
    n = -(-total // BLOCK_WORDS)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        yield block(sorted((r.item_id, r.text) for r in rows), tolerance)


def _searched(texts: list[str | None], b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, of = word_hashes([normalised(t) for t in texts])
    if not len(words) or not b.ids:
        return tuple(np.zeros((4, 0), dtype=np.int64))
    return b.found(words, of, len(texts))


def leaks(docs: DataFrame, items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, item_id, first_word, edits of every document and item found in it.

    `docs` needs doc_id and text, `items` item_id and text; other columns are
    ignored. Words are compared without case and ASCII punctuation. Null and
    empty texts, and items without words, are found nowhere; a null item id is
    left out, repeated rows of documents are searched each.
    """
    spark = arrow_ready(docs.sparkSession)
    schema = "doc_id bigint, item_id bigint, first_word bigint, edits bigint"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], schema)
    for b in blocks(items, tolerance):
        shared = spark.sparkContext.broadcast(b)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text, item, first, cost = _searched(batch.column(1).to_pylist(), shared.value)
                ids = np.array(shared.value.ids, dtype=np.int64)
                columns = [batch.column(0).take(pa.array(text)), pa.array(ids[item]), pa.array(first), pa.array(cost)]
                yield pa.record_batch(columns, ["doc_id", "item_id", "first_word", "edits"])

        out = out.union(rows.mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of `docs` in which no item is found, all columns as they are. No shuffle."""
    spark = arrow_ready(docs.sparkSession)
    for b in blocks(items, tolerance):
        shared, at = spark.sparkContext.broadcast(b), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[_searched(batch.column(at).to_pylist(), shared.value)[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
