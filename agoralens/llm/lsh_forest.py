"""Near-duplicate documents by an LSH forest over MinHash signatures.

A signature is sorted under several orders, each starting at other values.
Documents next to each other in an order share its longest prefixes, so the
prefix depth adapts to how dense a region is. Candidates are confirmed on full
shingle sets. Where a region is denser than the neighbours looked at, its
documents that share rare shingles are compared on full sets inside tasks, which
loses no link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from agoralens.llm.common import arrow_ready, gram_hashes, mix, word_hashes
from agoralens.session import materialise, scoped

#: Orders, values compared in an order, least common prefix of candidates, neighbours looked at.
ORDERS, DEPTH, LEAST, NEIGHBOURS = 24, 10, 5, 4

_SIZE = ORDERS * LEAST
_FACTORS = np.random.default_rng(6).integers(0, 2**63, _SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Rows of a block of a bucket, and shingles where sets are compared.
BUCKET, BLOCK_SHINGLES = 2048, 1 << 20
#: 64-bit words of the bits that a set's shingles set.
BIT_WORDS = 16
#: Bits of a filter of ids: 8 MB, however many ids there are.
FILTER_BITS = 1 << 26
#: Bits kept of a shingle's hash; the others number the texts of a batch while it is sorted.
_KEPT = np.uint64(50)
_PRINTS = "doc_id bigint, n_shingles bigint, set_1 bigint, set_2 bigint, signature binary, bits array<bigint>"


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as sorted 64-bit values, and where each text's begin and end.

    A-Z is lower-cased; a text with fewer than `n` words has its whole sequence
    as its one shingle; null, or no words: none.
    """
    hashes, of = word_hashes([(t or "").encode().lower() for t in texts])
    if len(texts) >= 1 << 14:  # the number of the text takes 14 bits
        parts = [shingle_sets(texts[k : k + 10_000], n) for k in range(0, len(texts), 10_000)]
        ends = np.cumsum([0, *(len(v) for v, _ in parts)])
        return np.concatenate([v for v, _ in parts]), np.concatenate([e[: None if k == len(parts) - 1 else -1] + ends[k] for k, (_, e) in enumerate(parts)])
    grams, gram_of = gram_hashes(hashes, of, n)
    words = np.bincount(of, minlength=len(texts))
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        begins = np.cumsum(words) - words
        sequence = [mix(np.array([k], np.uint64)) for k in range(1, n)]
        extra = np.array(
            [mix(sum((sequence[j] * mix(hashes[begins[t] + j : begins[t] + j + 1]) for j in range(words[t])), np.zeros(1, np.uint64)))[0] for t in short],
            dtype=np.uint64,
        )
        grams, gram_of = np.concatenate([grams, extra]), np.concatenate([gram_of, short])
    keys = np.sort((gram_of.astype(np.uint64) << _KEPT) | (grams >> (np.uint64(64) - _KEPT)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    edges = np.searchsorted(keys, np.arange(len(texts) + 1).astype(np.uint64) << _KEPT)
    return mix(keys & ((np.uint64(1) << _KEPT) - np.uint64(1))), edges


def _bits(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    flags = np.zeros((len(edges) - 1, 64 * BIT_WORDS), dtype=bool)
    flags[np.repeat(np.arange(len(flags)), np.diff(edges)), values % np.uint64(64 * BIT_WORDS)] = True
    words = np.packbits(flags, axis=1).view(np.int64).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) + 1, BIT_WORDS), pa.int32()), pa.array(words))


def _may_reach(percent: int, size_a: str, size_b: str, bits_a: str, bits_b: str) -> Column:
    """False only if two sets can't have the similarity.

    A bit set by one set only stands for a shingle in that set only, so the
    bits in which they differ bound from below how many shingles differ.
    """
    unlike = sum((F.bit_count(F.col(bits_a)[k].bitwiseXOR(F.col(bits_b)[k])) for k in range(BIT_WORDS)), F.lit(0))
    close = 100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)
    return close & ((100 + percent) * unlike <= (100 - percent) * (F.col(size_a) + F.col(size_b)))


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sizes and bits don't rule out. `sets` grows with the documents, so it is never broadcast."""
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")).hint("merge") for c in "ab")
    return pairs.join(left, "a").join(right, "b").filter(_may_reach(percent, "n_a", "n_b", "bits_a", "bits_b")).select(pairs.columns)


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, MinHash signature, the bits that the shingles set."""
    arrow_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, edges = shingle_sets(batch.column(1).to_pylist(), n)
            counts = np.diff(edges)
            full = np.flatnonzero(counts)
            at = edges[:-1][full]
            digests = np.zeros((2, len(counts)), dtype=np.uint64)
            signatures: list[bytes | None] = [None] * len(counts)
            if len(full):
                for k in (0, 1):
                    digests[k, full] = np.add.reduceat(mix(values + np.uint64(k + 7)), at)
                lowest = np.stack([np.minimum.reduceat(values * f, at) for f in _FACTORS], axis=1)
                plain = (mix(lowest) & np.uint64(0xFFFF)).astype(">u2")
                for k, row in zip(full, plain):
                    signatures[k] = row.tobytes() + row[:DEPTH].tobytes()
            yield pa.record_batch(
                [batch.column(0), pa.array(counts.astype(np.int64)), *(pa.array(d.view(np.int64)) for d in digests), pa.array(signatures, pa.binary()), _bits(values, edges)],
                ["doc_id", "n_shingles", "set_1", "set_2", "signature", "bits"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PRINTS)


def neighbours(sets: DataFrame, ratio: float) -> DataFrame:
    """a, b, common (prefix length) of documents close in some order; b null where a's region goes on beyond the neighbours."""
    width = 2 * DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, False
        batches = iter(batches)
        following = next(batches, None)
        first = True
        while following is not None:
            batch, following = following, next(batches, None)
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            known = 0 if held is None else held.num_rows
            order = rows["tree"].to_numpy()
            ids, sizes = rows["doc_id"].to_numpy(), rows["n_shingles"].to_numpy()
            keys = np.frombuffer(b"".join(rows["prefix"].to_pylist()), dtype=">u2").reshape(-1, DEPTH)
            goes_on, d = np.zeros(len(ids), dtype=bool), NEIGHBOURS + 1
            if len(ids) > d:
                goes_on[d:] = (keys[d:, :LEAST] == keys[:-d, :LEAST]).all(axis=1) & (order[d:] == order[:-d])
                goes_on[:-d] |= goes_on[d:].copy()
            a, b, common = [], [], []
            for d in range(1, min(NEIGHBOURS, len(ids) - 1) + 1):
                differ = keys[d:] != keys[:-d]
                lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), DEPTH)
                near = (lcp >= LEAST) & (order[d:] == order[:-d])
                new = np.arange(len(near)) + d >= known
                low, high = np.minimum(sizes[d:], sizes[:-d]), np.maximum(sizes[d:], sizes[:-d])
                pick = near & new & (low >= ratio * high)
                if d > 1:  # where both go on, the rarest shingles find what adjacent documents don't link
                    pick &= ~(goes_on[d:] & goes_on[:-d])
                a.append(np.minimum(ids[:-d], ids[d:])[pick])
                b.append(np.maximum(ids[:-d], ids[d:])[pick])
                common.append(lcp[pick])
            edges = np.zeros(len(ids), dtype=bool)
            if first:
                edges[: NEIGHBOURS + 1] = True
            if following is None:
                edges[-NEIGHBOURS - 1 :] = True
            open_ = ids[goes_on | edges]
            a, b, common = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, common))
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([a, open_]), pa.int64()),
                    pa.array(np.concatenate([b, open_]), pa.int64(), mask=np.arange(len(a) + len(open_)) >= len(a)),
                    pa.array(np.concatenate([common, np.zeros(len(open_), np.int64)]).astype(np.int32)),
                ],
                ["a", "b", "common"],
            )
            held, first = rows.slice(max(0, rows.num_rows - NEIGHBOURS - 1)), False

    trees = F.transform(
        F.sequence(F.lit(0), F.lit(ORDERS - 1)),
        lambda t: F.struct(t.alias("tree"), F.substring("signature", t * 2 * LEAST + 1, F.lit(width)).alias("prefix")),
    )
    spread = sets.select("doc_id", "n_shingles", F.explode(trees).alias("e")).select("e.*", "doc_id", "n_shingles")
    ordered = spread.repartitionByRange("tree", "prefix", "doc_id").sortWithinPartitions("tree", "prefix", "doc_id")
    return ordered.mapInArrow(run, "a bigint, b bigint, common int")


def marked(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """`rows` and `_asked`: true if `key` is in `ids`, and hardly ever else as long as the filter's bits are many more than the ids."""
    bit = 1 + F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bucket, at = F.bitmap_bucket_number(bit).alias("_bucket"), F.bitmap_bit_position(bit)
    # Dealt by bucket first: a bucket's bits are made once, not in every task.
    known = ids.filter(F.col(key).isNotNull()).select(bucket, at.alias("_at")).repartition("_bucket")
    known = known.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    asked = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False)) & F.col(key).isNotNull()
    return rows.select("*", bucket).join(F.broadcast(known), "_bucket", "left").select(*rows.columns, asked.alias("_asked"))


def shingle_rows(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """doc_id, its distinct shingles, for the documents in `ids` only, each id once.

    Texts are shuffled, not the sets, which are larger, and hardly any text that isn't asked for. `ids` grows with the
    documents, so it is never broadcast.
    """
    arrow_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, edges = shingle_sets(batch.column(1).to_pylist(), n)
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.record_batch([batch.column(0), lists], ["doc_id", "shingles"])

    asked = marked(docs.select(F.col("doc_id").cast("long"), "text"), ids, "doc_id").filter("_asked").drop("_asked")
    # A semi-join would be moved below the filter, and shuffle all texts.
    wanted = asked.join(ids.select("doc_id").hint("merge"), "doc_id")
    return wanted.dropDuplicates(["doc_id"]).mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union. `sets` grows with the documents, so it is never broadcast."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")).hint("merge")
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")).hint("merge")
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * either).select("a", "b")


@scoped
def components(links: DataFrame) -> DataFrame:
    """doc_id, root (smallest id reachable) of every document that has a link.

    Each round hooks every root to its smallest neighbour, halves the paths
    twice and contracts the links, so few rounds are needed and links shrink.
    """
    roots = None
    edges = materialise(links.select("a", "b").filter("a <> b"))
    while edges.take(1):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("to"))
        for _ in range(2):
            parent = materialise(parent)
            above = parent.select(F.col("v").alias("to"), F.col("to").alias("top"))
            parent = parent.join(above, "to").select("v", F.col("top").alias("to"))
        parent = materialise(parent)
        moved = parent.select(F.col("v").alias("root"), "to")
        if roots is None:
            roots = parent.select(F.col("v").alias("doc_id"), F.col("to").alias("root"))
        else:
            roots = roots.join(moved, "root", "left").select("doc_id", F.coalesce("to", "root").alias("root"))
        roots = materialise(roots)
        at_a, at_b = parent.select(F.col("v").alias("a"), F.col("to").alias("x")), parent.select(F.col("v").alias("b"), F.col("to").alias("y"))
        moved = edges.join(at_a, "a").join(at_b, "b").filter("x <> y")
        edges = materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return roots if roots is not None else edges.select(F.col("a").alias("doc_id"), F.col("b").alias("root"))


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    at_a = roots.select(F.col("doc_id").alias("a"), F.col("root").alias("root_a"))
    at_b = roots.select(F.col("doc_id").alias("b"), F.col("root").alias("root_b"))
    joined = pairs.join(at_a, "a", "left").join(at_b, "b", "left")
    return joined.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def rare_links(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of `sets` that join all components which any link of theirs joins.

    Two sets that similar share a shingle among the rarest
    size - ceil(percent * size / 100) + 1 of each. Shingles held by one
    component only come first in that order and can't join two components.
    Documents meet in the buckets of these shingles. What sizes and bits don't
    rule out there connects components to clumps, and the documents of a clump
    are compared on their sets. A task puts out fewer rows than it reads in both
    steps, however many pairs it compares: those that connect what isn't yet.
    """
    held = materialise(sets.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")).withColumn("size", F.size("shingles")))
    flat = held.select("doc_id", "root", F.explode("shingles").alias("shingle"))
    shared = flat.groupBy("shingle").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high"))
    shared = shared.filter("low <> high").select("shingle", "df")
    listed = flat.join(shared, "shingle").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    listed = held.select("doc_id", "root", "size", "bits").join(listed, "doc_id")
    lead = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100) + 1
    take = F.greatest(F.lit(0), (lead - (F.col("size") - F.size("s"))).cast("int"))
    rare = listed.select("doc_id", "root", "size", "bits", F.explode(F.slice("s", F.lit(1), take)).alias("e"))
    rare = materialise(rare.select("doc_id", "root", "size", "bits", F.col("e.shingle").alias("bucket")))
    met = rare.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    met = materialise(met.select("bucket", _blocks(F.col("n"), BUCKET).alias("blocks")))
    possible_ = _dealt(rare.join(met, "bucket")).mapInArrow(_meeting(percent), "a bigint, b bigint").distinct()
    clumps = components(possible_).select(F.col("doc_id").alias("root"), F.col("root").alias("bucket"))
    members = materialise(held.join(clumps, "root").select("doc_id", "root", "size", "bits", "bucket", "shingles"))
    large = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    large = large.select("bucket", F.greatest(_blocks(F.col("n"), BUCKET), _blocks(F.col("total"), BLOCK_SHINGLES)).alias("blocks"))
    return _dealt(members.join(large, "bucket")).mapInArrow(_linked(percent), "a bigint, b bigint")


def _blocks(n: Column, most: int) -> Column:
    return F.ceil(n / most).cast("int")


def _dealt(rows: DataFrame) -> DataFrame:
    """The cells of `rows`, each whole in one partition and sorted by root.

    A bucket of several blocks has a cell for each two of them, and each row goes to the cells of its block.
    """
    own = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    return cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "root")


def _cells(rows: pa.Table) -> np.ndarray:
    return np.stack([rows[c].to_numpy() for c in ("bucket", "i", "j")])


def _words(rows: pa.Table) -> np.ndarray:
    return rows["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BIT_WORDS)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.sort(np.array(found, dtype=np.int64).reshape(-1, 2), axis=1).T
    return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])


def _whole_cells(links: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`links` of the rows that follow each other, cells never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            cell = _cells(rows)
            differ = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0))
            last = int(differ[-1]) + 1 if len(differ) else 0
            if last:
                yield links(rows.slice(0, last))
            rest = rows.slice(last)
        if rest is not None and len(rest):
            yield links(rest)

    return run


def _meeting(percent: int):
    """Pairs of components that connect, cell by cell, all components with rows that sizes and bits don't rule out; in a cell of two blocks, rows of both."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        cell, bits = _cells(rows), _words(rows)
        block, root, size = (rows[c].to_numpy() for c in ("block", "root", "size"))
        one = cell[1] == cell[2]
        edges = np.flatnonzero(np.r_[True, (cell[:, 1:] != cell[:, :-1]).any(axis=0), True])
        end = np.repeat(edges[1:], np.diff(edges))
        # Rows of a component stand together, so each row is compared with those behind its component.
        runs = np.flatnonzero(np.r_[True, (cell[:, 1:] != cell[:, :-1]).any(axis=0) | (root[1:] != root[:-1]), True])
        behind = np.repeat(runs[1:], np.diff(runs))
        above = np.repeat(runs[:-1], np.diff(runs))  # a row that this one is connected with, in the end the first of all
        at, found = np.arange(len(root)), []
        for d in range(int(np.diff(edges).max(initial=0))):
            at = at[behind[at] + d < end[at]]
            if not len(at):
                break
            x, y = at, behind[at] + d
            near = (above[x] != above[y]) & (one[x] | (block[x] != block[y]))
            near &= 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
            x, y = x[near], y[near]
            unlike = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            close = (100 + percent) * unlike <= (100 - percent) * (size[x].astype(np.int64) + size[y])
            before = len(found)
            for p, q in zip(x[close].tolist(), y[close].tolist()):
                tops = []
                for v in (p, q):
                    while above[v] != v:
                        v = above[v]
                    tops.append(v)
                if tops[0] != tops[1]:
                    above[max(tops)] = min(tops)
                    found.append((root[p], root[q]))
            while len(found) > before and (above[above] != above).any():
                above = above[above]
        return _links(found)

    return _whole_cells(links)


def _linked(percent: int):
    """Links, by full sets, that connect all documents of a cell which its links connect; in a cell of two blocks, links between both."""

    def cell_links(rows: pa.Table) -> list[tuple[int, int]]:
        bits = _words(rows)
        block, ids, root, size = (rows[c].to_numpy() for c in ("block", "doc_id", "root", "size"))
        lists = rows["shingles"].combine_chunks()
        flat = lists.flatten().to_numpy()
        begin = np.r_[0, np.cumsum(size, dtype=np.int64)]
        of = np.unique(flat, return_inverse=True)[1]
        held = np.zeros(of.max(initial=0) + 1, dtype=bool)
        two, label, found = rows["i"][0] != rows["j"][0], np.unique(root, return_inverse=True)[1], []
        for x in range(len(ids) - 1):
            y = np.arange(x + 1, len(ids))
            near = label[y] != label[x]
            if two:
                near &= block[y] != block[x]
            y = y[near & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
            unlike = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64)
            y = y[(100 + percent) * unlike <= (100 - percent) * (size[y].astype(np.int64) + size[x])]
            held[of[begin[x] : begin[x + 1]]] = True
            for part in np.split(y, np.flatnonzero(np.diff(np.cumsum(size[y], dtype=np.int64) // BLOCK_SHINGLES)) + 1):
                if not len(part):
                    continue
                n = size[part].astype(np.int64)
                first = np.cumsum(n) - n
                at = np.arange(n.sum()) + np.repeat(begin[part] - first, n)
                both = np.add.reduceat(held[of[at]], first, dtype=np.int64)
                for z in part[100 * both >= percent * (n + size[x] - both)].tolist():
                    if label[z] != label[x]:
                        label[label == label[z]] = label[x]
                        found.append((ids[x], ids[z]))
            held[of[begin[x] : begin[x + 1]]] = False
        return found

    def links(rows: pa.Table) -> pa.RecordBatch:
        cell = _cells(rows)
        edges = np.flatnonzero(np.r_[True, (cell[:, 1:] != cell[:, :-1]).any(axis=0), True])
        return _links([pair for p, q in zip(edges[:-1].tolist(), edges[1:].tolist()) for pair in cell_links(rows.slice(p, q - p))])

    return _whole_cells(links)


@scoped
def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    `docs` needs doc_id and text; other columns are ignored. Documents are
    linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest id reachable. A text without words is linked
    with nothing. Rows without id stand alone and are kept, with a null
    component. Rows that repeat an id count as one document with equal texts.
    """
    prints = materialise(fingerprints(docs, n))
    whole = prints.filter("n_shingles > 0 and doc_id is not null")
    classes = whole.groupBy("set_1", "set_2").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bits").alias("bits")
    )
    sets = materialise(classes.withColumnRenamed("rep", "doc_id"))
    found = materialise(neighbours(sets, percent / 100))
    pairs = found.filter("b is not null").groupBy("a", "b").agg(F.max("common").alias("common"))
    pairs = materialise(possible(pairs, sets, percent))
    open_ = materialise(found.filter("b is null").select(F.col("a").alias("doc_id")).distinct())
    ids = materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(open_).distinct())
    shingles = materialise(shingle_rows(docs, ids, n))
    ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))
    best = pairs.select("common", F.explode(ends).alias("e")).groupBy("e.v").agg(F.max_by("e.w", F.struct("common", F.xxhash64("e.w"))).alias("w"))
    links = materialise(confirmed(best.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct(), shingles, percent))
    roots = components(links)
    links = materialise(links.union(confirmed(across(pairs, roots), shingles, percent)))
    roots = components(links)
    rest = rare_links(shingles.join(open_, "doc_id", "left_semi").join(sets.select("doc_id", "bits").hint("merge"), "doc_id"), roots, percent)
    roots = components(links.union(rest))
    named = sets.select("set_1", "set_2", "doc_id").join(roots, "doc_id", "left")
    named = named.select("set_1", "set_2", F.coalesce("root", "doc_id").alias("root"))
    member = prints.join(named, ["set_1", "set_2"], "left").withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    )
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return member.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), kept.alias("kept"))
