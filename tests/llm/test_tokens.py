"""Re-Pair shards and packing against plain encoding of whole texts."""

import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from agoralens.llm import encode, packing, queries, repair
from agoralens.llm.encode import encoder

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "\n", "a", "a  b", " lead", "trail ", "x\n y", "x \ny", "a\tb", "nb sp", "it's we'll 12 345", "é́ ΣΑΣ İ",
    "say <|endoftext|> now", "<|startoftext|>", "a\r\nb", "...!!! $$$ ###", "word " * 3000, "日本語 テキスト", " line sep x",
]


@cache
def tokenizer(name):
    return Tokenizer.from_str(queries.tokenizer_file(name))


def plain(name, texts):
    t = tokenizer(name)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name, keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_whole_texts(name, keep):
    got = encoder(queries.tokenizer_file(name), keep)(ODD)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == plain(name, ODD)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB 'sé1.\n\t Σ<|>́‍", max_size=40))
def test_encoder_property(text):
    for name, keep in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        got = encoder(queries.tokenizer_file(name), keep)([text])
        assert np.frombuffer(got[0], "<u4").tolist() == plain(name, [text])[0]


@pytest.mark.parametrize("name, keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_on_given_texts_with_a_small_table(monkeypatch, name, keep):
    """Pieces push each other out of a table of 64 places, and it begins anew; many calls; texts of several groups."""
    monkeypatch.setattr(encode, "SLOT_BITS", 6)
    monkeypatch.setattr(encode, "SLOTS", 64)
    monkeypatch.setattr(encode, "IDS", 3000)
    monkeypatch.setattr(encode, "AT_ONCE", 5000)
    texts = [t for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() if t][:60] + ["", "\n", "x" * 70_000 + " y", "a\n\nb", ""]
    got = encode._make(queries.tokenizer_file(name), keep)
    for texts in (texts, texts[::-1]):
        assert [np.frombuffer(g, "<u4").tolist() for g in got(texts)] == plain(name, texts)
    assert got([]) == []


def expected_repair(rows):
    out, start = [], 0
    for i, ids in sorted(zip((r[0] for r in rows), plain("word_bpe_49k.json", [r[1] or "" for r in rows]))):
        ids = [*ids, 2]
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_repair_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op7_repair_ids"](spark, SF).collect()
    assert sorted(map(tuple, got)) == expected_repair([tuple(r) for r in docs])


def test_repair_edge_cases(spark, frame, tmp_path):
    rows = [(k, t) for k, t in enumerate([*ODD, None, "same same same " * 500])]
    repair.write_ids(frame([*rows, (None, "no id"), (3, "a")]), str(tmp_path / "x"), queries.tokenizer_file("word_bpe_49k.json"), 2, 49_408)
    got = repair.decode(repair.read_blocks(spark, str(tmp_path / "x"))).collect()
    assert len(got) == len(rows) + 2 and got.count(got[0]) == 1
    by_id = {r[0]: r for r in got}
    assert by_id[None].start == 0
    for (i, t), ids in zip(rows, plain("word_bpe_49k.json", [t or "" for _, t in rows])):
        if i != 3:
            assert by_id[i].ids_crc32 == crc([*ids, 2])
    repair.write_ids(frame([]), str(tmp_path / "none"), queries.tokenizer_file("word_bpe_49k.json"), 2, 49_408)
    assert repair.decode(repair.read_blocks(spark, str(tmp_path / "none"))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=60), st.integers(1, 60))
def test_grammar_round_trip(ids, times):
    ids = np.array(ids * times, dtype="<u4")
    g = repair.compress(ids, end_id=2, base=7)
    assert g.expand(g.sequence).tolist() == ids.tolist()
    sizes = g.symbol_lengths(g.sequence)
    offsets = (np.cumsum(sizes) - sizes)[:: repair.STRIDE]
    for start, n in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids), 0)):
        assert g.span(offsets, start, n).tolist() == ids[start : start + n].tolist()


def test_compresses_repeats():
    ids = np.array(list(range(10, 60)) * 400, dtype="<u4")
    assert len(repair.compress(ids, 2, 100).sequence) * 20 < len(ids)


def check_packing(rows, got, capacity=2048):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for spans in bins.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    total = 0
    for (i, _), ids in zip(rows, plain("byte_bpe_50k.json", [t or "" for _, t in rows])):
        ids, start = [*ids, 0], 0
        total += len(ids)
        for k, p in enumerate(sorted(pieces[i], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (k, start)
            assert p.ids_crc32 == crc(ids[start : start + p.length])
            assert p.length == capacity or k == 0
            start += p.length
        assert start == len(ids)
    return len(bins), total


def test_packing_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    bins, total = check_packing(rows, queries.QUERIES["op10_sum_of_squares"](spark, SF).collect())
    assert bins <= -(-total // 2048) + 1


def test_packing_edge_cases(spark, frame):
    model = queries.tokenizer_file("byte_bpe_50k.json")
    rows = [(k, t) for k, t in enumerate([*ODD, None])]
    check_packing(rows, packing.pack_documents(frame(rows), model).collect())
    twice = packing.pack_documents(frame([(1, "a b"), (1, "a b"), (None, None)]), model).collect()
    assert len(twice) == 3 and len({r.sequence_id for r in twice}) == 1 and len({r.offset for r in twice}) == 3
    assert packing.pack_documents(frame([]), model).count() == 0


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """No packing takes fewer: pieces above half the capacity lie apart, short ones fill what they can of the gaps."""
    best, big = 0, lengths[2 * lengths > capacity]
    for t in range(capacity // 2 + 1):
        paired = big[big <= capacity - t]
        short = lengths[(lengths >= t) & (2 * lengths <= capacity)].sum()
        best = max(best, len(big) + max(0, -(-(short - (capacity - paired).sum()) // capacity)))
    return best


def test_many_tasks_leave_few_open_bins(spark):
    lengths = spark.range(6000).selectExpr("id doc_id", "cast(0 as int) piece", "0L start", "1 + pmod(xxhash64(id), 2048) length", "0L ids_crc32")
    got = packing.pack(lengths, 2048, per_task=500).select("sequence_id", "length").collect()
    assert len(got) == 6000
    assert len({r.sequence_id for r in got}) <= 1.01 * least_bins(np.array([r.length for r in got]), 2048)


def test_choice_is_the_least_sum_of_squares():
    rng, bins = np.random.default_rng(0), packing.SumOfSquares(50)
    for n in rng.integers(1, 51, 400).tolist():
        before = bins.count.copy()
        options = {}
        for gap in range(n, 51):
            if before[gap]:
                after = before.copy()
                after[gap] -= 1
                if gap > n:
                    after[gap - n] += 1
                options[gap] = (after**2).sum()
        bins.add(n)
        if options:
            assert (bins.count**2).sum() == min(options.values())


def test_cut():
    assert packing.cut(5, 2) == [(0, 1), (1, 2), (3, 2)]
    assert packing.cut(4, 2) == [(0, 2), (2, 2)]
    assert packing.cut(1, 2) == [(0, 1)]
