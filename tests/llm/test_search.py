"""Searches against brute force: ranked lexical search and nearest neighbours."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from agoralens.llm import onebit, queries, reversed_search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=10):
    """Item number, rank, doc_id and score, by the formula."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for number, (_, text) in enumerate(items):
        scores = []
        for i, c in counts:
            m, score = 10 + (90 * sum(c.values()) * n_docs) // n_terms, 0
            for t in set(terms(text)) & set(c):
                score += floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(number, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "item_id bigint, text string, score int")


def test_search_equals_formula(spark, frame):
    """Ties among copies, Unicode and digits, upper case beyond A-Z, nulls, empty and long texts, repeated rows."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)] + ["École", "école", "ÉCOLE", "日本語", "a_b", "x9"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for k in range(300)]
    docs += [(500 + k, docs[7][1]) for k in range(40)] + [(None, docs[7][1]), (600, None), (601, ""), (602, "?!"), (603, "W1 " * 90_000), (7, docs[7][1])]
    items = [(k, " ".join(rng.sample(words, 6))) for k in range(20)] + [(30, docs[7][1]), (31, None), (32, "-"), (33, "unheard of")]
    want = {}
    for number, *row in ranked(docs, items):
        want.setdefault(items[number][0], []).append(tuple(row))
    got = {}
    for r in reversed_search.search(frame(docs).repartition(7), items_of(spark, items)).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    assert got == want


def test_search_in_blocks_and_without_rows(spark, frame, monkeypatch):
    docs = [(k, f"t{k % 5} t{k % 7} common") for k in range(60)]
    items = [(k, f"t{k} common Rare{k}") for k in range(8)]
    whole = sorted(reversed_search.search(frame(docs), items_of(spark, items)).collect())
    monkeypatch.setattr(reversed_search, "BLOCK_POSTINGS", 7)
    assert sorted(reversed_search.search(frame(docs), items_of(spark, items)).collect()) == whole
    assert reversed_search.search(frame([]), items_of(spark, items)).count() == 0
    assert reversed_search.search(frame(docs), items_of(spark, [])).count() == 0


def test_terms_across_segments(monkeypatch):
    monkeypatch.setattr(reversed_search, "SEGMENT", 11)
    found = reversed_search.index([(1, "alpha beta-beta Ж9")])
    texts = ["alpha alphabet BETA, beta", "", "Ж9 ж9 Ж9" * 3, "x" * 200 + " alpha"]
    total, doc, term, tf = found.counts([t.encode() for t in texts])
    assert total.tolist() == [len(terms(t)) for t in texts]
    hashes = {found.hashes[k]: k for k in range(len(found.hashes))}
    number = {w: hashes[reversed_search.cut(w.encode())[2][0]] for w in ("alpha", "beta", "Ж9")}
    assert sorted(zip(doc, term, tf)) == sorted((k, number[w], n) for k, t in enumerate(texts) for w, n in Counter(terms(t)).items() if w in number)


def brute(ids, x, asked, k=10):
    out = {}
    for q in np.flatnonzero(asked):
        d = np.sqrt(np.square(x - x[q]).sum(axis=1))
        others = [n for n in np.lexsort((ids, d)) if ids[n] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[n]), float(d[n])) for n in others]
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "a", 0) for i, v in rows], "vec_id bigint, embedding array<float>, cell string, score int")


def answers(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([x[0] for x in v] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [x[1:] for x in v] for q, v in out.items()}


def test_neighbours_of_given_vectors(spark):
    df = queries.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = df.toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    want = brute(ids, x, ids % 20 == 0)
    got = answers(onebit.neighbours(df, F.col("vec_id") % 20 == 0))
    assert {q: len(v) for q, v in got.items()} == {q: 10 for q in want}
    right = {(q, i): d for q, v in want.items() for i, d in v}
    found = [(q, i, d) for q, v in got.items() for i, d in v if (q, i) in right]
    assert len(found) >= 0.95 * len(right)
    assert all(abs(d - right[q, i]) < 1e-9 for q, i, d in found)


def test_copies_ties_and_rows_without_part(spark):
    """A third are copies; many blocks a cell; nulls, zeros, other lengths, repeated rows."""
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((400, 6)), 3).astype(np.float32).astype(np.float64)
    x[100:240] = x[0]
    ids = rng.permutation(400)
    rows = [(int(i), v) for i, v in zip(ids, x)]
    off = [(1000, None), (1020, [0.0] * 6), (1040, [float("nan")] * 6), (1060, [1.0, None, 1, 1, 1, 1]), (1080, [float("inf")] + [1.0] * 5), (1100, [1.0] * 5), (None, x[3])]
    want = brute(ids, x, ids % 20 == 0)
    got = answers(onebit.neighbours(vectors_of(spark, rows + off + rows[:50]), F.col("vec_id") % 20 == 0))
    assert got.keys() == want.keys()
    for q, v in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in v]
        assert [d for _, d in got[q]] == pytest.approx([d for _, d in v], abs=1e-12)


def test_blocks_of_a_cell(spark, monkeypatch):
    monkeypatch.setattr(onebit, "BLOCK", 37)
    x = np.random.default_rng(2).standard_normal((300, 8)).astype(np.float32).astype(np.float64)
    ids = np.arange(300)
    got = answers(onebit.neighbours(vectors_of(spark, [(int(i), v) for i, v in zip(ids, x)]), F.col("vec_id") < 30, k=3))
    want = brute(ids, x, ids < 30, 3)
    assert sum(i in dict(got[q]) for q, v in want.items() for i, _ in v) >= 0.9 * 90


def test_few_vectors(spark):
    assert onebit.neighbours(vectors_of(spark, []), F.lit(True)).count() == 0
    assert onebit.neighbours(vectors_of(spark, [(0, [1, 2])]), F.lit(True)).count() == 0
    two = answers(onebit.neighbours(vectors_of(spark, [(0, [1, 2]), (1, [4, 6])]), F.lit(True)))
    assert two == {0: [(1, 5.0)], 1: [(0, 5.0)]}


def test_codes_estimate_inner_products():
    """The error bound holds for nearly all pairs, and is far from trivial."""
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    cells = onebit.fit(x, 1, 10)
    signs, length, fit = cells.codes(x, np.zeros(2000, int))
    plus = np.unpackbits(signs, axis=1) * 2.0 - 1
    direction, _ = cells.turned(q, np.zeros(20, int))
    own, _ = cells.turned(x, np.zeros(2000, int))
    error = direction @ plus.T / 16 / fit - direction @ own.T
    bound = onebit.WIDTH * np.sqrt((1 - fit**2) / fit**2 / 255)
    assert (np.abs(error) <= bound).mean() > 0.99 and bound.max() < 0.2 and abs(error.mean()) < 0.005
