"""Sparse rows, the dictionary and topics against plain versions."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agoralens.operators import terms as tm, topics as tp


def rows_of(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, terms array<string>")


def test_counts_inside_the_row(spark):
    docs = [(1, ["b", "a", "b", "c", "b"]), (2, []), (3, None), (4, ["a"]), (5, ["x"] * 5000 + ["a", "x"])]
    got = {r.doc_id: [tuple(c) for c in r.counts] for r in tm.count_terms(rows_of(spark, docs), "terms").collect()}
    assert got == {i: sorted(Counter(t or []).items()) for i, t in docs}


def test_null_and_repeated_keys_stay(spark):
    got = tm.count_terms(rows_of(spark, [(None, ["a"]), (1, ["a"]), (1, ["a", "a"])]), "terms").collect()
    assert sorted((r.doc_id is None, r.counts[0].tf) for r in got) == [(False, 1), (False, 2), (True, 1)]


def test_mapping_adds_up_equal_terms(spark):
    rows = tm.count_terms(rows_of(spark, [(1, ["runs", "run", "runs", "sun"]), (2, ["gone"])]), "terms")
    mapping = spark.createDataFrame([("runs", "run"), ("run", "run"), ("sun", "sun")], "token string, term string")
    got = tm.map_terms(rows, mapping).collect()
    assert [(r.doc_id, [tuple(c) for c in r.counts]) for r in got] == [(1, [("run", 3), ("sun", 1)])]


def test_dictionary_is_dense_and_vectors_agree_with_the_long_form(spark):
    rng = random.Random(1)
    words = [f"w{k:03d}" for k in range(150)]
    docs = [(k, [rng.choice(words[: rng.randrange(1, 150)]) for _ in range(rng.randrange(0, 40))]) for k in range(200)]
    df = rows_of(spark, docs)
    rows = tm.count_terms(df, "terms")
    vocabulary = tm.vocabulary_of(rows, df)
    numbered = tm.dictionary(vocabulary)
    ids = {r.term: r.id for r in numbered.collect()}
    assert ids == {t: k for k, t in enumerate(sorted(ids))}
    long = {(r.doc_id, ids[r.term]): r.tf for r in tm.long_matrix(rows, vocabulary).collect()}
    sparse = tm.vectors(rows, numbered).collect()
    assert {(r.doc_id, i): n for r in sparse for i, n in zip(r.ids, r.tfs)} == long
    assert all(r.ids == sorted(r.ids) for r in sparse)
    assert long == {(i, ids[t]): n for i, d in docs for t, n in Counter(d).items() if t in ids}


def test_matrix_is_not_shuffled_by_document_and_term(spark, plan_of):
    docs = spark.createDataFrame([(1, "some words some"), (2, "some other words")], "doc_id bigint, text string")
    rows = tm.clean_rows(docs, ["with"])
    assert "Exchange" not in plan_of(rows)
    matrix = tm.long_matrix(rows, spark.createDataFrame([("some",), ("words",)], "term string"))
    assert not re.search(r"Exchange hashpartitioning\([^)]*doc_id", plan_of(matrix))


def plain_topics(x, start, rounds, prior):
    """Variational Bayes on a dense matrix (documents, terms), one document after the other."""
    state = start.copy()
    for _ in range(rounds):
        beta = tp.expected(state, state.sum(axis=0))
        said = np.zeros_like(state)
        gammas = np.ones((len(x), state.shape[1]))
        for _ in range(tp.DOCUMENT_ITER):
            new = np.empty_like(gammas)
            for d, row in enumerate(x):
                theta = tp.expected(gammas[d], gammas[d].sum())
                phi = beta * theta
                phi /= phi.sum(axis=1, keepdims=True)
                new[d] = prior + row @ phi
            change = np.abs(new - gammas).mean(axis=1).max()
            gammas = new
            if change < tp.TOLERANCE:
                break
        for d, row in enumerate(x):
            phi = beta * tp.expected(gammas[d], gammas[d].sum())
            phi /= phi.sum(axis=1, keepdims=True)
            said += row[:, None] * phi
        state = prior + said
    return state


def test_topics_equal_a_plain_fit(spark, monkeypatch):
    """One block is the plain algorithm; several blocks may stop their documents earlier, within the tolerance."""
    rng = np.random.default_rng(3)
    groups = [range(0, 12), range(12, 24), range(24, 36)]
    docs = [(d, [f"t{k:02d}" for k in rng.choice(groups[d % 3], 30)]) for d in range(90)]
    df = rows_of(spark, docs)
    rows = tm.count_terms(df, "terms")
    numbered = tm.dictionary(tm.vocabulary_of(rows, df))
    vectors = tm.vectors(rows, numbered)
    begin = np.array([r[1:] for r in sorted(tp.start(numbered, 3, 42).collect())])
    names = [r.term for r in numbered.orderBy("id").collect()]
    x = np.array([[Counter(t)[n] for n in names] for _, t in docs], dtype=float)
    want = plain_topics(x, begin, 4, 1 / 3)
    got = np.array([r[1:] for r in sorted(tp.fit(vectors, numbered, 3, 42, 4).collect())])
    assert np.allclose(got, want, rtol=1e-6)
    monkeypatch.setattr(tp, "BLOCK", 16)
    parts = np.array([r[1:] for r in sorted(tp.fit(vectors, numbered, 3, 42, 4).collect())])
    assert np.allclose(parts, want, rtol=0.05, atol=0.1)
    report = tp.topics(rows, df, k=3, terms=12, max_iter=15).collect()
    found = {frozenset(int(r.term[1:]) // 12 for r in report if r.topic == t) for t in range(3)}
    assert found == {frozenset({0}), frozenset({1}), frozenset({2})}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("agoralens_blocks")]


def test_no_vocabulary_no_topics(spark):
    df = rows_of(spark, [(1, ["only"]), (2, [])])
    assert tp.topics(tm.count_terms(df, "terms"), df).count() == 0


def test_digamma():
    x = np.array([0.01, 0.5, 1.0, 3.0, 50.0, 1e6])
    h = 1e-6 * x
    from math import lgamma

    slope = [(lgamma(a + b) - lgamma(a - b)) / (2 * b) for a, b in zip(x, h)]
    assert tp.digamma(x) == pytest.approx(slope, rel=1e-5)


def test_a_block_is_fitted_in_batches_that_stay_small(monkeypatch):
    """Documents of one to 3,000 terms give what they give one by one in a flat pass, within little more memory than their terms take."""
    rng = np.random.default_rng(5)
    sizes = np.r_[1, 1, 2, 3000, 700, rng.integers(1, 400, 300)]
    at = np.concatenate([rng.choice(4000, n, replace=False) for n in sizes])
    tf, starts = rng.integers(1, 6, len(at)).astype(float), np.cumsum(sizes) - sizes
    beta = tp.expected(rng.gamma(1, 1, (4000, 5)) + 0.01, np.full(5, 4000.0))
    assert sorted(np.concatenate(list(tp.batches(sizes)))) == list(range(len(sizes)))
    monkeypatch.setattr(tp, "DOCUMENT_ITER", 3)
    gamma, doc = np.ones((len(sizes), 5)), np.repeat(np.arange(len(sizes)), sizes)
    for n in range(4):
        theta = tp.expected(gamma, gamma.sum(axis=1, keepdims=True))
        phi = theta[doc] * beta[at]
        phi *= (tf / phi.sum(axis=1))[:, None]
        gamma = 0.2 + np.add.reduceat(phi, starts)
    want = np.zeros_like(beta)
    np.add.at(want, at, phi)
    tracemalloc.start()
    got = tp.document_step(starts, at, tf, beta, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want, rtol=1e-9)
    assert peak < 110 * len(at)


def test_blocks_of_a_group_are_fitted_on_their_own(spark):
    """A task gets the parameters of a group's terms once, and each block stops by its own documents."""
    rng = np.random.default_rng(7)
    docs = [(int(b), rng.choice(60, 20, replace=False).astype(np.int64)) for b in [4, 2, 4, 2, 2, 4, 4]]
    sent = {"id": np.arange(60)[::-1].copy(), **{c: rng.gamma(1, 1, 60) + 0.2 for c in ("l0", "l1", "l2")}}
    totals, order = np.array([60.0, 70.0, 80.0]), np.argsort(sent["id"])
    beta = tp.expected(np.stack([sent[c] for c in ("l0", "l1", "l2")], axis=1)[order], totals)
    want = np.zeros_like(beta)
    for block in (2, 4):
        mine = [i for b, i in docs if b == block]
        want += tp.document_step(20 * np.arange(len(mine)), np.concatenate(mine), np.ones(20 * len(mine)), beta, 1 / 3)
    table = pa.table({"group": [9] * len(docs), "block": [b for b, _ in docs], "ids": [i for _, i in docs], "tfs": pa.array([[1] * 20] * len(docs), pa.list_(pa.int32()))})
    got = tp._step(["l0", "l1", "l2"], totals, 1 / 3)(table, pa.table(sent))
    assert got["id"].to_pylist() == list(range(60))
    assert np.allclose(np.stack([got[c] for c in ("l0", "l1", "l2")], axis=1), want, rtol=1e-9)
    assert sorted(tp._terms(table)["id"].to_pylist()) == sorted({int(i) for _, d in docs for i in d})


def test_groups_go_to_tasks_of_their_own(spark):
    for n in (1, 2, 23, 300):
        numbers = tp.spread_numbers(spark, n)
        parts = spark.createDataFrame([(g,) for g in numbers], "g bigint").repartition(n, "g").select(F.spark_partition_id().alias("p"))
        assert len(set(numbers)) == n == parts.distinct().count()


def test_documents_that_stand_are_left_out_of_the_rounds(monkeypatch):
    """One document that takes all rounds doesn't make the others go on, and the result is that of all rounds."""
    rng = np.random.default_rng(11)
    sure, n = rng.integers(0, 2, 200), 40
    at = np.r_[np.concatenate([50 * s + rng.choice(50, n, replace=False) for s in sure]), np.arange(100)]
    starts, tf = np.r_[n * np.arange(200), 200 * n], np.ones(200 * n + 100)
    beta = np.full((100, 2), 0.001)
    beta[:50, 0] = beta[50:, 1] = 0.02
    seen, real = [], tp.shares
    monkeypatch.setattr(tp, "shares", lambda theta, rows, counts: seen.append(counts.size) or real(theta, rows, counts))
    monkeypatch.setattr(tp, "TOLERANCE", 0.0)
    few = tp.document_step(starts, at, tf, beta, 0.5)
    work = sum(seen)
    monkeypatch.setattr(tp, "STILL", -1.0)
    seen.clear()
    assert np.allclose(few, tp.document_step(starts, at, tf, beta, 0.5), rtol=1e-8)
    assert work < sum(seen) / 2
