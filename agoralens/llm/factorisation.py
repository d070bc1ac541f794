"""Quality classifier: a factorisation machine.

Inputs are hashed words, structure statistics (as values and as buckets) and
the length kept as metadata. Their pairwise interactions have low rank, so the
sum over pairs is half of the squared sum less the sum of squares, per factor.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from agoralens.llm.common import arrow_ready
from agoralens.llm.divergence import base_counts

#: Hash buckets of words, buckets of a statistic, factors, labelled rows the model is fitted on at most, passes.
WORDS, BUCKETS, FACTORS, SAMPLE, EPOCHS = 8192, 8, 8, 6000, 12

STATISTICS = 12
INPUTS = WORDS + STATISTICS * (BUCKETS + 1) + 1


def statistics(text: str, n_chars: int | None) -> np.ndarray:
    """Structure and metadata as values from 0 to 1."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = base_counts(text)
    words, chars, lines = max(1, n_words), max(1, word_chars), text.split("\n")
    plain = sum(map(str.isalpha, text)) if text else 0
    upper = sum(map(str.isupper, text)) if text else 0
    digits = sum(map(str.isdigit, text)) if text else 0
    tokens = text.split()
    lone = sum(1 for t in tokens if len(t) == 1 and not t.isalnum())
    size = len(text) if n_chars is None else n_chars
    return np.minimum(1.0, np.maximum(0.0, [
        np.log1p(n_words) / 12, word_chars / words / 12, 4 * n_symbols / chars, upper / chars, 4 * digits / chars,
        max(0, word_chars - plain) / chars, n_dup_lines / len(lines), n_repeat / words, len(set(tokens)) / words,
        4 * lone / words, len(lines) / words, np.log1p(max(0, size)) / 14,
    ]))


def inputs(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the inputs that aren't zero."""
    text = text or ""
    stats = statistics(text, n_chars)
    words = np.array(sorted({zlib.crc32(w.strip(b".,;:!?")) % WORDS for w in text.lower().encode().split()}), dtype=np.int64)
    k = np.arange(STATISTICS)
    bucket = np.minimum(BUCKETS - 1, (stats * BUCKETS).astype(np.int64))
    index = np.concatenate([words, WORDS + k, WORDS + STATISTICS + k * BUCKETS + bucket, [INPUTS - 1] * (n_chars is None)])
    value = np.concatenate([np.full(len(words), 1 / np.sqrt(max(1, len(words)))), stats, np.full(STATISTICS, 0.5), [0.5] * (n_chars is None)])
    return index.astype(np.int64), value


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, index: np.ndarray, value: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """One per row, in time linear in the inputs. Every row has inputs."""
        parts = self.factors[index] * value[:, None]
        sums = np.add.reduceat(parts, begins, axis=0)
        squares = np.add.reduceat(parts**2, begins, axis=0)
        return self.bias + np.add.reduceat(self.weights[index] * value, begins) + 0.5 * (sums**2 - squares).sum(axis=1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1, batch: int = 64, rate: float = 0.1, decay: float = 1e-4) -> Machine:
    """Logistic loss by AdaGrad over mini-batches; without rows, or with one label, the share of the label alone."""
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    m = Machine(float(np.log(share / (1 - share))), np.zeros(INPUTS), np.zeros((INPUTS, FACTORS)))
    if len(set(labels.tolist())) < 2:
        return m
    rng = np.random.default_rng(seed)
    m.factors = rng.normal(0, 0.05, (INPUTS, FACTORS))
    seen_w, seen_v, seen_b = np.full(INPUTS, 1e-2), np.full((INPUTS, FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            x = np.zeros((len(chosen), INPUTS))
            for r, c in enumerate(chosen):
                x[r, rows[c][0]] = rows[c][1]
            used = np.flatnonzero(x.any(axis=0))
            x, w, v = x[:, used], m.weights[used], m.factors[used]
            sums = x @ v
            margin = m.bias + x @ w + 0.5 * (sums**2 - (x**2) @ (v**2)).sum(axis=1)
            error = (1 / (1 + np.exp(-margin)) - labels[chosen]) / len(chosen)
            grad_w = x.T @ error + decay * w
            grad_v = x.T @ (error[:, None] * sums) - ((x**2).T @ error)[:, None] * v + decay * v
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            seen_b += error.sum() ** 2
            m.weights[used] -= rate * grad_w / np.sqrt(seen_w[used])
            m.factors[used] -= rate * grad_v / np.sqrt(seen_v[used])
            m.bias -= rate * error.sum() / np.sqrt(seen_b)
    return m


def _with_length(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n_chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on about `sample` labelled rows at most, chosen by a hash of the id.

    `labels` has doc_id and label (0 or 1; others and nulls are left out).
    """
    arrow_ready(docs.sparkSession)
    labels = labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    rate = min(1.0, 0.95 * sample / max(1, labels.count()))
    chosen = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rate * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [inputs(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = [pa.array([x.astype(t).tobytes() for x in xs], pa.binary()) for xs, t in zip(zip(*found), ("<u2", "<f4"))]
            if found:
                yield pa.record_batch([batch.column(0), batch.column(3), *columns], ["doc_id", "label", "index", "value"])

    rows = _with_length(docs).join(chosen, "doc_id").mapInArrow(run, "doc_id bigint, label int, index binary, value binary")
    got = sorted(rows.collect(), key=lambda r: (r.doc_id, r.label, r["index"]))
    pairs = [(np.frombuffer(r["index"], "<u2").astype(np.int64), np.frombuffer(r.value, "<f4").astype(np.float64)) for r in got]
    return fit(pairs, np.array([r.label for r in got], dtype=np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score (0 to 1, higher: better quality), predicted of every row.

    `docs` needs doc_id and text, and may have n_chars; other columns are
    ignored. A null text is scored as an empty one, repeated rows each.
    """
    spark = arrow_ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [inputs(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            sizes = np.array([len(i) for i, _ in found])
            index, value = (np.concatenate(x) for x in zip(*found))
            margin = shared.value.margins(index, value, np.cumsum(sizes) - sizes)
            scores = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield pa.record_batch([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    scored = _with_length(docs).mapInArrow(run, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
