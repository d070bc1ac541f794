"""Language ID by a linear-chain conditional random field over words.

Each word has affix, n-gram and lexicon features; learned transitions link the
words of a segment, so code-switched text is labelled word by word with
forward-backward. A document's language has the largest mean posterior.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from agoralens.llm.common import arrow_ready
from agoralens.session import materialise

#: Feature buckets, bytes of a word that stay one position (longer words are several), positions of a segment, documents the field is fitted on, steps.
BUCKETS, WIDTH, SEGMENT, SAMPLE, STEPS = 1 << 16, 24, 64, 800, 30
#: A lexicon word occurs so often in the sample. Documents of each language in it, where SAMPLE in equal parts gives fewer. Values of a block while fitting.
LEXICON_COUNT, LEAST_EACH, BLOCK = 4, 8, 1 << 24

_STRIP = ".,;:!?\"'()[]{}«»-*#$%&|<>"


def _runs(word: str) -> list[str]:
    """The word in consecutive runs of WIDTH bytes at most, cut between characters."""
    data = word.encode()
    if len(data) <= WIDTH:
        return [word]
    out, at = [], 0
    while at < len(data):
        end = min(at + WIDTH, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end].decode())
        at = end
    return out


def segments(text: str) -> list[list[str]]:
    """Lower-cased words of each line, long ones in runs, cut into SEGMENT of them at most; each cut is a chain of its own."""
    out = []
    for line in text.lower().split("\n"):
        words = [w.strip(_STRIP) for w in line.split()]
        if max(map(len, words), default=0) > (WIDTH if line.isascii() else WIDTH // 4):
            words = [r for w in words for r in _runs(w)]
        out += [words[k : k + SEGMENT] for k in range(0, len(words), SEGMENT)]
    return out


def _hash(code: np.ndarray, kind: int) -> np.ndarray:
    return ((code + np.uint64(kind << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def features(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """Feature buckets of each word, 0 where it has fewer: trigrams, prefixes, suffixes, lexicon entry."""
    raw = [w.encode() for w in words]
    size = np.array([min(len(w), WIDTH) for w in raw])
    b = np.zeros((len(raw), WIDTH + 3), dtype=np.uint64)
    b[:, 1 : WIDTH + 1] = np.array(raw, dtype=f"S{WIDTH}").view(np.uint8).reshape(-1, WIDTH)
    b[:, 0] = 32
    b[np.arange(len(raw)), size + 1] = 32
    tri = (b[:, :-2] << np.uint64(16)) | (b[:, 1:-1] << np.uint64(8)) | b[:, 2:]
    out = np.where(np.arange(tri.shape[1])[None, :] < size[:, None], _hash(tri, 1), 0)
    ends = np.array([w[-3:] for w in raw], dtype="S3").view(np.uint8).reshape(-1, 3).astype(np.uint64)
    suffix = (ends[:, 0] << np.uint64(16)) | (ends[:, 1] << np.uint64(8)) | ends[:, 2]
    ends2 = np.array([w[-2:] for w in raw], dtype="S2").view(np.uint8).reshape(-1, 2).astype(np.uint64)
    affix = [tri[:, 1], b[:, 1] << np.uint64(8) | b[:, 2], suffix, (ends2[:, 0] << np.uint64(8)) | ends2[:, 1]]
    entry = np.array([lexicon.get(w, 0) for w in words], dtype=np.uint64)
    columns = [*(_hash(a, k + 2) for k, a in enumerate(affix)), np.where(entry > 0, _hash(entry, 9), 0)]
    found = np.concatenate([out, np.stack(columns, axis=1)], axis=1).astype(np.int64)
    found[size == 0] = 0
    return found


@dataclass
class Field:
    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # BUCKETS x languages; bucket 0 is zero
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for k in range(0, len(words), 20_000):
            out[k : k + 20_000] = self.weights[features(words[k : k + 20_000], self.lexicon)].sum(axis=1)
        return out

    def posteriors(self, emissions: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each position of the chains, and the expected transitions of all. Chains of like length run together."""
        out, moved = np.zeros_like(emissions), np.zeros_like(self.transitions)
        step = np.exp(self.transitions)
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = begins[order], sizes[order]
        longest = int(sizes[0]) if len(sizes) else 0
        alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest + 1)]  # chains longer than t
        local = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        forward = np.zeros_like(emissions)
        for t in range(longest):
            at = begins[: alive[t]] + t
            f = local[at] if t == 0 else local[at] * (forward[at - 1] @ step)
            forward[at] = f / f.sum(axis=1, keepdims=True)
        back = np.ones((len(sizes), len(step)))
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            at = begins[:n] + t
            p = forward[at] * back[:n]
            out[at] = p / p.sum(axis=1, keepdims=True)
            if t:
                right = local[at] * back[:n]
                left = forward[at - 1]
                moved += step * ((left / ((left @ step) * right).sum(axis=1, keepdims=True)).T @ right)
                b = right @ step.T
                back[:n] = b / b.sum(axis=1, keepdims=True)
        return out, moved


def _indexed(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in order, begins and sizes of chains, text of each chain."""
    number: dict[str, int] = {}
    ids, sizes, of = [], [], []
    for k, text in enumerate(texts):
        for s in segments(text):
            if s:
                ids += [number.setdefault(w, len(number)) for w in s]
                sizes.append(len(s))
                of.append(k)
    sizes = np.array(sizes, dtype=np.int64)
    return list(number), np.array(ids, dtype=np.int64), np.cumsum(sizes) - sizes, sizes, np.array(of, dtype=np.int64)


def _has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def fit(texts: list[str], langs: list[str]) -> Field:
    """Maximise the likelihood of each document's language on all its words, by Adam over the whole sample."""
    languages = sorted(set(langs))
    number = {k: j for j, k in enumerate(languages)}
    words, ids, begins, sizes, of = _indexed(texts)
    often = Counter(ids.tolist())
    lexicon = {words[k]: j + 1 for j, k in enumerate(k for k, n in sorted(often.items()) if n >= LEXICON_COUNT)}
    n = len(languages)
    field = Field(languages, lexicon, np.zeros((BUCKETS, n)), np.zeros((n, n)))
    if n < 2 or not len(ids):
        return field
    truth = np.repeat(np.array([number[k] for k in langs])[of], sizes)
    table = np.concatenate([features(words[k : k + 20_000], lexicon) for k in range(0, len(words), 20_000)])
    used, place = np.unique(table, return_inverse=True)
    place = place.reshape(table.shape)
    same = np.zeros((n, n))
    inner = np.ones(len(ids), dtype=bool)
    inner[begins] = False
    np.add.at(same, (truth[inner], truth[inner]), 1)
    mean = {"w": 0.0, "t": 0.0}
    square = {"w": 0.0, "t": 0.0}
    w, total = np.zeros((len(used), n)), len(ids)
    chains, rows = max(1, BLOCK // (n * SEGMENT)), max(1, BLOCK // (n * table.shape[1]))
    for step in range(1, STEPS + 1):
        scores = np.concatenate([w[place[k : k + rows]].sum(axis=1) for k in range(0, len(words), rows)])
        by_word, moved = np.zeros((len(words), n)), np.zeros((n, n))
        for c in range(0, len(sizes), chains):
            low, high = begins[c], begins[c] + sizes[c : c + chains].sum()
            p, steps = field.posteriors(scores[ids[low:high]], begins[c : c + chains] - low, sizes[c : c + chains])
            p[np.arange(high - low), truth[low:high]] -= 1
            by_word += np.stack([np.bincount(ids[low:high], p[:, k], len(words)) for k in range(n)], axis=1)
            moved += steps
        grad = {
            "w": np.stack([np.bincount(place.ravel(), np.repeat(by_word[:, k], place.shape[1]), len(used)) for k in range(n)], axis=1) / total + 1e-6 * w,
            "t": (moved - same) / total + 1e-3 * field.transitions,
        }
        move = {}
        for k, g in grad.items():
            mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.99 * square[k] + 0.01 * g**2
            move[k] = 0.1 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-9)
        w, field.transitions = w - move["w"], field.transitions - move["t"]
        w[used == 0] = 0
    field.weights[used] = w
    return field


def sampled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang, doc_id, text of an equal number of documents of each language, the first by a hash of the id.

    Languages with fewer documents give all, so every language with text, lang
    and id is there. An id repeated in a language gives one text.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).dropna()
    ids = materialise(known.select("lang", "doc_id").distinct())
    sizes = materialise(ids.groupBy("lang").agg(F.count("*").alias("n")))
    each = max(LEAST_EACH, sample // max(1, sizes.count()))
    # so many more than needed are let through that no language falls short; they make the sort small
    through = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < (4 * each + 64) / F.col("n") * (1 << 40)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = ids.join(sizes, "lang").filter(through).withColumn("rank", rank).filter(F.col("rank") <= each)
    return known.join(materialise(chosen.select("lang", "doc_id")), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on about `sample` documents, as many of each language, LEAST_EACH at least; so more if there are many. Texts are whole."""
    rows = sorted(sampled(docs, sample).collect(), key=lambda r: (r.doc_id, r.text, r.lang))
    return fit([r.text for r in rows], [r.lang for r in rows])


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, lang_pred, score of every row.

    `docs` needs doc_id and text; other columns are ignored. A null text, or
    one without letters, is `und` with score 1. The score is the mean posterior
    of the language over the words with letters, a long word counting once for
    each of its runs. Without learned languages all
    texts are `und` with score 0. Repeated rows are predicted each.
    """
    spark = arrow_ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        names = np.array([*f.languages, "und"], dtype=object)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            words, ids, begins, sizes, of = _indexed(texts)
            total, n = np.zeros((len(texts), len(f.languages))), np.zeros(len(texts))
            if len(ids):
                lettered = np.array([_has_letter(w) for w in words])[ids]
                text_of = np.repeat(of, sizes)[lettered]
                n = np.bincount(text_of, minlength=len(texts)).astype(float)
                if f.languages:
                    p = f.posteriors(f.emissions(words)[ids], begins, sizes)[0][lettered]
                    total = np.stack([np.bincount(text_of, p[:, k], len(texts)) for k in range(len(f.languages))], axis=1)
            mean = total / np.maximum(n, 1)[:, None]
            best = mean.argmax(axis=1) if f.languages else np.zeros(len(texts), dtype=np.int64)
            known = (n > 0) & bool(f.languages)
            best = np.where(known, best, len(f.languages))
            score = np.where(known, mean.max(axis=1) if f.languages else 0.0, np.where(n > 0, 0.0, 1.0))
            yield pa.record_batch([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.minimum(score, 1.0))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
