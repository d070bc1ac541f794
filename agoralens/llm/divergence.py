"""Quality rules: divergence of a document's histograms from language references.

A document has a histogram of character classes and one of common words. A
reference is their mean over the documents of a language. A document is
rejected if even the closest reference is too far, by Jensen-Shannon distance;
one of a language without a reference isn't measured.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from agoralens.llm.common import SPACES, arrow_ready
from agoralens.session import materialise

# The symbols counted, and common words of the languages.
SYMBOLS = "#*$%&|<>"
COMMON_WORDS = (
    "the of and to in a is that it for was on are as with by at from this be "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des et un une du en que qui pour dans sur pas est par au avec "
    "el la de que y los las del se por un una con no para su es lo como al"
)

#: Least characters and words of a text that the histograms may judge, and the greatest distances kept.
GUARD_CHARS, GUARD_WORDS, CLASS_LIMIT, WORD_LIMIT = 120, 60, 0.25, 0.31
#: A language has a reference if it has so many of the documents that the guards let in. Values of a block of distances.
LEAST_DOCS, BLOCK = 10, 1 << 21

_COMMON = {w.encode(): k for k, w in enumerate(sorted(set(COMMON_WORDS.split())))}
_OTHER = len(_COMMON)
_CLASSES = ["lower", "upper", "digit", "space", "sentence", "symbol", "beyond", "control"]
_MARKS = b".,;:!?'\"()-"


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("symbol"))
    for b in range(256):
        if b in SPACES:
            table[b] = _CLASSES.index("space")
        elif b >= 0xC0:
            table[b] = _CLASSES.index("beyond")
        elif b >= 0x80:  # goes on a character that was counted
            table[b] = len(_CLASSES)
        elif b < 32 or b == 127:
            table[b] = _CLASSES.index("control")
        elif chr(b).isalnum():
            table[b] = _CLASSES.index("digit" if chr(b).isdigit() else "upper" if chr(b).isupper() else "lower")
        elif b in _MARKS:
            table[b] = _CLASSES.index("sentence")
    return table


_CLASS_OF = _class_table()
BINS = len(_CLASSES) + _OTHER + 1


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    spaces = sum(text.count(chr(c)) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACES.decode())]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), _repeats(words)


def _repeats(words: list[bytes], n: int = 5) -> int:
    grams = list(zip(*(words[k:] for k in range(n))))
    if len(set(grams)) == len(grams):
        return 0
    often, covered = Counter(grams), bytearray(len(words))
    for k, g in enumerate(grams):
        if often[g] > 1:
            covered[k : k + n] = b"\1" * n
    return sum(covered)


def histograms(text: str) -> np.ndarray:
    """Counts by character class, then by common word (any other word last)."""
    data = text.encode()
    classes = np.bincount(_CLASS_OF[np.frombuffer(data, dtype=np.uint8)], minlength=len(_CLASSES) + 1)[: len(_CLASSES)]
    found = Counter(map(_COMMON.get, data.lower().translate(None, _MARKS).split()))
    out = np.zeros(BINS)
    out[: len(_CLASSES)] = classes
    for k, n in found.items():
        out[len(_CLASSES) + (_OTHER if k is None else k)] = n
    return out


def shares(counts: np.ndarray) -> np.ndarray:
    """Rows of counts as two distributions each; an empty one stays zero."""
    parts = counts[..., : len(_CLASSES)], counts[..., len(_CLASSES) :]
    return np.concatenate([p / np.maximum(p.sum(axis=-1, keepdims=True), 1e-12) for p in parts], axis=-1)


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of p from each row of q."""
    a, b = p[:, None, :], q[None, :, :]
    m = (a + b) / 2

    def divergence(x: np.ndarray) -> np.ndarray:
        ratio = np.divide(x, m, out=np.ones_like(m), where=(x > 0) & (m > 0))
        return (x * np.log2(ratio)).sum(axis=-1)

    return np.sqrt(np.maximum(0, (divergence(a) + divergence(b)) / 2))


def nearest(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each row of p from the closest row of q, a few rows of q at a time."""
    near, rows = np.full(len(p), np.inf), max(1, BLOCK // max(1, p.size))
    for k in range(0, len(q), rows):
        near = np.minimum(near, distances(p, q[k : k + rows]).min(axis=1))
    return near


def measured(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, lang, base columns, base_failed and the histograms of every row, and `carried` as they are."""
    arrow_ready(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text", *carried)
    schema = StructType.fromDDL("doc_id bigint, lang string, " + ", ".join(f"{n} bigint" for n in names) + ", histogram binary")
    schema = StructType([*schema, *chosen.schema[3:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            counts = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(-1, 5)
            bins = [histograms(t).astype("<u4").tobytes() for t in texts]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), *(pa.array(c) for c in counts.T), pa.array(bins, pa.binary()), *batch.columns[3:]],
                schema.names,
            )

    rows = chosen.mapInArrow(run, schema)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def references(rows: DataFrame) -> DataFrame:
    """lang, bin, share: the mean distribution of the documents of each language that the guards let in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            p = shares(_counts(batch.column(1)))
            for lang, row in zip(batch.column(0).to_pylist(), p):
                total = sums.setdefault(lang, np.zeros(BINS + 1))
                total[:BINS] += row
                total[BINS] += 1
        for lang, total in sums.items():
            bins = [pa.array([lang] * len(total)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)]
            yield pa.record_batch(bins, ["lang", "bin", "total"])

    judged = rows.filter(~F.col("base_failed") & (F.col("n_words") >= GUARD_WORDS) & F.col("lang").isNotNull())
    partial = judged.select("lang", "histogram").mapInArrow(run, "lang string, bin int, total double")
    sums = partial.groupBy("lang", "bin").agg(F.sum("total").alias("total"))
    sizes = sums.filter(F.col("bin") == BINS).select("lang", F.col("total").alias("n"))
    large = sizes.filter(F.col("n") >= LEAST_DOCS)
    return sums.join(large, "lang").select("lang", "bin", (F.col("total") / F.col("n")).alias("share"))


def _counts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, BINS).astype(np.float64)


def judge(docs: DataFrame) -> DataFrame:
    """The base columns, both distances and `kept` of every row.

    `docs` needs doc_id, lang and text; other columns are ignored and repeated
    rows are judged each. A null text counts as one without words. A document
    that fails the base rules isn't kept. One below a guard, of a language
    without a reference, or in a table without references, has null distances
    and is kept if the base rules keep it. A document without a language is
    measured against all references.
    """
    rows = materialise(measured(docs))
    return _judged(rows, _known(rows))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `judge` keeps, all columns as they are. The verdict stays with its row, so ids may be null or
    repeated. The histograms are taken once, and written with the rows."""
    rows = materialise(measured(docs, F.struct(*docs.columns).alias("row")), compression="zstd")
    return _judged(rows, _known(rows), "row").filter("kept").select("row.*")


def _known(rows: DataFrame) -> dict[str, np.ndarray]:
    """The reference of each language."""
    table: dict[str, np.ndarray] = {}
    for r in references(rows).collect():  # languages times BINS
        table.setdefault(r.lang, np.zeros(BINS + 1))[r.bin] = r.share
    return {k: v[:BINS] for k, v in table.items()}


def _judged(rows: DataFrame, table: dict[str, np.ndarray], *carried: str) -> DataFrame:
    """The columns of `judge` for measured rows, and `carried` as they are."""
    known = np.stack([table[k] for k in sorted(table)]) if table else np.zeros((0, BINS))
    named = frozenset(table)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    chosen = rows.select(*base, "histogram", "lang", *carried)
    schema = StructType.fromDDL(
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, class_distance double, word_distance double"
    )
    schema = StructType([*schema, *chosen.schema[len(base) + 2 :]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, k = shares(_counts(batch.column(len(base)))), len(_CLASSES)
            foreign = np.array([x is not None and x not in named for x in batch.column(len(base) + 1).to_pylist()], dtype=bool)
            found = []
            for part, least, size in ((slice(0, k), GUARD_CHARS, 2), (slice(k, None), GUARD_WORDS, 1)):
                near = nearest(p[:, part], known[:, part])
                small = batch.column(size).to_numpy() < least
                found.append(pa.array(near, mask=small | foreign | (len(known) == 0)))
            yield pa.record_batch([*batch.columns[: len(base)], *found, *batch.columns[len(base) + 2 :]], schema.names)

    far = (F.coalesce("class_distance", F.lit(0.0)) > CLASS_LIMIT) | (F.coalesce("word_distance", F.lit(0.0)) > WORD_LIMIT)
    judged = chosen.mapInArrow(run, schema)
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)
