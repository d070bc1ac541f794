"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from agoralens.session import ship_package

#: Rows and bytes of one Arrow batch; very long texts make smaller batches.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

#: The characters that separate words.
SPACES = b" \t\n\x0b\x0c\r"


def arrow_ready(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch holds, and send the package to the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE_CODES = _odd(1, 256)
_BASE = 0x9E3779B97F4A7C15
_STEP = np.array([_BASE, pow(_BASE, -1, 2**64)], dtype=np.uint64)
_GRAM = _odd(2, 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_powers = np.ones((2, 1), dtype=np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if _powers.shape[1] < n:
        steps = np.repeat(_STEP[:, None], max(n, 1 << 20), axis=1)
        steps[:, 0] = 1
        _powers = np.multiply.accumulate(steps, axis=1)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text, and the number of the text.

    Words are runs of other bytes than white space. All texts are hashed at
    once: prefix sums of byte codes times powers of a base, so that the same
    word has the same hash wherever it stands.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = ~_IS_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    powers = _powers_to(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers[0, : len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers[1, starts])
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(text_ends, starts, side="right")


_NEAR, _FAR = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, f, dtype=np.uint64))) for n, f in ((1 << 16, _BASE), (1 << 12, pow(_BASE, 1 << 16, 2**64))))


def run_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, runs standing in line; it depends on the run's bytes alone. No run is empty."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(data)) - np.repeat(first, lengths)
    value = _BYTE_CODES[data] * _NEAR[at & 0xFFFF]
    if lengths.max() > 0xFFFF:
        value *= _FAR[at >> 16 & 0xFFF]
    return mix(np.add.reduceat(value, first))


def gram_hashes(hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `n` words within each text, and the number of the text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = len(hashes) - n + 1
    total = np.zeros(last, dtype=np.uint64)
    for k in range(n):
        total += hashes[k : k + last] * _GRAM[k]
    whole = of[:last] == of[n - 1 :]
    return mix(total[whole]), of[:last][whole]
