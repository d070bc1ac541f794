"""Topic model: latent Dirichlet allocation by variational Bayes over all documents.

The topic-term parameters are a table, a row a term, and stay one: an iteration
joins them to groups of documents, each block of a group fits its documents, and what
the groups say of a term is added up by term. The driver holds one number a topic.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from agoralens.operators import terms as tm
from agoralens.session import materialise, scratch_path, ship_package

# Topics, terms shown per topic, random seed, iterations, inner
# iterations of a document, and the change at which these stop.
TOPICS = 5
TOPIC_TERMS = 10
SEED = 42
MAX_ITER = 10
DOCUMENT_ITER = 100
TOLERANCE = 1e-3

#: Change of a document below which it stays as it is; what it would change later doesn't show in the result.
STILL = 1e-10

#: Documents of a block.
BLOCK = 1024
#: Entries of a group of blocks, which a task holds at once, some 30 bytes each; while a group is smaller, groups for each core.
GROUP_ENTRIES = 1 << 23
GROUPS_A_CORE = 2
#: Terms of a batch of a block's documents: its matrices stay in a core's cache.
BATCH = 1 << 14


def digamma(x: np.ndarray) -> np.ndarray:
    """Six steps up, then the asymptotic series."""
    y = x + 6
    square = 1 / (y * y)
    series = np.log(y) - 0.5 / y - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square / 240)))
    return series - sum(1 / (x + i) for i in range(6))


def expected(parameters: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Exponential of the expected logarithm of shares with Dirichlet parameters."""
    return np.exp(digamma(parameters) - digamma(totals))


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """Exponential of the digamma function. The shares of a document's topics are in this proportion."""
    y, u = x + 6, x * (x + 5)
    square = 1 / (y * y)
    steps = (2 * x + 5) * (3 * u * u + 20 * u + 24) / (u * (u + 4) * (u + 6))
    return y * np.exp(-0.5 / y - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square / 240))) - steps)


def batches(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Documents of similar numbers of terms: no row of a batch is filled up by more than a quarter and four terms."""
    order, first = np.argsort(sizes, kind="stable"), 0
    while first < len(order):
        widest = min(sizes[order[first]] * 1.25 + 4, max(BATCH, sizes[order[first]]))
        last = first + 1
        while last < len(order) and sizes[order[last]] <= widest and sizes[order[last]] * (last + 1 - first) <= BATCH:
            last += 1
        yield order[first:last]
        first = last


def shares(theta: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of a batch, each divided by what its document's topics expect of the term."""
    expects = np.matmul(theta[:, None, :], rows)[:, 0]
    expects += 1e-100
    return np.divide(counts, expects, out=expects)


def document_step(starts: np.ndarray, at: np.ndarray, tf: np.ndarray, beta: np.ndarray, prior: float) -> np.ndarray:
    """What the documents say of each row of `beta`, a matrix (terms, topics).

    Document d has the terms at[starts[d]:starts[d + 1]], none has no term. All
    documents are fitted at once, until the slowest one stands. A round goes over
    batches of dense matrices (documents, topics, terms), filled up with counts of 0.
    Documents that no longer change at all leave the batches: few take very long.
    """
    sizes = np.diff(np.r_[starts, len(at)])

    def made(docs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places among `docs`, terms and counts of each batch."""
        for places in batches(sizes[docs]):
            wide, first = sizes[docs[places]][:, None], starts[docs[places]][:, None]
            column = np.arange(wide.max())
            inside = column < wide
            entries = np.where(inside, first + column, 0)
            yield places, at[entries], np.where(inside, tf[entries], 0.0)

    def rows_of(terms: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(beta[terms].transpose(0, 2, 1))

    gamma = np.ones((len(starts), beta.shape[1]))
    moving, parts = np.arange(len(starts)), None
    for _ in range(DOCUMENT_ITER):
        if parts is None:
            parts = [(places, rows_of(terms), counts) for places, terms, counts in made(moving)]
            now = gamma[moving]
        theta, heard = exp_digamma(now), np.empty_like(now)
        for places, rows, counts in parts:
            heard[places] = np.matmul(rows, shares(theta[places], rows, counts)[:, :, None])[:, :, 0]
        before, now = now, prior + theta * heard
        change = np.abs(now - before).mean(axis=1)
        if change.max(initial=0.0) < TOLERANCE:
            break
        if np.count_nonzero(still := change < STILL) > len(now) / 2:
            gamma[moving] = now
            moving, parts = moving[~still], None
    if parts is not None:
        gamma[moving] = now
    del parts
    theta, said = exp_digamma(gamma), np.zeros_like(beta)
    for docs, terms, counts in made(np.arange(len(starts))):
        share = shares(theta[docs], rows_of(terms), counts)
        for k in range(beta.shape[1]):
            said[:, k] += np.bincount(terms.ravel(), (theta[docs, k][:, None] * share).ravel(), len(beta))
    return beta * said


def start(numbered: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, l0 ...): parameters near 1, which depend on the term and the seed only."""

    def uniform(topic: int, draw: int):
        low = F.xxhash64("term", F.lit(seed), F.lit(topic), F.lit(draw)).bitwiseAND(F.lit((1 << 52) - 1))
        return (low + 1) / float((1 << 52) + 1)

    normal = [F.sqrt(-2 * F.log(uniform(t, 0))) * F.cos(2 * np.pi * uniform(t, 1)) for t in range(k)]
    return numbered.select("id", *(F.greatest(1 + 0.1 * n, F.lit(0.01)).alias(f"l{t}") for t, n in enumerate(normal)))


def spread_numbers(spark: SparkSession, n: int) -> list[int]:
    """n numbers that hash partitioning puts into n different partitions, so that no task gets several groups."""
    found: dict[int, int] = {}
    tried = 32 * n
    while len(found) < n:
        bucket = F.pmod(F.hash("id"), F.lit(n)).alias("bucket")
        found = dict(spark.range(tried).groupBy(bucket).agg(F.min("id")).collect())
        tried *= 4
    return sorted(found.values())


def fit(vectors: DataFrame, numbered: DataFrame, k: int = TOPICS, seed: int = SEED, max_iter: int = MAX_ITER, key: str = "doc_id") -> DataFrame:
    """(id, l0 ... l{k-1}): the parameters of each term after `max_iter` rounds over all documents.

    Documents are dealt to blocks, blocks in a row to groups, and these are written in
    buckets, so a round moves only the parameters: to each group those of its terms, and
    back sums. A block is fitted on its own whatever its group.
    """
    spark = ship_package(vectors.sparkSession)
    columns, prior = [f"l{t}" for t in range(k)], 1.0 / k
    n, entries = vectors.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).head()
    n_blocks = max(1, -(-n // BLOCK))
    n_groups = min(n_blocks, max(-(-entries // GROUP_ENTRIES), GROUPS_A_CORE * spark.sparkContext.defaultParallelism))
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block")
    group = F.element_at(F.lit(spread_numbers(spark, n_groups)).cast("array<bigint>"), F.expr(f"cast(block * {n_groups} div {n_blocks} + 1 as int)")).alias("group")
    dealt = vectors.select(block, "ids", "tfs").select(group, "*")
    table = f"agoralens_blocks_{uuid.uuid4().hex}"
    writer = dealt.repartition(n_groups, "group").write.bucketBy(n_groups, "group").sortBy("group", "block")
    writer.option("path", scratch_path(spark, "blocks")).saveAsTable(table)
    try:
        documents = spark.table(table)
        needed = materialise(documents.groupBy("group").applyInArrow(_terms, "group bigint, id bigint"))
        state, totals = _written(start(numbered, k, seed), columns)
        for _ in range(max_iter):
            slices = needed.join(state, "id").select("group", "id", *columns)
            schema = "id bigint, " + ", ".join(f"{c} double" for c in columns)
            parts = documents.groupBy("group").cogroup(slices.groupBy("group")).applyInArrow(_step(columns, totals, prior), schema)
            state, totals = _written(parts.groupBy("id").agg(*((F.sum(c) + F.lit(prior)).alias(c) for c in columns)), columns)
        return state
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _written(state: DataFrame, columns: list[str]) -> tuple[DataFrame, np.ndarray]:
    """The parameters, written, and their sums, which the same job observes."""
    seen = Observation()
    written = materialise(state.observe(seen, *(F.sum(c).alias(c) for c in columns)))
    return written, np.array([seen.get[c] for c in columns])


def _terms(docs: pa.Table) -> pa.Table:
    """The terms of a group."""
    ids = docs["ids"].combine_chunks().flatten().unique()
    return pa.table({"group": pa.repeat(docs["group"][0], len(ids)), "id": ids})


def _step(columns: list[str], totals: np.ndarray, prior: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A round of one group: its documents, block by block, and the parameters of their terms."""

    def step(docs: pa.Table, sent: pa.Table) -> pa.Table:
        ids, order = np.unique(sent["id"].to_numpy(), return_index=True)
        parameters = np.stack([sent[c].to_numpy() for c in columns], axis=1)[order]
        beta, said = expected(parameters, totals), np.zeros_like(parameters)
        blocks = docs["block"].to_numpy()
        for block in np.unique(blocks):
            rows = docs.filter(pa.array(blocks == block))
            lists, counts = rows["ids"].combine_chunks(), rows["tfs"].combine_chunks()
            sizes = lists.value_lengths().to_numpy()
            own, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            tf, places = counts.flatten().to_numpy().astype(np.float64), np.searchsorted(ids, own)
            said[places] += document_step(np.cumsum(sizes) - sizes, at, tf, beta[places], prior)
        return pa.table({"id": ids, **{c: said[:, t] for t, c in enumerate(columns)}})

    return step


def top_terms(state: DataFrame, numbered: DataFrame, terms: int = TOPIC_TERMS) -> DataFrame:
    """(topic, rank, term, weight): the terms with the largest share of each topic; ties by the term's number."""
    columns = [c for c in state.columns if c != "id"]
    totals = state.agg(*(F.sum(c).alias(c) for c in columns)).head()
    shares = F.array(*(F.col(c) / F.lit(totals[c]) for c in columns))
    by_weight = Window.partitionBy("topic").orderBy(F.desc("weight"), "id")
    ranked = state.select("id", F.posexplode(shares).alias("topic", "weight")).withColumn("rank", F.row_number().over(by_weight) - 1)
    top = ranked.filter(F.col("rank") < terms)
    return top.join(numbered.select("id", "term"), "id").select("topic", "rank", "term", "weight")


def topics(rows: DataFrame, documents: DataFrame, k: int = TOPICS, terms: int = TOPIC_TERMS, seed: int = SEED, max_iter: int = MAX_ITER, key: str = "doc_id") -> DataFrame:
    """(topic, rank, term, weight) of documents given as counted rows (key, counts).

    The vocabulary takes the usual bounds on document frequency. A corpus
    without a vocabulary has no topics.
    """
    numbered = tm.dictionary(tm.vocabulary_of(rows, documents))
    if numbered.isEmpty():
        return rows.sparkSession.createDataFrame([], "topic int, rank int, term string, weight double")
    vectors = materialise(tm.vectors(rows, numbered, key))
    return top_terms(fit(vectors, numbered, k, seed, max_iter, key), numbered, terms)
