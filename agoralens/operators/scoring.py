"""Binary classification of posts by a pluggable scorer.

A post is scored only if it has more than `min_tokens` tokens, and exactly
once. Three kinds of scorer:

* `Lexicon`: weighted terms, one built-in expression; `LexiconTable`: very many of them;
* a fitted Spark ML `PipelineModel`;
* `BatchScorer`: the caller's function from a list of texts to a list of
  scores, for models that live outside Spark.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from agoralens.functions.text import parse_reply, tokenize
from agoralens.operators.calls import Caller
from agoralens.operators.projections import guarded
from agoralens.schema import ERROR_PREDICTION, ERROR_PROBABILITY, MIN_TOKENS, SCORE
from agoralens.session import materialise, scratch_path


@dataclass(frozen=True)
class Lexicon:
    """Weighted terms. A term counts once per post, however often it occurs.

    Terms are matched like posts are cleaned: lower case, ASCII only, single
    blanks; terms that become equal add up, empty ones are rejected. A term
    counts where no word character continues it, also inside a longer term.
    """

    weights: Mapping[str, float]
    bias: float = 0.0

    def __post_init__(self) -> None:
        if any(not self._plain(t) for t in self.weights):
            raise ValueError("a term has no ASCII character left to match")

    @staticmethod
    def _plain(term: str) -> str:
        return " ".join(term.lower().encode("ascii", "ignore").decode().split())

    def logit(self, text: Column) -> Column:
        terms: dict[str, float] = {}
        for term, weight in self.weights.items():
            terms[self._plain(term)] = terms.get(self._plain(term), 0.0) + float(weight)
        low, total = F.lower(text), F.lit(float(self.bias))
        words = {t: w for t, w in terms.items() if re.fullmatch(r"\w+", t)}
        if words:
            # Words can't overlap: one regex pass finds them all.
            pattern = rf"\b(?:{'|'.join(map(re.escape, words))})\b"
            hits = F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)))

            def weight_of(hit: Column) -> Column:
                first, *rest = words.items()
                start = F.when(hit == first[0], F.lit(first[1]))
                return reduce(lambda c, item: c.when(hit == item[0], F.lit(item[1])), rest, start)

            total = F.aggregate(hits, total, lambda acc, hit: acc + weight_of(hit))
        for term, weight in terms.items():
            if term not in words:
                total = total + F.when(low.rlike(rf"(?<!\w){re.escape(term)}(?!\w)"), F.lit(weight)).otherwise(0.0)
        return total


@dataclass(frozen=True)
class LexiconTable:
    """A lexicon too large for one expression: a table (term, weight), with phrases and overlapping terms.

    Equal to `Lexicon` on the same terms. An automaton of all terms, built once a
    task, finds those of a text in one pass over it, however many there are. It is
    broadcast, so the table may have MOST_TERMS rows at most.
    """

    terms: DataFrame
    bias: float = 0.0

    def weights(self) -> dict[str, float]:
        rows = self.terms.select("term", "weight").limit(MOST_TERMS + 1).collect()
        if len(rows) > MOST_TERMS:
            raise ValueError(f"more than {MOST_TERMS} terms; score with several tables and add up the logits")
        weights: dict[str, float] = {}
        for term, weight in rows:
            if not (plain := Lexicon._plain(term)):
                raise ValueError("a term has no ASCII character left to match")
            weights[plain] = weights.get(plain, 0.0) + float(weight)
        return weights

    def logit(self, text: Column) -> Column:
        spark = self.terms.sparkSession
        shared, bias = spark.sparkContext.broadcast(self.weights()), float(self.bias)

        @F.pandas_udf("double")
        def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            find = _finder(shared.value)
            for texts in batches:
                yield texts.map(lambda t: None if t is None else bias + sum(w for _, w in sorted(find(t)))).astype("Float64")

        return logits(F.lower(text))


#: Terms of a lexicon table; some hundred bytes each in a worker.
MOST_TERMS = 1_000_000


def _finder(weights: Mapping[str, float]) -> Callable[[str], set[tuple[str, float]]]:
    """A function from a text to the terms that stand in it, with no word character before or behind."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for item in weights.items():
        automaton.add_word(item[0], item)
    automaton.make_automaton()

    def find(text: str) -> set[tuple[str, float]]:
        found = set()
        for end, item in automaton.iter(text) if weights else ():
            before, after = text[end - len(item[0]) : end - len(item[0]) + 1] if end >= len(item[0]) else "", text[end + 1 : end + 2]
            if not (before in WORD_CHARS and before or after in WORD_CHARS and after):
                found.add(item)
        return found

    return find


WORD_CHARS = frozenset(string.ascii_letters + string.digits + "_")


def logistic_score(logit: Column) -> Column:
    """Predicted class and the probability of that class. Give it a column,
    not the expression behind it, which would be computed for each use."""
    prob = 1 / (1 + F.exp(-logit))
    return F.struct(
        (prob >= 0.5).cast("int").alias("prediction"),
        F.greatest(prob, 1 - prob).alias("prediction_prob"),
    )


@dataclass(frozen=True)
class BatchScorer:
    """A function on a batch of texts, with its retry and time-out policy.

    `make` builds the function once per task (open the client there). The
    function returns, per text, a pair (class, probability) or, with
    `reply=True`, a JSON reply that is checked by `parse_reply`. If a batch
    keeps failing, it is halved until only the posts that really fail carry the
    error score. An endpoint that is down gets few calls, with growing pauses
    (see `calls.Caller`); posts that come meanwhile carry the error score too.
    """

    make: Callable[[], Callable[[list[str]], Sequence]]
    reply: bool = False
    batch_size: int = 64
    # Three retries, 120 seconds per call.
    max_retries: int = 3
    timeout: float = 120.0
    #: Seconds before the first retry, the longest pause, and failures in a row after which the endpoint counts as down.
    pause: float = 0.2
    longest_pause: float = 30.0
    breaker: int = 12


def score_posts(
    df: DataFrame,
    scorer: Lexicon | LexiconTable | PipelineModel | BatchScorer,
    min_tokens: int = MIN_TOKENS,
    parallelism: int | None = None,
) -> DataFrame:
    """Add `prediction` and `prediction_prob`; both are null for short posts.

    With a `BatchScorer`, `parallelism` bounds the number of concurrent callers
    at the price of a shuffle. Write the result before using it more than once
    (`materialise`, `write_gold`): every action on it calls the scorer again,
    and so does the sampling pass of a global sort.
    """
    eligible = F.col("token_count") > min_tokens
    if isinstance(scorer, (Lexicon, LexiconTable)):
        text = F.col("user_posting")
        if isinstance(scorer, LexiconTable):
            text = guarded(eligible, text)  # a guard around a Python function would not keep short posts from it
        logit = guarded(eligible, scorer.logit(text))
        scored = df.withColumn("_logit", logit).withColumn("model_output", logistic_score(F.col("_logit"))).drop("_logit")
    elif isinstance(scorer, BatchScorer):
        if parallelism:
            df = df.repartition(parallelism)
        # `when(..., udf)` would not guard the call: Spark evaluates the UDF
        # for all rows first. The argument is nulled instead, and the UDF
        # skips nulls. One scan, and only the text travels to Python.
        text = guarded(eligible, F.col("user_posting"))
        output = _batch_udf(scorer)(text)
        if scorer.reply:
            df = df.withColumn("_reply", output)
            scored = df.withColumn("model_output", guarded(F.col("_reply").isNotNull(), parse_reply(F.col("_reply"))))
            scored = scored.drop("_reply")
        else:
            scored = df.withColumn("model_output", output)
    else:
        scored = _ml_score(df, scorer, eligible)
    return scored.withColumns(
        {
            "prediction": F.col("model_output.prediction"),
            "prediction_prob": F.col("model_output.prediction_prob"),
        }
    ).drop("model_output")


# --- batch scorer -----------------------------------------------------------


def _batch_udf(scorer: BatchScorer):
    """Marked non-deterministic so that the optimizer neither duplicates the
    call nor moves it across a filter."""
    if scorer.reply:

        @F.pandas_udf("string")
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            with _caller(scorer) as caller:
                for texts in batches:
                    yield _spread(texts, _score_texts(caller, texts.dropna().tolist(), scorer))

        return ask.asNondeterministic()

    @F.pandas_udf(SCORE)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with _caller(scorer) as caller:
            for texts in batches:
                pairs = _spread(texts, _score_texts(caller, texts.dropna().tolist(), scorer))
                yield pd.DataFrame(
                    {
                        "prediction": pd.Series([p and p[0] for p in pairs], dtype="Int32"),
                        "prediction_prob": pd.Series([p and p[1] for p in pairs], dtype="Float64"),
                    }
                )

    return score.asNondeterministic()


def _spread(texts: pd.Series, scores: list) -> pd.Series:
    """Put the scores of the non-null texts back into their rows."""
    found = iter(scores)
    return pd.Series([next(found) if ok else None for ok in texts.notna()], dtype=object)


def _score_texts(caller: Caller, texts: list[str], scorer: BatchScorer) -> list:
    check = str if scorer.reply else _valid_pair
    error = "" if scorer.reply else (ERROR_PREDICTION, ERROR_PROBABILITY)
    scores = []
    for i in range(0, len(texts), scorer.batch_size):
        scores += caller.score(texts[i : i + scorer.batch_size])
    return [error if score is None else check(score) for score in scores]


@contextmanager
def _caller(scorer: BatchScorer) -> Iterator[Caller]:
    caller = Caller(scorer.make(), scorer.max_retries, scorer.timeout, scorer.pause, scorer.longest_pause, scorer.breaker)
    try:
        yield caller
    finally:
        caller.close()


def _valid_pair(pair) -> tuple[int, float]:
    try:
        label, prob = pair
        if label in (0, 1) and 0.0 <= float(prob) <= 1.0:
            return int(label), float(prob)
    except (TypeError, ValueError):
        pass
    return ERROR_PREDICTION, ERROR_PROBABILITY


# --- Spark ML scorer --------------------------------------------------------


#: Rows of a task that fits a scorer; trees hold some 50 kB of a row.
TRAINING_ROWS = 4096


def train_scorer(
    labelled: DataFrame,
    text: str = "text",
    label: str = "label",
    classifier: str = "logistic",
    features: int | None = None,
    seed: int = 42,
) -> PipelineModel:
    """Fit a text classifier: hashed term frequencies, IDF, then the classifier.

    Hashing needs no vocabulary on the driver, so the model size is set by
    `features` and not by the corpus. Trees look at every feature in every
    split, so they get fewer by default.
    """
    features = features or {"logistic": 1 << 18, "gbt": 1 << 12}[classifier]
    heads = {
        "logistic": LogisticRegression(maxIter=20, regParam=0.01),
        "gbt": GBTClassifier(maxIter=20, maxDepth=4, seed=seed),
    }
    hashing = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features)
    head = heads[classifier].setPredictionCol("_prediction").setProbabilityCol("_probability").setRawPredictionCol("_raw")
    rows = labelled.select(tokenize(F.col(text)).alias("_tokens"), F.col(label).cast("double").alias("label")).dropna()
    # Written once: the fit reads the term frequencies many times.
    vectors = materialise(hashing.transform(rows).select("_tf", "label"))
    # How they were written says nothing of how many rows a task gets to read in every round of the fit.
    if (parts := -(-vectors.count() // TRAINING_ROWS)) > 1:
        vectors = vectors.repartition(max(parts, labelled.sparkSession.sparkContext.defaultParallelism))
    fitted = Pipeline(stages=[IDF(inputCol="_tf", outputCol="features"), head]).fit(vectors)
    # Stored and loaded again: a model fresh from its fit holds a summary of the training, and with it the
    # session, so tasks can't be sent the model once something in the session (an observation, say) isn't serialisable.
    path = scratch_path(labelled.sparkSession, "fitted")
    PipelineModel([hashing, *fitted.stages]).write().save(path)
    return PipelineModel.load(path)


def _ml_score(df: DataFrame, model: PipelineModel, eligible: Column) -> DataFrame:
    # Short posts get no tokens, so the model does next to nothing for them.
    tokens = F.when(eligible, tokenize(F.col("user_posting"))).otherwise(F.array().cast("array<string>"))
    scored = model.transform(df.withColumn("_tokens", tokens))
    output = F.struct(
        F.col("_prediction").cast("int").alias("prediction"),
        F.array_max(vector_to_array("_probability")).alias("prediction_prob"),
    )
    return scored.select(*df.columns, guarded(eligible, output).alias("model_output"))
