import random
import time

import pytest
from pyspark.sql import Observation, functions as F

from agoralens.operators import scoring
from agoralens.operators.filters import min_tokens, positives
from agoralens.operators.projections import with_clean_text
from agoralens.operators.scoring import BatchScorer, Lexicon, LexiconTable, score_posts, train_scorer
from agoralens.plans import post_queries
from agoralens.session import materialise


def posts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "post_id long, user_posting string")
    return with_clean_text(df)


def collected(df):
    # Sorted here: a global sort in Spark samples its input, which runs the scorer too.
    return sorted(df.collect(), key=lambda r: r.post_id)


def words(n):
    return " ".join(["word"] * n)


def counting(spark, answer=lambda t: (1, 0.5)):
    """A scorer that counts its calls per text."""
    calls = spark.sparkContext.accumulator(0)

    def make():
        def score(texts):
            calls.add(len(texts))
            return [answer(t) for t in texts]

        return score

    return make, calls


def test_threshold_is_strict(spark):
    make, calls = counting(spark)
    rows = collected(score_posts(posts(spark, [words(10), words(11), None]), BatchScorer(make)))
    assert [r.token_count for r in rows] == [10, 11, None]
    assert [(r.prediction, r.prediction_prob) for r in rows] == [(None, None), (1, 0.5), (None, None)]
    assert calls.value == 1


@pytest.mark.parametrize("reply", [False, True])
def test_one_call_per_eligible_post(spark, reply):
    answer = (lambda t: '{"clase": 1, "probabilidad": 0.5}') if reply else (lambda t: (1, 0.5))
    make, calls = counting(spark, answer)
    df = posts(spark, [words(5 + i % 12) for i in range(200)]).repartition(4)
    eligible = min_tokens(df).count()
    scored = score_posts(df, BatchScorer(make, reply=reply))
    # A filter on the score must not call the scorer a second time.
    assert positives(scored).count() == eligible
    assert calls.value == eligible
    written = materialise(score_posts(df, BatchScorer(make, reply=reply)))
    assert calls.value == 2 * eligible
    assert positives(written).count() == eligible and written.count() == 200
    assert calls.value == 2 * eligible


def test_parallelism_keeps_the_rows(spark):
    make, calls = counting(spark)
    df = posts(spark, [words(20)] * 50)
    assert score_posts(df, BatchScorer(make), parallelism=2).count() == 50


def test_failing_post_does_not_spoil_its_batch(spark):
    def make():
        def score(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("model down")
            return [(0, 0.25)] * len(texts)

        return score

    df = posts(spark, [words(12), "bad " + words(12), words(13)]).coalesce(1)
    rows = collected(score_posts(df, BatchScorer(make, max_retries=1)))
    assert [(r.prediction, r.prediction_prob) for r in rows] == [(0, 0.25), (-1, 0.0), (0, 0.25)]


def test_retry_succeeds(spark):
    def make():
        tries = []

        def score(texts):
            tries.append(1)
            if len(tries) < 3:
                raise RuntimeError("try again")
            return [(1, 0.5)] * len(texts)

        return score

    rows = score_posts(posts(spark, [words(12)] * 4).coalesce(1), BatchScorer(make)).collect()
    assert {r.prediction for r in rows} == {1}


def test_time_out_gives_error_rows(spark):
    def make():
        def score(texts):
            time.sleep(5)
            return [(1, 0.5)] * len(texts)

        return score

    scorer = BatchScorer(make, max_retries=0, timeout=0.2)
    rows = score_posts(posts(spark, [words(12)]), scorer).collect()
    assert [(r.prediction, r.prediction_prob) for r in rows] == [(-1, 0.0)]


def test_answers_outside_the_domain_are_errors(spark):
    answers = {"a": (2, 0.5), "b": (1, 1.5), "c": None, "d": (1, 1), "e": ("x", 0.1), "f": (0, None)}
    make, _ = counting(spark, lambda t: answers[t[0]])
    df = posts(spark, [f"{k} {words(12)}" for k in answers])
    rows = collected(score_posts(df, BatchScorer(make)))
    expected = [(-1, 0.0), (-1, 0.0), (-1, 0.0), (1, 1.0), (-1, 0.0), (-1, 0.0)]
    assert [(r.prediction, r.prediction_prob) for r in rows] == expected


def test_malformed_reply_is_an_error(spark):
    make, _ = counting(spark, lambda t: "no json")
    row = score_posts(posts(spark, [words(12)]), BatchScorer(make, reply=True)).first()
    assert (row.prediction, row.prediction_prob) == (-1, 0.0)


def test_lexicon_counts_a_term_once_and_whole_words_only(spark):
    lexicon = Lexicon({"sad": 2.0, "happy": -3.0}, bias=-1.0)
    texts = [f"sad sad {words(12)}", f"sadness {words(12)}", f"SAD happy {words(12)}", "sad"]
    rows = collected(score_posts(posts(spark, texts), lexicon))
    assert [r.prediction for r in rows] == [1, 0, 0, None]
    assert rows[0].prediction_prob == pytest.approx(1 / (1 + 2.718281828459045**-1))


def test_lexicon_overlaps_case_and_symbols(spark):
    def logit(weights, text, bias=0.0):
        df = spark.createDataFrame([(text,)], "t string")
        return df.select(Lexicon(weights, bias).logit(F.col("t")).alias("x")).head().x

    terms = {"want": 1.0, "want to die": 4.0, "die": 2.0}
    assert logit(terms, "i want to die now") == 7.0
    assert logit(terms, "diet wanted") == 0.0
    assert logit({"Alone": 1.0, "alone": 0.5, "c++": 2.0, ":(": 4.0}, "ALONE with c++ :(") == 7.5
    assert logit({}, "x", bias=-1.0) == -1.0
    with pytest.raises(ValueError):
        Lexicon({"é": 1.0})


@pytest.mark.parametrize("classifier", ["logistic", "gbt"])
def test_ml_scorer_learns_and_guards(spark, classifier):
    texts = [(f"good fine {words(12)}", 0), (f"awful gloom {words(12)}", 1)] * 30
    labelled = spark.createDataFrame(texts, "text string, label int")
    model = train_scorer(labelled, classifier=classifier, features=1 << 10)
    df = posts(spark, [f"good fine {words(12)}", f"awful gloom {words(12)}", "awful"])
    rows = collected(score_posts(df, model))
    assert [r.prediction for r in rows] == [0, 1, None]
    assert all(0.5 <= r.prediction_prob <= 1 for r in rows[:2])
    assert df.columns + ["prediction", "prediction_prob"] == score_posts(df, model).columns


def test_batch_scorer_scans_once(spark, plan_of, tmp_path):
    spark.range(10).select(F.col("id").alias("post_id"), F.lit("x").alias("user_posting")).write.parquet(str(tmp_path / "p"))
    make, _ = counting(spark)
    plan = plan_of(score_posts(with_clean_text(spark.read.parquet(str(tmp_path / "p"))), BatchScorer(make)))
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1


def test_lexicon_table_equals_the_lexicon(spark):
    """Overlapping phrases, terms inside others, symbols, terms that become equal."""
    rng = random.Random(1)
    base = ["alone", "want", "to", "die", "sad", "c++", ":(", "a_b", "x", "no more", "want to", "want to die", "Want  To Die", "é sad"]
    terms = {t: float(k + 1) / 4 for k, t in enumerate(base)}
    while len(terms) < 150:
        terms[" ".join(rng.choice(["w%d" % k for k in range(60)]) for _ in range(rng.randrange(1, 4)))] = rng.choice([-1.0, 0.5, 2.0])
    pool = [*base, *("w%d" % k for k in range(60)), "wanting", "x9", "no", "more"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(12, 40))) for _ in range(150)] + [None, "short", "SAD alone. " * 20]
    df = posts(spark, texts)
    table = spark.createDataFrame(list(terms.items()), "term string, weight double")
    want, got = (collected(score_posts(df, s)) for s in (Lexicon(terms, -1.0), LexiconTable(table, -1.0)))
    assert [r.prediction for r in got] == [r.prediction for r in want]
    assert [r.prediction_prob for r in got] == pytest.approx([r.prediction_prob for r in want])


def test_lexicon_of_a_hundred_thousand_terms(spark):
    table = spark.range(100_000).selectExpr("concat('t', id, ' u', id % 7) term", "0.5D weight")
    df = posts(spark, [f"t{k} u{k % 7} u{k % 7} " + words(12) for k in range(0, 100_000, 5000)] + ["t5 u6 " + words(12)])
    rows = collected(score_posts(df, LexiconTable(table, bias=0.25)))
    assert [r.prediction_prob for r in rows] == pytest.approx([1 / (1 + 2.718281828459045**-0.75)] * 20 + [1 / (1 + 2.718281828459045**-0.25)])
    none = collected(score_posts(df, LexiconTable(table.limit(0), bias=-1.0)))
    assert {r.prediction for r in none} == {0}
    with pytest.raises(ValueError):
        score_posts(df, LexiconTable(spark.createDataFrame([("é", 1.0)], "term string, weight double")))


def test_fitted_scorer_works_in_a_session_that_has_observed(spark):
    """A model must not carry the session into its tasks."""
    seen = Observation()
    assert spark.range(5).observe(seen, F.count("*").alias("n")).count() == seen.get["n"] == 5
    texts = [(f"good fine {words(12)}", 0), (f"awful gloom {words(12)}", 1)] * 20
    model = train_scorer(spark.createDataFrame(texts, "text string, label int"), features=1 << 10)
    rows = collected(score_posts(posts(spark, [t for t, _ in texts[:2]]), model))
    assert [r.prediction for r in rows] == [0, 1]


@pytest.mark.parametrize("classifier", ["logistic", "gbt"])
def test_a_task_of_a_fit_reads_a_bounded_number_of_rows(spark, monkeypatch, classifier):
    """However the rows lie in files: here all in one."""
    seen, fit = [], scoring.Pipeline.fit
    monkeypatch.setattr(scoring, "TRAINING_ROWS", 8)
    monkeypatch.setattr(scoring.Pipeline, "fit", lambda self, rows: seen.extend(rows.groupBy(F.spark_partition_id()).count().collect()) or fit(self, rows))
    texts = [(f"good fine {words(12)}", 0), (f"awful gloom {words(12)}", 1)] * 40
    labelled = spark.createDataFrame(texts, "text string, label int").coalesce(1)
    model = train_scorer(labelled, classifier=classifier, features=1 << 10)
    assert sum(r["count"] for r in seen) == 80 and max(r["count"] for r in seen) <= 9
    rows = collected(score_posts(posts(spark, [t for t, _ in texts[:2]]), model))
    assert [r.prediction for r in rows] == [0, 1]


def test_stored_scores_fit_only_their_model_and_clean_once(spark, tmp_path, monkeypatch, plan_of):
    """Before, boosted trees were fitted too, which the query doesn't load, and both sides of its join cleaned all posts."""
    texts = [(k, ("awful gloom " if k % 2 else "good fine ") + words(k % 14), "s") for k in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(60).selectExpr("id doc_id", "0 quality", "cast(id % 2 as int) toxic").write.parquet(str(tmp_path / "labels.parquet"))
    spark.range(60).selectExpr("id o_orderkey", "id o_custkey", "timestamp_ntz'2024-01-01' o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(60).selectExpr("id event_id", "'t' event_type", "timestamp_ntz'2024-01-02' ts").write.parquet(str(tmp_path / "events.parquet"))
    fitted, real = [], scoring.train_scorer
    monkeypatch.setattr(scoring, "train_scorer", lambda rows, classifier="logistic": fitted.append(classifier) or real(rows, classifier=classifier, features=1 << 10))
    result = post_queries.score_posts_stored(spark, str(tmp_path))
    assert fitted == ["logistic", "logistic"]
    assert "regexp_replace" not in plan_of(result)
    rows = result.collect()
    assert len(rows) == 69 and all(r.in_domain and r.same for r in rows)
    assert sum(r.scored for r in rows) == sum((1 + (k % 7 == 0)) for k in range(60) if k % 14 > 8)
    post_queries.score_posts_ml(spark, str(tmp_path)).count()
    assert fitted == ["logistic", "logistic"]
