"""Sources, sinks, projections, filters, reports and scores over posts."""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType

from agoralens.functions import text as tx
from agoralens.functions.time import day_bucket, month_bucket
from agoralens.operators import dedup, filters, models, projections as pr, reports, scoring, sketches, windows
from agoralens.plans import jobs, sql
from agoralens.plans.registry import query, rounded
from agoralens.session import materialise, scratch_path
from agoralens.sources import files, fixtures, lake

LEXICON = scoring.Lexicon(sql.LEXICON, sql.LEXICON_BIAS)
ORDER = ["enqueued_utc", "post_id"]


def once_for_tables(*tables: str):
    """What a function makes of these tables, made once a session and again when one of them has changed."""

    def wrap(function):
        @lru_cache
        def made(application: str, sf_dir: str, stamps: tuple, *args):
            return function(SparkSession.active(), sf_dir, *args)

        def call(spark: SparkSession, sf_dir: str, *args):
            stamps = tuple(files.stamps(spark, f"{sf_dir}/{t}.parquet") for t in tables)
            return made(spark.sparkContext.applicationId, sf_dir, stamps, *args)

        return call

    return wrap


@once_for_tables("documents", "orders", "events")
def lake_root(spark: SparkSession, sf_dir: str) -> str:
    """The posts, written as the bronze table of a lake."""
    root = scratch_path(spark, "lake", lasting=True)
    fixtures.posts(spark, sf_dir).write.mode("overwrite").parquet(lake.zone_path("bronze", "posts", root))
    return root


@once_for_tables("documents", "labels")
def stored_models(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A scorer, logistic or gbt, fitted on the labelled corpus and stored. A query waits for the fit of the one it loads only."""
    root = scratch_path(spark, "models", lasting=True)
    models.save_model(scoring.train_scorer(fixtures.corpus(spark, sf_dir), classifier=name), root, name)
    return root


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.with_clean_text(fixtures.posts(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_posts(counted(spark, sf_dir), LEXICON)


# --- scans, sinks, catalog ----------------------------------------------------


@query(f"with {sql.POSTS} select * from posts")
def read_table(spark, sf_dir):
    return lake.read_table(spark, "bronze", "posts", root=lake_root(spark, sf_dir))


SPLITS = f"""{sql.CORPUS}, splits as (
  select doc_id, text, label,
         case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'val' else 'test' end as split
  from corpus
)"""


def _splits(spark, sf_dir) -> DataFrame:
    root = scratch_path(spark, "splits")
    fixtures.with_split(fixtures.corpus(spark, sf_dir)).write.partitionBy("split").parquet(root)
    return lake.read_splits(spark, {s: f"{root}/split={s}" for s in ("train", "val", "test")})


@query(f"with {SPLITS} select * from splits")
def read_splits(spark, sf_dir):
    return _splits(spark, sf_dir)


@query(f"with {SPLITS} select split, label, count(*) as n from splits group by split, label")
def union_splits(spark, sf_dir):
    return _splits(spark, sf_dir).groupBy("split", "label").agg(F.count("*").alias("n"))


GOLD = "subreddit, thread, author, post_date, user_posting, token_count, prediction, prediction_prob"


@query(f"with {sql.SCORED} select {GOLD}, strftime(post_date, '%Y-%m') as month from scored")
def write_gold(spark, sf_dir):
    gold = pr.select_gold(scored(spark, sf_dir)).withColumn("month", month_bucket(F.col("post_date")))
    path = lake.zone_path("gold", "post_predictions", scratch_path(spark, "lake"))
    # Partition values read back as inferred types; "2001-08" stays text.
    written = lake.write_gold(gold, path, partition_by="month")
    return rounded(written.withColumn("month", F.col("month").cast("string")), "prediction_prob")


def _catalog(spark) -> str:
    name = "agoralens_" + scratch_path(spark, "x").rsplit("-", 1)[1]
    lake.create_schema(spark, name, scratch_path(spark, "warehouse"))
    return name


MONTHLY_COLUMNS = """strftime(post_date, '%Y-%m') as month, subreddit, count(user_posting) as post_count,
  cast(sum(token_count) as bigint) as total_token_count, round(avg(token_count), 6) as avg_token_count"""
MONTHLY = f"{MONTHLY_COLUMNS}, count(case when prediction = 1 then 1 end) as prediction_1"
MONTHLY_SQL = f"with {sql.SCORED} select {MONTHLY} from scored group by 1, 2"


@query(MONTHLY_SQL)
def create_schema(spark, sf_dir):
    """A schema that holds the monthly report as its only table."""
    schema = _catalog(spark)
    report = reports.monthly_scored_stats(scored(spark, sf_dir))
    return rounded(lake.publish_table(report, f"{schema}.monthly"), "avg_token_count")


@query(f"with {sql.SCORED} select {GOLD} from scored")
def publish_table(spark, sf_dir):
    gold = pr.select_gold(scored(spark, sf_dir))
    return rounded(lake.publish_table(gold, f"{_catalog(spark)}.post_predictions"), "prediction_prob")


@query(MONTHLY_SQL)
def drop_table(spark, sf_dir):
    """Publish, drop and publish again: the second table replaces the first."""
    name = f"{_catalog(spark)}.report"
    lake.publish_table(fixtures.posts(spark, sf_dir).select("post_id"), name)
    lake.drop_table(spark, name)
    return rounded(lake.publish_table(reports.monthly_scored_stats(scored(spark, sf_dir)), name), "avg_token_count")


_PROFILE = [
    ("post_id", "bigint"),
    ("subreddit", "string"),
    ("thread", "string"),
    ("user_posting", "string"),
    ("author", "bigint"),
    ("post_date", "timestamp_ntz"),
    ("processed_utc", "timestamp_ntz"),
    ("enqueued_utc", "timestamp_ntz"),
]


@query(
    f"with {sql.POSTS} "
    + " union all ".join(
        f"select {i} as position, '{c}' as column_name, '{t}' as data_type, count({c}) as non_null from posts"
        for i, (c, t) in enumerate(_PROFILE)
    )
)
def profile_schema(spark, sf_dir):
    return lake.profile_schema(fixtures.posts(spark, sf_dir))


@query(f"with {sql.POSTS} select * from posts order by enqueued_utc, post_id limit 20")
def preview(spark, sf_dir):
    return lake.preview(fixtures.posts(spark, sf_dir), ORDER)


@query(f"with {sql.SCORED} select post_id, enqueued_utc, prediction, prediction_prob from scored")
def materialised_scores(spark, sf_dir):
    """Scores written once and read back, as any second use of them should."""
    written = materialise(scored(spark, sf_dir).select(*ORDER, "prediction", "prediction_prob"))
    return rounded(written, "prediction_prob")


# --- projections and filters ----------------------------------------------------


@query(f"with {sql.POSTS} select * from posts")
def normalise_names(spark, sf_dir):
    return pr.normalise_names(fixtures.bronze_posts(spark, sf_dir))


@query(f"with {sql.SCORED} select {GOLD} from scored")
def select_gold(spark, sf_dir):
    return rounded(pr.select_gold(scored(spark, sf_dir)), "prediction_prob")


@query(f"with {sql.SCORED} select post_id, enqueued_utc, prediction, prediction_prob from scored")
def struct_fields(spark, sf_dir):
    """Fields of a score struct as columns."""
    logit = pr.guarded(F.col("token_count") > 10, LEXICON.logit(F.col("user_posting")))
    logits = counted(spark, sf_dir).select(*ORDER, logit.alias("logit"))
    fields = pr.with_score_fields(logits.select(*ORDER, scoring.logistic_score(F.col("logit")).alias("model_output")))
    return rounded(fields, "prediction_prob")


@query(f"with {sql.POSTS} select * from posts where processed_utc >= timestamp '{sql.START_PROCESSED}'")
def since(spark, sf_dir):
    stored = lake.read_table(spark, "bronze", "posts", root=lake_root(spark, sf_dir))
    return filters.since(stored, "processed_utc", sql.START_PROCESSED)


@query(f"with {sql.COUNTED} select post_id, enqueued_utc, user_posting, token_count from counted where token_count > 10")
def min_tokens(spark, sf_dir):
    return filters.min_tokens(counted(spark, sf_dir)).select(*ORDER, "user_posting", "token_count")


@query(f"with {sql.SCORED} select post_id, enqueued_utc, user_posting, prediction_prob from scored where prediction = 1")
def positives(spark, sf_dir):
    written = materialise(scored(spark, sf_dir))
    found = filters.positives(written).select(*ORDER, "user_posting", "prediction_prob")
    return rounded(found, "prediction_prob")


@query(f"with {sql.CORPUS} select doc_id, text, label from corpus where label = 1")
def by_label(spark, sf_dir):
    return filters.by_label(fixtures.corpus(spark, sf_dir), 1)


@query(
    f"with {sql.COUNTED} select post_id, enqueued_utc, token_count, "
    "case when token_count > 10 then token_count end as scored_tokens from counted"
)
def guarded(spark, sf_dir):
    """Conditional without otherwise: null where the guard fails."""
    value = pr.guarded(F.col("token_count") > 10, F.col("token_count"))
    return counted(spark, sf_dir).select(*ORDER, "token_count", value.alias("scored_tokens"))


@query(f"with {sql.COUNTED} select post_id, enqueued_utc, token_count from counted where token_count < 50 or token_count > 500")
def outside_range(spark, sf_dir):
    far = filters.outside(F.col("token_count"), F.lit(50), F.lit(500))
    return counted(spark, sf_dir).filter(far).select(*ORDER, "token_count")


@query(f"with {sql.CORPUS} select doc_id, cast(label as varchar) as label from corpus")
def as_category(spark, sf_dir):
    return pr.as_category(fixtures.corpus(spark, sf_dir), "label").select("doc_id", "label")


@query(
    f"with {sql.CORPUS} select doc_id, sha256(coalesce('=' || cast(doc_id as varchar), '-') || chr(31) || "
    "coalesce('=' || text, '-')) as doc_key from corpus"
)
def doc_key(spark, sf_dir):
    """A stable key per row of the concatenated splits, instead of a position."""
    return pr.with_doc_key(fixtures.corpus(spark, sf_dir), "doc_id", "text").select("doc_id", "doc_key")


# --- dedup, order, windows --------------------------------------------------------

_KEYS = "post_id, subreddit, user_posting, author, post_date"


@query(f"with {sql.POSTS} select distinct {_KEYS} from posts")
def dedup_posts(spark, sf_dir):
    return dedup.dedup_posts(fixtures.posts(spark, sf_dir)).select(*dedup.POST_KEYS)


@query(
    f"with {sql.POSTS} select * exclude (r) from (select *, row_number() over (partition by {_KEYS} "
    "order by enqueued_utc, processed_utc, thread) as r from posts) where r = 1"
)
def first_per_key(spark, sf_dir):
    return dedup.first_per_key(fixtures.posts(spark, sf_dir), ["enqueued_utc", "processed_utc", "thread"])


@query(f"with {sql.POSTS} select post_id, enqueued_utc, thread from posts order by enqueued_utc, post_id")
def sort_by_time(spark, sf_dir):
    return fixtures.posts(spark, sf_dir).select(*ORDER, "thread").orderBy(*ORDER)


@query(
    f"with {sql.POSTS}, numbered as (select post_id, enqueued_utc, "
    "row_number() over (order by enqueued_utc, post_id) - 1 as position from posts) "
    "select *, cast(floor(position / 1000) as bigint) as window_no from numbered"
)
def count_window(spark, sf_dir):
    return windows.count_window(fixtures.posts(spark, sf_dir).select(*ORDER), ORDER)


WINDOW_STATS = """select window_no, count(*) as posts, count(prediction) as scored,
  count(case when prediction = 1 then 1 end) as prediction_1,
  min(enqueued_utc) as first_time, max(enqueued_utc) as last_time
  from (select *, cast(floor((row_number() over (order by enqueued_utc, post_id) - 1) / 1000) as bigint) as window_no
        from {0}) group by window_no"""


@query(f"with {sql.SCORED} {WINDOW_STATS.format('scored')}")
def count_window_scored(spark, sf_dir):
    """Posts and positives in each run of 1,000 posts."""
    # The range sampling reads its input twice: narrow written scores, not the texts.
    written = materialise(scored(spark, sf_dir).select(*ORDER, "prediction"))
    return windows.window_stats(windows.count_window(written, ORDER))


# --- reports ------------------------------------------------------------------------

_BY_MONTH = "cast(year(post_date) as integer) as year, cast(month(post_date) as integer) as month, count(*) as count"


@query(f"with {sql.POSTS} select {_BY_MONTH} from posts group by 1, 2")
def posts_by_year_month(spark, sf_dir):
    return reports.posts_by_year_month(fixtures.posts(spark, sf_dir))


@query(f"with {sql.POSTS} select cast(year(post_date) as integer) as year, count(*) as count from posts group by 1")
def posts_by_year(spark, sf_dir):
    return reports.posts_by_year(fixtures.posts(spark, sf_dir))


@query(f"with {sql.POSTS} select count(*) as sum_count from posts")
def total_posts(spark, sf_dir):
    return reports.total_posts(reports.posts_by_year_month(fixtures.posts(spark, sf_dir)))


@query(f"with {sql.POSTS}, d as (select distinct {_KEYS} from posts) select {_BY_MONTH} from d group by 1, 2")
def dedup_posts_by_year_month(spark, sf_dir):
    return reports.dedup_posts_by_year_month(fixtures.posts(spark, sf_dir))


@query(f"with {sql.POSTS}, d as (select distinct {_KEYS} from posts) select count(*) as sum_count from d")
def dedup_total_posts(spark, sf_dir):
    return reports.total_posts(reports.dedup_posts_by_year_month(fixtures.posts(spark, sf_dir)))


@query(
    f"""with {sql.COUNTED} select cast(cast(post_date as date) as varchar) as post_date, subreddit, count(user_posting) as post_count,
    cast(sum(token_count) as bigint) as total_token_count, round(avg(token_count), 6) as avg_token_count
    from counted group by 1, 2"""
)
def daily_token_stats(spark, sf_dir):
    report = reports.daily_token_stats(counted(spark, sf_dir))
    return rounded(report.withColumn("post_date", F.col("post_date").cast("string")), "avg_token_count")


@query(f"with {sql.COUNTED} select {MONTHLY_COLUMNS} from counted group by 1, 2")
def monthly_token_stats(spark, sf_dir):
    return rounded(reports.monthly_token_stats(counted(spark, sf_dir)), "avg_token_count")


@query(MONTHLY_SQL)
def monthly_scored_stats(spark, sf_dir):
    return rounded(reports.monthly_scored_stats(scored(spark, sf_dir)), "avg_token_count")


@query(
    f"""with {sql.SCORED}, firsts as (
      select *, row_number() over (partition by {_KEYS} order by enqueued_utc) as r from scored
    ) select {MONTHLY} from firsts where r = 1 group by 1, 2"""
)
def score_bronze(spark, sf_dir):
    """The whole batch job: bronze, dedup, scores, gold, monthly report."""
    gold = "post_predictions_" + scratch_path(spark, "x").rsplit("-", 1)[1]
    report = jobs.score_bronze(spark, lake_root(spark, sf_dir), LEXICON, gold=gold, dedup=True)
    return rounded(report, "avg_token_count")


# --- scalar functions on posts --------------------------------------------------------


def _on_text(spark, sf_dir, **columns) -> DataFrame:
    return fixtures.documents(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in columns.items()])


@query(r"select doc_id, regexp_replace(text, '[^\x00-\x7F]+', '', 'g') as text from documents")
def strip_non_ascii(spark, sf_dir):
    return _on_text(spark, sf_dir, text=tx.strip_non_ascii(F.col("text")))


@query(r"select doc_id, regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g') as text from documents")
def collapse_whitespace(spark, sf_dir):
    return _on_text(spark, sf_dir, text=tx.collapse_whitespace(F.col("text")))


@query(r"select doc_id, regexp_replace(text, '[\n\r]', ' ', 'g') as text from documents")
def newlines_to_space(spark, sf_dir):
    return _on_text(spark, sf_dir, text=tx.newlines_to_space(F.col("text")))


@query("select doc_id, trim(text) as text from documents")
def trim_spaces(spark, sf_dir):
    return _on_text(spark, sf_dir, text=tx.trim_spaces(F.col("text")))


@query(f"with {sql.CLEANED} select post_id, enqueued_utc, user_posting from cleaned")
def clean_text(spark, sf_dir):
    text = tx.clean_text(F.col("user_posting")).alias("user_posting")
    return fixtures.posts(spark, sf_dir).select(*ORDER, text)


@query(f"with {sql.COUNTED} select post_id, enqueued_utc, token_count from counted")
def token_count(spark, sf_dir):
    return counted(spark, sf_dir).select(*ORDER, "token_count")


@query(f"with {sql.CLEANED} select post_id, enqueued_utc, cast(len(string_split(user_posting, ' ')) as integer) as word_count from cleaned")
def word_count(spark, sf_dir):
    return counted(spark, sf_dir).select(*ORDER, tx.word_count(F.col("user_posting")).alias("word_count"))


@query(f"with {sql.CLEANED} select post_id, enqueued_utc, cast(len(string_split(user_posting, ' ')) as integer) as token_count from cleaned")
def encoded_token_count(spark, sf_dir):
    """Token count through an injected encoder (here: split at spaces)."""
    counter = tx.encoded_token_count(lambda: lambda text: text.split(" "))
    return pr.with_clean_text(fixtures.posts(spark, sf_dir), counter).select(*ORDER, "token_count")


@query(f"""with {sql.POSTS} select post_id, enqueued_utc, cast(year(post_date) as integer) as year,
  cast(month(post_date) as integer) as month from posts""")
def year_month(spark, sf_dir):
    return fixtures.posts(spark, sf_dir).select(*ORDER, F.year("post_date").alias("year"), F.month("post_date").alias("month"))


@query(f"with {sql.POSTS} select post_id, enqueued_utc, strftime(post_date, '%Y-%m') as month from posts")
def month_label(spark, sf_dir):
    return fixtures.posts(spark, sf_dir).select(*ORDER, month_bucket(F.col("post_date")).alias("month"))


@query(f"with {sql.POSTS} select post_id, enqueued_utc, cast(cast(post_date as date) as varchar) as post_day from posts")
def post_day(spark, sf_dir):
    day = day_bucket(F.col("post_date")).cast("string")
    return fixtures.posts(spark, sf_dir).select(*ORDER, day.alias("post_day"))


# Replies are made from the tables: labelled documents give JSON (a class of 2
# or a probability above 1 is out of domain), the others their text.
@query(
    """with r as (
      select d.doc_id, l.quality + l.toxic as clase, d.n_chars * 1e-4 as probabilidad, l.doc_id is not null as labelled
      from documents d left join labels l on l.doc_id = d.doc_id
    ), v as (select *, labelled and clase in (0, 1) and probabilidad between 0 and 1 as valid from r)
    select doc_id, case when valid then cast(clase as integer) else -1 end as prediction,
           case when valid then round(probabilidad, 6) else 0.0 end as prediction_prob from v"""
)
def parse_reply(spark, sf_dir):
    labels = fixtures.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("clase"))
    docs = fixtures.table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    json = F.format_string('{"clase": %d, "probabilidad": %de-4}', "clase", "n_chars")
    reply = F.when(F.col("clase").isNotNull(), json).otherwise(F.col("text"))
    parsed = docs.select("doc_id", tx.parse_reply(reply).alias("model_output"))
    return rounded(pr.with_score_fields(parsed), "prediction_prob")


# --- scorers ----------------------------------------------------------------------------


@query(f"with {sql.SCORED} select post_id, enqueued_utc, token_count, prediction, prediction_prob from scored")
def score_posts_lexicon(spark, sf_dir):
    result = scored(spark, sf_dir).select(*ORDER, "token_count", "prediction", "prediction_prob")
    return rounded(result, "prediction_prob")


@query(f"with {sql.SCORED} select post_id, enqueued_utc, prediction, prediction_prob from scored")
def score_posts_lexicon_table(spark, sf_dir):
    """The lexicon as a table, found by an automaton."""
    table = spark.createDataFrame(list(sql.LEXICON.items()), "term string, weight double")
    result = scoring.score_posts(counted(spark, sf_dir), scoring.LexiconTable(table, sql.LEXICON_BIAS))
    return rounded(result.select(*ORDER, "prediction", "prediction_prob"), "prediction_prob")


def _vowel_scorer():
    """Stand-in for a remote model: positive if more than a tenth of the text is the letter e."""
    return lambda texts: [(int(t.count("e") * 10 > len(t)), 0.75) for t in texts]


def _vowel_replier():
    return lambda texts: [f'{{"clase": {label}, "probabilidad": {p}}}' for label, p in _vowel_scorer()(texts)]


_VOWELS = f"""with {sql.COUNTED} select post_id, enqueued_utc,
  case when token_count > 10 then
    cast(len(regexp_extract_all(user_posting, 'e')) * 10 > length(user_posting) as integer) end as prediction,
  case when token_count > 10 then 0.75::double end as prediction_prob from counted"""


@query(_VOWELS)
def score_posts_batch(spark, sf_dir):
    result = scoring.score_posts(counted(spark, sf_dir), scoring.BatchScorer(_vowel_scorer))
    return result.select(*ORDER, "prediction", "prediction_prob")


@query(_VOWELS)
def score_posts_reply(spark, sf_dir):
    """The same rule through a scorer that answers in JSON."""
    scorer = scoring.BatchScorer(_vowel_replier, reply=True)
    return scoring.score_posts(counted(spark, sf_dir), scorer).select(*ORDER, "prediction", "prediction_prob")


def _stored_scores(spark, sf_dir, name: str, posts: DataFrame | None = None) -> DataFrame:
    """Scores of a model that was fitted and stored before, here only loaded."""
    model = models.load_model(spark, stored_models(spark, sf_dir, name), name)
    result = scoring.score_posts(counted(spark, sf_dir) if posts is None else posts, model)
    return result.select(*ORDER, "token_count", F.col("prediction").cast(IntegerType()), "prediction_prob")


@query()
def score_posts_ml(spark, sf_dir):
    """Scores of logistic regression, which is fitted once a session."""
    return _stored_scores(spark, sf_dir, "logistic")


# What is certain of a fitted model's scores, beside which posts have one. Another fit and a stored model must agree.
_DETERMINED = f"""with {sql.COUNTED} select post_id, enqueued_utc, token_count > 10 as scored, true as in_domain, true as same from counted"""


def _determined(scores: DataFrame, again: DataFrame) -> DataFrame:
    other = again.select(*ORDER, F.col("prediction").alias("_prediction"), F.col("prediction_prob").alias("_prob"))
    joined = scores.join(other, ORDER)
    in_domain = F.col("prediction").isin(0, 1) & F.col("prediction_prob").between(0.5, 1)
    same = F.col("prediction").eqNullSafe(F.col("_prediction")) & (F.abs(F.col("prediction_prob") - F.col("_prob")) < 1e-9)
    return joined.select(*ORDER, F.col("prediction").isNotNull().alias("scored"), F.coalesce(in_domain, F.lit(True)).alias("in_domain"), F.coalesce(same, F.lit(True)).alias("same"))


@query(_DETERMINED)
def score_posts_stored(spark, sf_dir):
    """Posts scored with a stored logistic model, beside the scores of one that is fitted on the spot. Both read the cleaned posts, which are written once."""
    fitted = scoring.train_scorer(fixtures.corpus(spark, sf_dir))
    posts = materialise(counted(spark, sf_dir).select(*ORDER, "user_posting", "token_count"))
    return _determined(_stored_scores(spark, sf_dir, "logistic", posts), scoring.score_posts(posts, fitted))


@query(_DETERMINED)
def score_posts_gbt(spark, sf_dir):
    """Posts scored with stored boosted trees, beside the scores of the same version loaded anew."""
    again = PipelineModel.load(f"{stored_models(spark, sf_dir, 'gbt')}/gbt/v000001")
    return _determined(_stored_scores(spark, sf_dir, "gbt"), scoring.score_posts(counted(spark, sf_dir), again))


@query()
def score_posts_gbt_rows(spark, sf_dir):
    """The scores themselves."""
    return _stored_scores(spark, sf_dir, "gbt")


# --- summaries that are stored and merged --------------------------------------------------

_PROBABILITIES = [0.25, 0.5, 0.75, 0.99]


@query(f"with {sql.POSTS} select subreddit, p, true as within from (select distinct subreddit from posts), (select unnest({_PROBABILITIES}::double[]) as p)")
def length_quantiles_sketched(spark, sf_dir):
    """Quantiles of post lengths by community from sketches stored by month, each with whether its true rank is within the bound."""
    posts = counted(spark, sf_dir).select("subreddit", month_bucket(F.col("post_date")).alias("month"), "token_count")
    posts = materialise(posts)
    stored = materialise(sketches.quantile_partials(posts, "token_count", ["month", "subreddit"]))
    found = materialise(sketches.sketched_quantiles(sketches.merge_quantiles(stored, ["subreddit"]), _PROBABILITIES))
    counts = posts.groupBy("subreddit", "token_count").count()
    below, upto = F.sum(F.when(F.col("token_count") < F.col("quantile"), F.col("count"))), F.sum(F.when(F.col("token_count") <= F.col("quantile"), F.col("count")))
    ranks = found.join(counts, "subreddit").groupBy("subreddit", "p").agg(below.alias("below"), upto.alias("upto"), F.sum("count").alias("n"))
    slack = sketches.RANK_ERROR * F.col("n") + 1
    within = (F.coalesce("below", F.lit(0)) <= F.col("p") * F.col("n") + slack) & (F.coalesce("upto", F.lit(0)) >= F.col("p") * F.col("n") - slack)
    return ranks.select("subreddit", "p", within.alias("within"))


@query(f"with {sql.TOKENS_OF_POSTS} select subreddit, count(distinct token) as distinct_tokens, true as within from post_tokens group by subreddit")
def distinct_tokens_sketched(spark, sf_dir):
    """Distinct tokens by community, with whether the merged sketches of its months estimate them within their error."""
    posts = fixtures.posts(spark, sf_dir)
    tokens = posts.select("subreddit", month_bucket(F.col("post_date")).alias("month"), F.explode(F.array_distinct(tx.tokenize(F.col("user_posting")))).alias("token"))
    tokens = materialise(tokens.groupBy("subreddit", "month", "token").count())
    stored = materialise(sketches.distinct_partials(tokens, "token", ["subreddit", "month"]))
    exact = tokens.select("subreddit", "token").distinct().groupBy("subreddit").agg(F.count("*").alias("distinct_tokens"))
    joined = exact.join(sketches.merge_distinct(stored, ["subreddit"]), "subreddit")
    within = F.abs(F.col("estimate") - F.col("distinct_tokens")) <= sketches.HLL_ERROR * F.col("distinct_tokens") + 1
    return joined.select("subreddit", "distinct_tokens", within.alias("within"))
