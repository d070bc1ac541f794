"""Profiles of the labelled corpus, tokens, vocabularies and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from agoralens.functions import text as tx
from agoralens.operators import corpus as co, profile, terms as tm, topics as tp
from agoralens.operators.filters import by_label
from agoralens.plans import sql
from agoralens.plans.registry import query, rounded
from agoralens.session import materialise
from agoralens.sources import fixtures

VALUE, LABEL = "count_text", "label"


def lengths(spark, sf_dir) -> DataFrame:
    count = F.size(tx.tokenize(F.col("text")))
    return fixtures.corpus(spark, sf_dir).select("doc_id", LABEL, count.alias(VALUE))


def stops(spark) -> DataFrame:
    return co.stop_words(spark, sql.STOP_WORDS)


# --- distribution of lengths by label ---------------------------------------------


@query(f"with {sql.CORPUS} select label, count(*) as n from corpus group by label")
def value_counts(spark, sf_dir):
    return profile.value_counts(fixtures.corpus(spark, sf_dir), LABEL)


@query(f"with {sql.CORPUS} select distinct label from corpus")
def distinct_labels(spark, sf_dir):
    return profile.distinct_values(fixtures.corpus(spark, sf_dir), LABEL)


@query(
    f"""with {sql.CORPUS} select count(count_text) as count, round(avg(count_text), 6) as mean,
    round(stddev_samp(count_text), 6) as std, min(count_text) as min, round(quantile_cont(count_text, 0.25), 6) as q25,
    round(quantile_cont(count_text, 0.5), 6) as q50, round(quantile_cont(count_text, 0.75), 6) as q75,
    max(count_text) as max from lengths"""
)
def describe(spark, sf_dir):
    hist = profile.histogram(lengths(spark, sf_dir), VALUE)
    return rounded(profile.describe(hist, VALUE), "mean", "std", "q25", "q50", "q75")


@query(
    f"""with {sql.CORPUS} select label, round(avg(count_text), 6) as mean,
    round(quantile_cont(count_text, 0.5), 6) as median from lengths group by label"""
)
def label_mean_median(spark, sf_dir):
    hist = profile.histogram(lengths(spark, sf_dir), VALUE, LABEL)
    return rounded(profile.mean_median(hist, VALUE, LABEL), "mean", "median")


@query(f"with {sql.CORPUS} select label, cast(count(*) as bigint) as size from lengths group by label")
def label_sizes(spark, sf_dir):
    return profile.group_sizes(profile.histogram(lengths(spark, sf_dir), VALUE, LABEL), LABEL)


@query(
    f"""with {sql.BOUNDS} select label, round(q1, 6) as q1, round(q3, 6) as q3, round(iqr, 6) as iqr,
    round(lower_bound, 6) as lower_bound, round(upper_bound, 6) as upper_bound from bounds"""
)
def label_quartiles(spark, sf_dir):
    hist = profile.histogram(lengths(spark, sf_dir), VALUE, LABEL)
    return rounded(profile.quartiles(hist, VALUE, LABEL), "q1", "q3", "iqr", "lower_bound", "upper_bound")


@query(f"with {sql.CORPUS} select round(quantile_cont(count_text, 0.99), 6) as quantile from lengths")
def global_quantile(spark, sf_dir):
    hist = profile.histogram(lengths(spark, sf_dir), VALUE)
    return rounded(profile.global_quantile(hist, VALUE), "quantile")


@query(
    f"""with {sql.BOUNDS} select doc_id, label, count_text from lengths join bounds using (label)
    where count_text < lower_bound or count_text > upper_bound"""
)
def iqr_outliers(spark, sf_dir):
    # Two passes follow, for the bounds and for the rows: over the lengths, not the texts.
    return profile.iqr_outliers(materialise(lengths(spark, sf_dir)), VALUE, LABEL)


@query(
    f"""with {sql.BOUNDS}, o as (
      select label, count_text, count_text < lower_bound or count_text > upper_bound as is_out
      from lengths join bounds using (label)
    ) select label, count(case when is_out then 1 end) as outliers, count(*) as total,
      max(case when is_out then count_text end) as max_outlier,
      round(count(case when is_out then 1 end) * 100.0 / count(*), 6) as outlier_pct
    from o group by label having count(case when is_out then 1 end) > 0"""
)
def outlier_share(spark, sf_dir):
    hist = materialise(profile.histogram(lengths(spark, sf_dir), VALUE, LABEL))
    return rounded(profile.outlier_share(hist, VALUE, LABEL), "outlier_pct")


@query(
    f"""with {sql.BOUNDS} select label, round(any_value(q1), 6) as q1, round(any_value(q2), 6) as median,
      round(any_value(q3), 6) as q3,
      round(least(min(case when count_text >= lower_bound then count_text end), any_value(q1)), 6) as whisker_low,
      round(greatest(max(case when count_text <= upper_bound then count_text end), any_value(q3)), 6) as whisker_high
    from lengths join bounds using (label) group by label"""
)
def box_stats(spark, sf_dir):
    hist = materialise(profile.histogram(lengths(spark, sf_dir), VALUE, LABEL))
    return rounded(profile.box_stats(hist, VALUE, LABEL), "q1", "median", "q3", "whisker_low", "whisker_high")


@query(
    f"""with {sql.CORPUS}, per as (
      select label, stddev_samp(count_text) * pow(count(*), -0.2) as h from lengths group by label having stddev_samp(count_text) > 0
    ), whole as (select quantile_cont(count_text, 0.99) as top, count(*) as total from lengths),
    counts as (select label, count_text, count(*) as n from lengths group by label, count_text),
    grid as (select cast(i as integer) as i, top * i / 50 as x, total from whole, range(0, 51) g(i))
    select label, i, round(any_value(x), 6) as x,
      round(sum(n * exp(-0.5 * pow((x - count_text) / h, 2)) / h) / (any_value(total) * sqrt(2 * pi())), 9) as density
    from counts join per using (label), grid group by label, i"""
)
def label_density(spark, sf_dir):
    hist = materialise(profile.histogram(lengths(spark, sf_dir), VALUE, LABEL))
    return rounded(rounded(profile.density(hist, VALUE, LABEL), "x"), "density", digits=9)


@query(f"with {sql.CORPUS} select label, round(count(*) * 100.0 / (select count(*) from corpus), 6) as pct from corpus group by label")
def percentage(spark, sf_dir):
    """Share of each label."""
    sizes = materialise(profile.value_counts(fixtures.corpus(spark, sf_dir), LABEL))
    total = sizes.agg(F.sum("n")).scalar()
    return rounded(sizes.select(LABEL, tx.percentage(F.col("n"), total).alias("pct")), "pct")


# --- tokens --------------------------------------------------------------------------


@query(f"select doc_id, array_to_string({sql.words('text')}, ' ') as tokens from documents", name="tokenize")
def tokenize_query(spark, sf_dir):
    """Token arrays, shown as text with a space between tokens."""
    tokens = tx.join_tokens(tx.tokenize(F.col("text")))
    return fixtures.documents(spark, sf_dir).select("doc_id", tokens.alias("tokens"))


@query(f"select doc_id, cast(len({sql.words('text')}) as integer) as count_text from documents")
def token_array_size(spark, sf_dir):
    return fixtures.documents(spark, sf_dir).select("doc_id", F.size(tx.tokenize(F.col("text"))).alias(VALUE))


@query(f"with {sql.TOKENS} select doc_id, pos, token from tokens")
def flatten_tokens(spark, sf_dir):
    return co.flatten_tokens(fixtures.documents(spark, sf_dir))


def _mapped(spark, sf_dir, function) -> DataFrame:
    """A token function applied to the distinct tokens of the corpus."""
    counts = co.token_counts(fixtures.documents(spark, sf_dir))
    return co.merge_counts(counts.withColumn("token", function(F.col("token"))))


def _mapped_sql(function) -> str:
    return f"with {sql.TOKENS} select {function('token')} as token, count(*) as n from tokens group by 1"


@query(_mapped_sql(sql.fold))
def fold_accents(spark, sf_dir):
    return _mapped(spark, sf_dir, tx.fold_accents)


@query(_mapped_sql(lambda t: f"lower({sql.fold(t)})"))
def lower_case(spark, sf_dir):
    return _mapped(spark, sf_dir, lambda t: F.lower(tx.fold_accents(t)))


@query(_mapped_sql(sql.normal))
def strip_non_alnum(spark, sf_dir):
    return _mapped(spark, sf_dir, tx.normal_form)


def _normal_counts(spark, sf_dir) -> DataFrame:
    return _mapped(spark, sf_dir, tx.normal_form)


def _normal_counts_sql(test: str) -> str:
    return f"with {sql.NORMAL} select token, count(*) as n from normal where {test} group by token"


@query(_normal_counts_sql(f"token not in {sql.stop_list()}"))
def remove_stop_words(spark, sf_dir):
    return co.remove_stop_words(_normal_counts(spark, sf_dir), stops(spark))


@query(_normal_counts_sql("regexp_full_match(token, '[A-Za-z]+')"))
def keep_alphabetic(spark, sf_dir):
    return _normal_counts(spark, sf_dir).filter(tx.is_alphabetic(F.col("token")))


@query(_normal_counts_sql("length(token) > 3"))
def keep_longer_than(spark, sf_dir):
    return _normal_counts(spark, sf_dir).filter(tx.longer_than(F.col("token"), 3))


def clean(spark, sf_dir) -> DataFrame:
    return co.clean_tokens(fixtures.documents(spark, sf_dir), stops(spark))


def clean_counts(spark, sf_dir) -> DataFrame:
    return co.clean_counts(fixtures.documents(spark, sf_dir), stops(spark))


@query(f"with {sql.CLEAN_TOKENS} select doc_id, pos, token from clean")
def clean_tokens(spark, sf_dir):
    return clean(spark, sf_dir)


# The dictionary is made from the vocabulary: a suffix per part of speech.
SUFFIXES = {"v": "ing", "n": "s", "a": "er", "r": "ly"}


def _dictionary(vocab: DataFrame) -> DataFrame:
    token = F.col("token")

    def entry(pos: str, suffix: str) -> Column:
        lemma = F.regexp_replace(token, f"{suffix}$", "")
        return F.struct(F.lit(pos).alias("pos"), F.when(token.endswith(suffix), lemma).alias("lemma"))

    entries = F.explode(F.array(*[entry(p, s) for p, s in SUFFIXES.items()])).alias("e")
    return vocab.select("token", entries).select("token", "e.*").filter(F.col("lemma").isNotNull())


def _lemma_sql() -> str:
    steps, source = [], "voc"
    for i, (pos, suffix) in enumerate(SUFFIXES.items()):
        steps.append(
            f"dict{i} as (select distinct token, regexp_replace(token, '{suffix}$', '') as lemma from clean "
            f"where ends_with(token, '{suffix}')), "
            f"pass{i} as (select coalesce(d.lemma, s.token) as token, s.n from {source} s left join dict{i} d on d.token = s.token)"
        )
        source = f"pass{i}"
    return (
        f"{sql.CLEAN_TOKENS}, voc as (select token, count(*) as n from clean group by token), "
        + ", ".join(steps)
        + f", lemmas as (select token, cast(sum(n) as bigint) as n from {source} group by token)"
    )


def lemma_counts(spark, sf_dir) -> DataFrame:
    counts = materialise(clean_counts(spark, sf_dir))
    closure = materialise(co.lemma_closure(materialise(_dictionary(counts))))
    return co.merge_counts(co.lemmatise(counts, closure))


@query(f"with {_lemma_sql()} select token, n from lemmas")
def lemmatise(spark, sf_dir):
    return lemma_counts(spark, sf_dir)


def _stem_sql(token: str) -> str:
    for suffix, replacement in co.STEM_RULES:
        token = rf"regexp_replace({token}, '^(.{{3,}}?){suffix}$', '\1{replacement}')"
    return token


_STEMMED = f"""stemmed as (
  select * from (select {_stem_sql('token')} as token, cast(sum(n) as bigint) as n from lemmas group by 1) where length(token) > 2
)"""


def stem_counts(spark, sf_dir) -> DataFrame:
    return co.merge_counts(co.stem_tokens(lemma_counts(spark, sf_dir)))


@query(f"with {_lemma_sql()}, {_STEMMED} select token, n from stemmed")
def stem(spark, sf_dir):
    return stem_counts(spark, sf_dir)


@query(f"with {sql.CLEAN_TOKENS} select doc_id, string_agg(token, ' ' order by pos) as text from clean group by doc_id")
def join_tokens(spark, sf_dir):
    return co.clean_joined_text(fixtures.documents(spark, sf_dir), sql.STOP_WORDS)


# --- frequencies ------------------------------------------------------------------------


_RAW = f"with {sql.TOKENS}, raw as (select token, count(*) as n from tokens group by token)"
_CLEAN = f"with {sql.CLEAN_TOKENS}, counts as (select token, count(*) as n from clean group by token)"


@query(f"{_RAW} select token, n from raw order by n desc, token limit 10")
def token_frequency(spark, sf_dir):
    return co.top_tokens(co.token_counts(fixtures.documents(spark, sf_dir)))


@query(
    f"""with {sql.CORPUS}, t as (select unnest({sql.words('text')}) as token from corpus where label = 1)
    select token, count(*) as n from t group by token order by n desc, token limit 10"""
)
def token_frequency_positive(spark, sf_dir):
    """The report on the posts of label 1 only."""
    return co.top_tokens(co.token_counts(by_label(fixtures.corpus(spark, sf_dir), 1)))


@query(f"{_CLEAN} select token, n from counts order by n desc, token limit 10")
def top_clean_tokens(spark, sf_dir):
    return co.top_tokens(clean_counts(spark, sf_dir))


@query(
    f"""with {sql.CORPUS}, {sql.CLEAN_TOKENS} select token, count(*) as n from clean
    where doc_id in (select doc_id from corpus where label = 1) group by token order by n desc, token limit 10"""
)
def top_clean_tokens_positive(spark, sf_dir):
    """Clean tokens of the posts of label 1 only."""
    posts = by_label(fixtures.corpus(spark, sf_dir), 1)
    return co.top_tokens(co.clean_counts(posts, stops(spark)))


@query(f"with {_lemma_sql()}, {_STEMMED} select token, n from stemmed order by n desc, token limit 10")
def top_stems(spark, sf_dir):
    return co.top_tokens(stem_counts(spark, sf_dir))


@query(f"{_RAW} select cast(sum(n) as bigint) as tokens, count(*) as distinct_tokens from raw")
def corpus_sizes(spark, sf_dir):
    return co.corpus_sizes(co.token_counts(fixtures.documents(spark, sf_dir)))


def _weights(source: str) -> str:
    return f"""select token, n, round(n / max(n) over (), 6) as weight
      from (select token, n from {source} order by n desc, token limit 200)"""


@query(f"{_RAW} {_weights('raw')}")
def term_weights_raw(spark, sf_dir):
    return rounded(co.term_weights(co.token_counts(fixtures.documents(spark, sf_dir))), "weight")


@query(f"{_CLEAN} {_weights('counts')}")
def term_weights(spark, sf_dir):
    return rounded(co.term_weights(clean_counts(spark, sf_dir)), "weight")


@query(f"with {_lemma_sql()}, {_STEMMED} {_weights('stemmed')}")
def term_weights_stem(spark, sf_dir):
    return rounded(co.term_weights(stem_counts(spark, sf_dir)), "weight")


# --- vocabulary, matrix, topics -----------------------------------------------------------

_VOCABULARY = f"""with {sql.CLEAN_TOKENS}, vocab as (
  select token as term, count(distinct doc_id) as df from clean group by token
  having count(distinct doc_id) >= 2 and count(distinct doc_id) <= 0.95 * (select count(*) from documents)
)"""


@query(f"{_VOCABULARY} select term, df from vocab")
def vocabulary(spark, sf_dir):
    return co.vocabulary(fixtures.documents(spark, sf_dir), stops(spark))


@query(f"{_VOCABULARY} select count(*) as terms from vocab")
def vocabulary_size(spark, sf_dir):
    return co.vocabulary(fixtures.documents(spark, sf_dir), stops(spark)).agg(F.count("*").alias("terms"))


_MATRIX = f"""{_VOCABULARY}, matrix as (
  select doc_id, token as term, count(*) as tf from clean where token in (select term from vocab) group by doc_id, token
)"""


@query(f"{_MATRIX} select doc_id, term, cast(tf as integer) as tf from matrix")
def term_matrix(spark, sf_dir):
    return tm.term_matrix(fixtures.documents(spark, sf_dir), sql.STOP_WORDS)


@query(
    f"""{_MATRIX}, dict as (select term, row_number() over (order by term) - 1 as id from vocab)
    select doc_id, string_agg(id || ':' || tf, ' ' order by id) as vector from matrix join dict using (term) group by doc_id"""
)
def term_vectors(spark, sf_dir):
    """Sparse rows over a dictionary with dense numbers, shown as text."""
    docs = fixtures.documents(spark, sf_dir)
    rows = materialise(tm.clean_rows(docs, sql.STOP_WORDS))
    vectors = tm.vectors(rows, tm.dictionary(tm.vocabulary_of(rows, docs)))
    return vectors.select("doc_id", F.array_join(F.zip_with("ids", "tfs", lambda i, n: F.concat_ws(":", i, n)), " ").alias("vector"))


def stemmed_rows(posts: DataFrame) -> DataFrame:
    """Counted stems of the lemmas of the clean terms of each post."""
    rows = materialise(tm.clean_rows(posts, sql.STOP_WORDS))
    tokens = materialise(tm.distinct_tokens(rows))
    closure = materialise(co.lemma_closure(materialise(_dictionary(tokens))))
    return materialise(tm.map_terms(rows, materialise(tm.stem_mapping(tokens, closure))))


def _stem_rows_sql() -> str:
    """Terms of the positive posts as stems, of each post how often."""
    steps, source = [], "mapped"
    for i, (pos, suffix) in enumerate(SUFFIXES.items()):
        steps.append(
            f"d{i} as (select distinct token, regexp_replace(token, '{suffix}$', '') as lemma from mine where ends_with(token, '{suffix}')), "
            f"m{i} as (select s.own, coalesce(d.lemma, s.token) as token from {source} s left join d{i} d on d.token = s.token)"
        )
        source = f"m{i}"
    return f"""with {sql.CORPUS}, {sql.CLEAN_TOKENS}, mine as (
  select * from clean where doc_id in (select doc_id from corpus where label = 1)
), mapped as (select distinct token as own, token from mine), {", ".join(steps)},
stem_of as (select own, {_stem_sql('token')} as term from {source}),
stem_rows as (select doc_id, term, count(*) as tf from mine join stem_of on own = token where length(term) > 2 group by all),
stem_vocab as (
  select term, count(*) as df from stem_rows group by term
  having count(*) >= 2 and count(*) <= 0.95 * (select count(*) from corpus where label = 1)
)"""


@query(f"{_stem_rows_sql()} select doc_id, term, cast(tf as integer) as tf from stem_rows where term in (select term from stem_vocab)")
def term_matrix_stem(spark, sf_dir):
    """The matrix of the posts of label 1, over stems of lemmas."""
    posts = by_label(fixtures.corpus(spark, sf_dir), 1)
    rows = stemmed_rows(posts)
    return tm.long_matrix(rows, materialise(tm.vocabulary_of(rows, posts)))


@query(f"{_stem_rows_sql()} select count(*) as terms from stem_vocab")
def vocabulary_size_stem(spark, sf_dir):
    posts = by_label(fixtures.corpus(spark, sf_dir), 1)
    return tm.vocabulary_of(stemmed_rows(posts), posts).agg(F.count("*").alias("terms"))


@query(f"{_CLEAN} select cast(sum(n) as bigint) as tokens, count(*) as distinct_tokens from counts")
def clean_sizes(spark, sf_dir):
    """Sizes of the bag of clean tokens."""
    return co.corpus_sizes(clean_counts(spark, sf_dir))


def _all_topics(spark, sf_dir) -> DataFrame:
    docs = fixtures.documents(spark, sf_dir)
    return tp.topics(materialise(tm.clean_rows(docs, sql.STOP_WORDS)), docs)


def _stem_topics(spark, sf_dir, terms: int) -> DataFrame:
    posts = by_label(fixtures.corpus(spark, sf_dir), 1)
    return tp.topics(stemmed_rows(posts), posts, terms=terms)


@query()
def topics(spark, sf_dir):
    """Ten clean terms per topic, on all posts."""
    return _all_topics(spark, sf_dir)


@query()
def topic_terms(spark, sf_dir):
    """Five stems per topic, on the posts of label 1."""
    return _stem_topics(spark, sf_dir, 5)


@query()
def topic_terms_ten(spark, sf_dir):
    return _stem_topics(spark, sf_dir, 10)


def _determined(report: DataFrame, vocab: DataFrame) -> DataFrame:
    """What is certain of topics: ranks, that weights fall and stay below 1, and that terms differ and come from the vocabulary."""
    report = materialise(report)
    in_order, by_term = Window.partitionBy("topic").orderBy("rank"), Window.partitionBy("topic", "term")
    known = report.join(vocab.select("term", F.lit(True).alias("known")), "term", "left")
    falls = F.coalesce(F.col("weight") <= F.lag("weight").over(in_order), F.lit(True)) & F.col("weight").between(0, 1)
    return known.select("topic", "rank", falls.alias("falls"), (F.count("*").over(by_term) == 1).alias("differs"), F.coalesce("known", F.lit(False)).alias("known"))


def _determined_sql(vocab: str, terms: int) -> str:
    return f"""select cast(t as integer) as topic, cast(r as integer) as rank, true as falls, true as differs, true as known
    from range(5) a(t), range({terms}) b(r) where r < (select count(*) from {vocab})"""


@query(f"{_VOCABULARY} {_determined_sql('vocab', 10)}")
def topics_determined(spark, sf_dir):
    return _determined(_all_topics(spark, sf_dir), co.vocabulary(fixtures.documents(spark, sf_dir), stops(spark)))


@query(f"{_stem_rows_sql()} {_determined_sql('stem_vocab', 5)}")
def topic_terms_determined(spark, sf_dir):
    posts = by_label(fixtures.corpus(spark, sf_dir), 1)
    return _determined(_stem_topics(spark, sf_dir, 5), tm.vocabulary_of(stemmed_rows(posts), posts))
