"""Text expressions. All are built-in columns, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

from agoralens.schema import ERROR_PREDICTION, ERROR_PROBABILITY

# Patterns of the cleaning steps.
NON_ASCII = r"[^\x00-\x7F]+"
WHITESPACE = r"\s+"
NEWLINES = r"[\n\r]"
NON_ALNUM = r"[^A-Za-z0-9]+"
ALPHABETIC = r"^[A-Za-z]+$"
ACCENTED = "áàäéèëíìïóòöúùü"
UNACCENTED = "aaaeeeiiiooouuu"

# Fields of a scorer's JSON reply.
REPLY_FIELDS = "clase INT, probabilidad DOUBLE"

# Token patterns. COUNT_TOKENS approximates a sub-word tokeniser (letter runs,
# digits in threes, symbol runs); WORD_TOKENS gives words and single symbols.
COUNT_TOKENS = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"
WORD_TOKENS = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
DROPPED_WORD_CHARS = r"[\p{L}\p{N}_&&[^a-z0-9]]+"
MARK = "_"


def strip_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, NON_ASCII, "")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, WHITESPACE, " ")


def newlines_to_space(text: Column) -> Column:
    return F.regexp_replace(text, NEWLINES, " ")


def trim_spaces(text: Column) -> Column:
    return F.trim(text)


def clean_text(text: Column) -> Column:
    """ASCII only, single spaces, no outer spaces.

    The newline step is left out: collapsing whitespace has already turned
    every newline into a space, and one regex pass less matters on a big scan.
    """
    return trim_spaces(collapse_whitespace(strip_non_ascii(text)))


def token_count(text: Column, pattern: str = COUNT_TOKENS) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def encoded_token_count(make_encoder: Callable[[], Callable[[str], Sequence]]):
    """Token count by an injected encoder, built once per task.

    Returns a function on a text column. Arrow batches keep the cost per row
    down, but the built-in `token_count` is the fast path.
    """

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else len(encode(t))).astype("Int32")

    return count


def word_count(text: Column) -> Column:
    return F.size(F.split(text, " "))


def tokenize(text: Column, pattern: str = WORD_TOKENS) -> Column:
    """Words and symbols in order; a null text has no tokens."""
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.coalesce(tokens, F.array().cast("array<string>"))


def fold_accents(text: Column) -> Column:
    """Fold the fifteen lower-case accented vowels; capitals stay as they are."""
    return F.translate(text, ACCENTED, UNACCENTED)


def strip_non_alnum(text: Column) -> Column:
    return F.regexp_replace(text, NON_ALNUM, "")


def normal_form(token: Column) -> Column:
    """Fold, lower-case, keep ASCII letters and digits: in that order, so a
    capital accented vowel is dropped rather than folded."""
    return strip_non_alnum(F.lower(fold_accents(token)))


def is_alphabetic(token: Column) -> Column:
    return token.rlike(ALPHABETIC)


def longer_than(token: Column, n: int) -> Column:
    return F.length(token) > n


def folded_lower(text: Column) -> Column:
    """Accents folded, then lower case, on a whole text at once.

    Word boundaries stay where they are. The one letter whose lower case is
    more than a letter (dotted capital I) is mapped here, so that tokenising
    afterwards gives the tokens it gives before.
    """
    return F.lower(F.translate(text, ACCENTED + "\u0130", UNACCENTED + "i"))


def marked_tokens(text: Column) -> Column:
    """Tokens of a text, folded and in lower case, with a mark in place of the
    word characters that the normal form drops. There are as many of them, in
    the same order, as `tokenize` gives; `unmarked` makes them normal."""
    return tokenize(F.regexp_replace(folded_lower(text), DROPPED_WORD_CHARS, MARK))


def unmarked(token: Column) -> Column:
    return F.replace(token, F.lit(MARK), F.lit(""))


def is_marked_word(token: Column, longer: int) -> Column:
    """Letters and marks only, and long enough to matter."""
    return token.rlike(rf"^[a-z{MARK}]{{{longer + 1},}}$")


def clean_terms(text: Column, longer: int = 3) -> Column:
    """Tokens of a text in normal form that are letters only and longer than
    `longer`; stop words are not removed.

    Equal to cleaning token by token, in three passes over the text: fold and
    lower, drop the word characters that the normal form drops, take the runs
    of letters that are not part of a longer run.
    """
    ascii_words = F.regexp_replace(folded_lower(text), DROPPED_WORD_CHARS, "")
    pattern = rf"(?<![a-z0-9])[a-z]{{{longer + 1},}}(?![a-z0-9])"
    return F.regexp_extract_all(ascii_words, F.lit(pattern), F.lit(0))


def without(tokens: Column, stops: Iterable[str]) -> Column:
    """An array of tokens less a list of stop words, which becomes a hash set
    in the expression: nothing is joined or shuffled."""
    stops = list(stops)
    return F.filter(tokens, lambda t: ~t.isin(*stops)) if stops else tokens


def percentage(part: Column, whole: Column) -> Column:
    return part / whole * 100


def join_tokens(tokens: Column) -> Column:
    """One text per document; never the whole corpus on one row."""
    return F.array_join(tokens, " ")


def parse_reply(reply: Column) -> Column:
    """Scorer reply (JSON) to struct<prediction, prediction_prob>.

    Malformed text parses to a struct of nulls, so the fields are tested, not
    the struct; anything outside the domain becomes the error score.
    """
    parsed = F.from_json(reply, REPLY_FIELDS)
    label, prob = parsed["clase"], parsed["probabilidad"]
    valid = F.coalesce(label.isin(0, 1) & prob.between(0.0, 1.0), F.lit(False))
    return F.struct(
        F.when(valid, label).otherwise(F.lit(ERROR_PREDICTION)).alias("prediction"),
        F.when(valid, prob).otherwise(F.lit(ERROR_PROBABILITY)).alias("prediction_prob"),
    )
