"""SQL fragments shared by the check queries (DuckDB dialect)."""

from __future__ import annotations

# Parameters of the registered queries.
START_PROCESSED = "2024-01-02"
START_ENQUEUED = "2024-01-02"
STOP_WORDS = [
    "avec", "como", "dans", "desde", "durch", "eine", "einen", "elle", "entre", "esta", "este", "from", "have",
    "nicht", "para", "pero", "por", "pour", "sich", "sobre", "that", "this", "todo", "with", "être", "también", "über",
]
LEXICON = {
    "alone": 1.5,
    "worthless": 2.0,
    "with": 0.5,
    "this": -0.75,
    "from": 0.75,
    "was": -0.5,
    "para": 1.0,
    "por": -0.5,
    "una": 0.75,
    "pour": 1.0,
    "dans": -0.5,
    "avec": 0.5,
    "nicht": 1.25,
    "sich": -0.75,
    "von": 0.5,
}
LEXICON_BIAS = -0.5

# The patterns and the accent table that the meaning of the operators demands.
COUNT_PATTERN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"
WORD_PATTERN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def clean(text: str) -> str:
    ascii_only = rf"regexp_replace({text}, '[^\x00-\x7F]+', '', 'g')"
    one_space = rf"regexp_replace({ascii_only}, '[ \t\n\x0B\f\r]+', ' ', 'g')"
    return f"trim({one_space})"


def count_tokens(text: str) -> str:
    return f"cast(len(regexp_extract_all({text}, '{COUNT_PATTERN}')) as integer)"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORD_PATTERN}')"


def fold(token: str) -> str:
    return f"translate({token}, 'áàäéèëíìïóòöúùü', 'aaaeeeiiiooouuu')"


def normal(token: str) -> str:
    return f"regexp_replace(lower({fold(token)}), '[^A-Za-z0-9]+', '', 'g')"


def stop_list() -> str:
    return "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def score(text: str) -> tuple[str, str]:
    """Distinct lexicon hits of a text, and the logit of a column of hits."""
    terms = "|".join(LEXICON)
    hits = rf"list_distinct(regexp_extract_all(lower({text}), '\b(?:{terms})\b'))"
    cases = " ".join(f"when '{t}' then {w}::double" for t, w in LEXICON.items())
    total = f"({LEXICON_BIAS} + coalesce(list_sum(list_transform(hits, lambda h: case h {cases} end)), 0.0))"
    return hits, total


POSTS = """posts as (
  select d.doc_id as post_id, d.source as subreddit, e.event_type as thread, d.text as user_posting,
         o.o_custkey as author, o.o_orderdate as post_date,
         e.ts + interval '1' hour as processed_utc, e.ts as enqueued_utc
  from documents d join orders o on o.o_orderkey = d.doc_id join events e on e.event_id = d.doc_id
  union all
  select d.doc_id, d.source, e.event_type, d.text, o.o_custkey, o.o_orderdate,
         e.ts + interval '1' day + interval '1' hour, e.ts + interval '1' day
  from documents d join orders o on o.o_orderkey = d.doc_id join events e on e.event_id = d.doc_id
  where d.doc_id % 7 = 0
)"""

CLEANED = f"{POSTS}, cleaned as (select * replace ({clean('user_posting')} as user_posting) from posts)"
COUNTED = f"{CLEANED}, counted as (select *, {count_tokens('user_posting')} as token_count from cleaned)"

_hits, _total = score("user_posting")
SCORED = f"""{COUNTED}, hits as (select *, {_hits} as hits from counted),
logits as (select * exclude (hits), 1 / (1 + exp(-{_total})) as p from hits),
scored as (
  select * exclude (p),
         case when token_count > 10 then cast(p >= 0.5 as integer) end as prediction,
         case when token_count > 10 then round(greatest(p, 1 - p), 6) end as prediction_prob
  from logits
)"""

CORPUS = f"""corpus as (
  select d.doc_id, d.text, l.toxic as label from documents d join labels l on l.doc_id = d.doc_id
), lengths as (
  select doc_id, label, cast(len({words('text')}) as integer) as count_text from corpus
)"""

BOUNDS = f"""{CORPUS}, quart as (
  select label, quantile_cont(count_text, 0.25) as q1, quantile_cont(count_text, 0.75) as q3,
         quantile_cont(count_text, 0.5) as q2
  from lengths group by label
), bounds as (
  select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower_bound, q3 + 1.5 * (q3 - q1) as upper_bound from quart
)"""

TOKENS = f"""tokens as (
  select doc_id, cast(generate_subscripts(w, 1) - 1 as integer) as pos, unnest(w) as token
  from (select doc_id, {words('text')} as w from documents)
)"""

NORMAL = f"{TOKENS}, normal as (select doc_id, pos, {normal('token')} as token from tokens)"

CLEAN_TOKENS = f"""{NORMAL}, clean as (
  select doc_id, pos, token from normal
  where token not in {stop_list()} and regexp_full_match(token, '[A-Za-z]+') and length(token) > 3
)"""

TOKENS_OF_POSTS = f"{POSTS}, post_tokens as (select *, unnest({words('user_posting')}) as token from posts)"
