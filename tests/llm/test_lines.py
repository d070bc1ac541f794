"""Templates with strays, several in a leaf, clashing columns; the SQL on made-up lines."""

import random

import duckdb
import pandas as pd
import pytest

from agoralens.llm import line_templates as lt, sql

NAMES = [f"{a}{b}" for a in ("an", "be", "ca", "do", "el", "fa", "gu", "ha", "io", "ju", "ka", "le", "mi", "no", "ol", "pa", "qu", "ra", "su", "ti") for b in "abcdefghijklmnopqrstuvwxy"]


def dropped(frame, rows):
    return {r.doc_id: r.n_dropped for r in lt.drop_recurring_lines(frame(rows)).collect()}


def test_template_survives_strays(frame):
    rows = [(k, f"the user called {n} has left the room") for k, n in enumerate(NAMES)]
    strays = [(1000, "the user called zzz did go on home"), (1001, "the user called zzy may come in again"), (1002, "the user called zzx was here all night")]
    got = dropped(frame, rows + strays)
    assert sum(got.values()) == 499 and got[0] == 0 and not any(got[k] for k, _ in strays)


def test_templates_that_share_a_leaf(frame):
    rows = [(2 * k, f"the user called {n} has left the room") for k, n in enumerate(NAMES[:60])]
    rows += [(2 * k + 1, f"the user called {n} did go on home") for k, n in enumerate(NAMES[30:90])]
    got = dropped(frame, rows)
    assert sum(got.values()) == 118 and got[0] == got[1] == 0


def test_two_variable_fields(frame):
    rng = random.Random(4)
    pairs = {(rng.choice(NAMES), rng.choice(NAMES)) for _ in range(200)}
    rows = [(k, f"at the door {a} met the friend of {b} in the early morning") for k, (a, b) in enumerate(sorted(pairs))]
    got = dropped(frame, rows + [(900, "at the door nobody saw any cat or dog on that very day")])
    assert sum(got.values()) == len(pairs) - 1 and got[900] == 0


def test_unlike_lines_of_a_leaf_stay(frame):
    rng = random.Random(5)
    rows = [(k, "once upon a " + " ".join(rng.choice(NAMES) for _ in range(7))) for k in range(100)]
    assert not any(dropped(frame, rows).values())


def test_short_lines_and_copies(frame):
    """Below seven words one variable word is too large a share; equal texts alone don't make a line recur."""
    rows = [(k, f"the user called {n}") for k, n in enumerate(NAMES[:20])]
    copies = [(100 + k, "the user called anna has left the room\nthe user called bert has left the room\nthe user called cleo has left the room") for k in range(5)]
    assert not any(dropped(frame, rows + copies).values())


def test_any_other_column_stays(spark):
    rows = [(k, f"the user called {n} has left the room", k, "a", "b", 7, 1.5, "n") for k, n in enumerate(NAMES[:5])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, gone int, of string, text_of string, id_of int, own double, n_lines string")
    out = lt.drop_recurring_lines(df)
    assert out.columns == ["doc_id", "text", "gone", "of", "text_of", "id_of", "own", "n_lines", "n_dropped"]
    got = out.orderBy("doc_id").collect()
    assert [(r.gone, r.of, r.text_of, r.id_of, r.own, r.n_lines, r.n_dropped) for r in got] == [(k, "a", "b", 7, 1.5, 1, int(k > 0)) for k in range(5)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_sql(frame, seed):
    rng = random.Random(seed)
    few = NAMES[:6]

    def line():
        kind = rng.randrange(5)
        if kind == 0:
            return f"the user called {rng.choice(NAMES)} has left the {rng.choice(few)} and page {rng.randrange(99)}"
        if kind == 1:
            return f"  the user  called {rng.choice(few)} did go\tto the {rng.choice(NAMES)} in v{rng.randrange(9)} "
        if kind == 2:
            return " ".join(rng.choice(few) for _ in range(rng.randrange(3, 12)))
        if kind == 3:
            return f"one two three {rng.choice(few)} {rng.choice(few)} {rng.choice(few)} seven eight nine ten eleven twelve thirteen"
        return rng.choice(["", "short line", "see page 12 of the old book now"])

    rows = [(k, "\n".join(line() for _ in range(rng.randrange(0, 9)))) for k in range(120)]
    rows += [(200 + k, rows[k][1]) for k in range(5)] + [(300, None), (301, "")]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    want = {r[0]: r[1:] for r in duckdb.sql(sql.line_dedup(lt.LEAST_WORDS, lt.LEADING, lt.VARIANTS, lt.AGREE)).select("doc_id, text, n_lines, n_dropped").fetchall()}
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lt.drop_recurring_lines(frame(rows)).collect()}
    assert len(documents) == len(got) and got == want and sum(x[2] for x in got.values()) > 50
