"""Line dedup by a log-template tree, in DataFrame operations only.

A line is parsed by its number of words, then by its leading words, words with
a digit being variable. The lines of a leaf are grouped by masked forms: their
words with one other position as a wildcard, or with all positions in which no
word holds half of the leaf's lines. A masked form with enough different lines
is a template by itself, whatever else its leaf holds; elsewhere a line's own
words are its template. Lines of a template that recurs across different texts
are dropped, except the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from agoralens.session import materialise, scoped

#: Words of a line that may be dropped, leading words, different lines of a template, least share of the other positions that isn't masked.
LEAST_WORDS, LEADING, VARIANTS, AGREE = 4, 3, 3, 0.7

#: Stands behind all positions, for the mask of several.
SEVERAL = 2**31 - 1

# What separates words, and the mark of a variable field.
SPACE, VARIABLE = r"[\x20\x09-\x0D]+", "<*>"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _form(line: Column) -> Column:
    """The words of a line with single blanks, those with a digit as variable. Lines have no line end; what need not be replaced isn't."""
    odd = F.contains(line, F.lit("  ")) | line.startswith(" ") | line.endswith(" ")
    for c in "\t\v\f\r":
        odd = odd | F.contains(line, F.lit(c))
    spaced = F.when(odd, F.trim(F.regexp_replace(line, SPACE, " "))).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(spaced, "[^ ]*[0-9][^ ]*", VARIABLE)).otherwise(spaced)


def _size(form: Column) -> Column:
    return F.length(form) - F.length(F.replace(form, F.lit(" "), F.lit(""))) + 1


def parsed(docs: DataFrame) -> DataFrame:
    """doc_id, of (hash of the text), pos, form, its hash `own` and its leaf, of each line that may be dropped."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    forms = rows.select("doc_id", "of", "pos", _form(F.col("line")).alias("form")).withColumn("n", _size(F.col("form")))
    leaf = F.xxhash64("n", F.substring_index("form", " ", LEADING)).alias("leaf")
    return forms.filter(F.col("n") >= LEAST_WORDS).select("doc_id", "of", "pos", "form", leaf, F.xxhash64("form").alias("own"))


def _merged() -> list[Column]:
    return [F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first")]


def _at(position: Column, word: Column) -> Column:
    return F.xxhash64(position, word)


def templates(forms: DataFrame) -> DataFrame:
    """leaf, own, first: the first line of its template for every form that has one.

    `forms` has leaf, own, form, low, high, first of the different lines of
    leaves with several. A masked form is known by the exclusive or of hashes of
    its (position, word), so masking one position costs the same in a long line
    as in a short one.
    """
    word = F.split("form", " ")
    forms = forms.select("leaf", "own", "low", "high", "first", word.alias("words"))
    places = forms.select("leaf", F.posexplode("words").alias("at", "word")).filter(f"at >= {LEADING}")
    counted = places.groupBy("leaf", "at", "word").agg(F.count("*").alias("n"))
    loose = counted.groupBy("leaf", "at").agg(F.max("n").alias("top"), F.sum("n").alias("n")).filter("2 * top < n")
    loose = loose.groupBy("leaf").agg(F.array_agg("at").alias("loose"))
    whole = F.aggregate(F.transform("words", lambda w, k: _at(k, w)), F.lit(0).cast("long"), lambda x, h: x.bitwiseXOR(h))
    keyed = forms.join(loose, "leaf", "left").withColumns({"whole": whole, "others": F.size("words") - LEADING})

    def masked(key: Column, at: Column) -> Column:
        return key.bitwiseXOR(_at(at, F.get("words", at))).bitwiseXOR(_at(at, F.lit(VARIABLE)))

    fixed = F.sequence(F.lit(LEADING), F.size("words") - 1)
    one = F.transform(F.filter(fixed, lambda k: F.get("words", k) != VARIABLE), lambda k: F.struct(k.alias("at"), masked(F.col("whole"), k).alias("key")))
    own_loose = F.filter("loose", lambda k: F.get("words", k) != VARIABLE)
    several = F.aggregate(own_loose, F.col("whole"), masked)
    room = (1 - AGREE) * F.col("others") + 1e-9
    none = F.array().cast("array<struct<at:int,key:bigint>>")
    keys = F.concat(
        F.when(room >= 1, one).otherwise(none),
        F.when((F.size(own_loose) > 1) & (F.size(own_loose) <= room), F.array(F.struct(F.lit(SEVERAL).alias("at"), several.alias("key")))).otherwise(none),
    )
    rows = materialise(keyed.select("leaf", "own", "low", "high", "first", F.inline(keys)))
    groups = rows.groupBy("leaf", "key").agg(F.count("*").alias("variants"), F.min("low").alias("low"), F.max("high").alias("high"))
    groups = groups.filter(f"variants >= {VARIANTS} and low <> high").select("leaf", "key", "variants")
    best = rows.join(groups, ["leaf", "key"]).groupBy("leaf", "own").agg(F.min("first").alias("first"), F.min_by("key", F.struct(-F.col("variants"), "at")).alias("key"))
    best = materialise(best)
    return best.select("leaf", "own", "key").join(best.groupBy("leaf", "key").agg(F.min("first").alias("first")), ["leaf", "key"]).select("leaf", "own", "first")


@scoped
def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, of, pos of the lines to drop, written. The texts are parsed once, and the parsed lines gone at the end."""
    lines = materialise(parsed(docs), compression="zstd")
    place = F.struct("doc_id", "pos", "of")
    own = materialise(lines.groupBy("leaf", "own").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.min(place).alias("first")))
    wide = own.groupBy("leaf").agg(F.count("*").alias("variants"), F.min("low").alias("low"), F.max("high").alias("high"))
    wide = materialise(wide.filter(f"variants >= {VARIANTS} and low <> high").select("leaf"))
    spelled = lines.join(wide, "leaf", "left_semi").groupBy("leaf", "own").agg(F.any_value("form").alias("form"))
    found = templates(materialise(spelled.join(own, ["leaf", "own"])))
    recurring = own.filter("low <> high").select("leaf", "own", "first")
    recurring = recurring.join(found.select("leaf", "own"), ["leaf", "own"], "left_anti").union(found)
    gone = lines.select("doc_id", "of", "pos", "leaf", "own").join(materialise(recurring), ["leaf", "own"])
    return materialise(gone.filter(~F.col("first").eqNullSafe(place)).select("doc_id", "of", "pos"))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """`docs` with the lines dropped from `text`, and n_lines, n_dropped.

    `docs` needs doc_id and text; its other columns stay whatever their names,
    but for columns named n_lines and n_dropped, which are replaced. Templates that
    occur in one text only, however many documents copy it, don't recur. The
    first line by (doc_id, position) stays. A null text stays null and has no
    lines; an empty one has one line and stays empty. Repeated rows are treated
    alike. Lines below the least number of words always stay. A null id counts
    as the smallest. A form that fits several templates belongs to the one with
    the most different lines, of equals to the one whose mask stands first.
    """
    gone = dropped_lines(docs).groupBy("doc_id", "of").agg(F.collect_set("pos").alias("gone"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("of"))
    at = gone.select(F.col("doc_id").alias("id_of"), F.col("of").alias("text_of"), "gone")
    joined = rows.join(at, F.col("id").eqNullSafe(F.col("id_of")) & (F.col("of") == F.col("text_of")), "left")
    before = F.col("row.text")
    left = F.array_join(F.filter(_lines(before), lambda line, k: ~F.array_contains("gone", k)), "\n")
    text = F.when(F.col("gone").isNull(), before).otherwise(left)
    columns = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    n_lines = F.coalesce(F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return joined.select(*columns, n_lines.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
