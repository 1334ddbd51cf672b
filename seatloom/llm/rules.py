"""Operator 1, quality rules: thresholds from mergeable quantile sketches per language and source.

Native: DataFrame functions only. Measures are computed within each row. Quantile sketches of them
are built per language and source, merged to sketches per language and over all, and read as
quartiles; a document is then joined with the fences of its group and kept if it lies inside them.

A fence has no constant of its own measure. Beyond the quartile it leaves room for the group's spread
and for chance: the score limit of a rate or share at the quartile, seen over as many words, lines or
characters as the group's first quartile of documents has. So fences are tighter where documents are
longer or vary less. Groups lean on their language, and languages on all rows, by PRIOR_ROWS rows, so
that small and large groups have fences by the same rule.

A sketch counts values in bins whose width follows the value, BINS to a power of two. Counts add, so
merging is exact and independent of the order of rows and tasks: each run gives the same fences. A
quantile has no error in rank and comes as its bin's lower edge, at most 1 / BINS below the true
value in relative terms (absolute ones below 1).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialize

#: White space that separates words, and the length of the windows that are looked for twice.
SPACES = " \t\n\x0b\f\r"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Bins of a sketch in each power of two, a power of two itself.
BINS = 256
#: Rows' worth of its language that a group's quartiles have beside its own rows, and a language's of all rows.
PRIOR_ROWS = 10
#: A fence lies this many times the quartiles' distance, and the score limit of this many standard errors, beyond a quartile.
FENCE, ERRORS = 3.0, 4.0
#: Measure: (what it is a part of, whether it is at most 1, whether it has a lower fence). All have an upper one.
MEASURES = {
    "symbols_per_word": ("words", False, False),
    "chars_per_word": ("words", False, True),
    "dup_line_share": ("lines", True, False),
    "repeat_word_share": ("windows", True, False),
    "mark_share": ("chars", True, False),
    "upper_share": ("chars", True, False),
}
#: What sketches count: the measures, and the sizes that say how much of them is chance.
SKETCHED = (*MEASURES, "n_words", "n_lines")


def _repeat_words() -> Column:
    """Words within 8-word windows that occur twice or more. Windows are compared by XXH64 of their words.

    Texts without a repeated window, nearly all, end at the comparison of two counts. Else window
    hashes are sorted with their places; equal neighbours give the repeated places, and consecutive
    repeated places at most 8 apart share words.
    """
    hashes = f"transform(sequence(1, n_words - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW})))"
    sort = "array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))"
    places = "array_sort(transform(filter(s, (e, k) -> (k > 0 AND s[k - 1].x = e.x) OR (k < size(s) - 1 AND s[k + 1].x = e.x)), e -> e.i))"
    cover = f"aggregate(p, struct(0L AS n, CAST(NULL AS INT) AS last), (a, i) -> struct(a.n + coalesce(least({WINDOW}, i - a.last), {WINDOW}) AS n, i AS last), a -> a.n)"
    steps = f"aggregate(array(1), 0L, (z, o) -> {cover})"
    for name, value in (("p", places), ("s", sort)):
        # one-element transforms name a value, so that it is computed once
        steps = f"element_at(transform(array({value}), {name} -> {steps}), 1)"
    found = f"element_at(transform(array({hashes}), h -> CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {steps} END), 1)"
    return F.expr(f"CASE WHEN n_words > {WINDOW} THEN {found} ELSE 0L END")


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: bool = False) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, MEASURES and n_lines).

    A null text has no words. One row per input row, computed within it: no shuffle. With carry, the
    whole input row follows as a struct named row.
    """
    extra = ["row"] * carry
    rows = df.select(column(df, id_col, "doc_id", "long"), column(df, lang_col, "lang", "string"), column(df, source_col, "source", "string"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), *[F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")] * carry)
    rows = rows.withColumn("trimmed", F.btrim("text", F.lit(SPACES)))
    rows = rows.withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", r"[\x20\x09-\x0D]+")))
    lined = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    chars = lambda pattern: F.length(F.regexp_replace("text", pattern, "")).cast("long")
    rows = rows.select(
        "doc_id", "lang", "source", "words", *extra,
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        chars(r"[^#*$%&|<>]+").alias("n_symbols"),
        chars(r"[^!?\"'()\[\]{}=+/\\^~_@;:-]+").alias("n_marks"),
        chars(r"[^A-ZÀ-ÖØ-Þ]+").alias("n_upper"),
        F.transform(F.array(lined), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))[0].alias("line"),
    )
    rows = rows.withColumn("n_repeat_words", _repeat_words()).drop("words")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rows = rows.withColumns({"n_words": F.col("n_words").cast("long"), "n_dup_lines": (F.col("line.n") - F.col("line.distinct")).cast("long"), "n_lines": F.col("line.n").cast("long")})
    return rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("word_chars", "n_words").alias("chars_per_word"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_word_share"),
        share("n_marks", "word_chars").alias("mark_share"),
        share("n_upper", "word_chars").alias("upper_share"), "n_lines", *extra,
    )


def binned(x: Column | str) -> Column:
    """The lower edge of a value's bin. Values are 0 or more."""
    whole = F.floor((F.col(x) if isinstance(x, str) else x) * BINS).cast("bigint")
    shift = F.greatest(F.length(F.bin(whole)) - (BINS.bit_length()), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", whole, shift), shift) / float(BINS)


def sketches(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, bin, n): a sketch of each of SKETCHED for each group of keys, as its bins' counts, summed map-side first."""
    each = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), binned(m).alias("bin")) for m in SKETCHED))).alias("x"))
    return each.groupBy(*keys, "x.measure", "x.bin").agg(F.count("*").alias("n"))


def merge_sketches(groups: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups from those of finer ones, without going back to the rows."""
    return groups.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quartiles(groups: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, <measure>_1, <measure>_3): rows and the first and third quartile of each of SKETCHED, the least value with that share of rows at or below it."""
    own = Window.partitionBy(*keys, "measure")
    ranked = groups.withColumns({"upto": F.sum("n").over(own.orderBy("bin")), "rows": F.sum("n").over(own)})
    at = lambda m, p: F.min(F.when((F.col("measure") == m) & (F.col("upto") >= F.ceil(F.col("rows") * p)), F.col("bin")))
    ends = [at(m, p).alias(f"{m}_{name}") for m in SKETCHED for p, name in ((0.25, 1), (0.75, 3))]
    return ranked.groupBy(*keys).agg(F.max("rows").alias("n"), *ends)


_QUARTILES = [f"{m}_{k}" for m in SKETCHED for k in (1, 3)]


def _lean(own: str, n: str, other: dict[str, Column], rows: int) -> list[Column]:
    """Quartiles of a group of n rows, moved towards others' as rows of those would move a mean."""
    return [((F.col(n) * F.col(f"{own}.{q}") + rows * other[q]) / (F.col(n) + rows)).alias(q) for q in _QUARTILES]


def _limit(q: Column, n: Column, share: bool, sign: int) -> Column:
    """The score limit, above (sign 1) or below (-1), of a rate or share q seen over n trials."""
    square = ERRORS * ERRORS
    error = F.sqrt((q * (1 - q) if share else q) / n + square / (4 * n * n))
    limit = q + square / (2 * n) + sign * ERRORS * error
    return limit / (1 + square / n) if share else limit


def _fence(at: Callable[[str], Column]) -> Column:
    """A struct of <measure>_low (null where there is none) and <measure>_high, from a group's quartiles."""
    words = at("n_words_1")
    trials = {"words": words, "lines": at("n_lines_1"), "windows": words / WINDOW, "chars": words * at("chars_per_word_1")}
    ends = []
    for m, (part, share, low) in MEASURES.items():
        one, three = at(f"{m}_1"), at(f"{m}_3")
        spread = (three - one) * FENCE
        ends.append((_limit(one, trials[part], share, -1) - spread if low else F.lit(None).cast("double")).alias(f"{m}_low"))
        ends.append((_limit(three, trials[part], share, 1) + spread).alias(f"{m}_high"))
    return F.struct(*ends)


def fences(rows: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(lang_key, source_key, n, fence) for each group of measures() with rows that pass the base rules, n of them."""
    fine = materialize(sketches(rows.where("not base_failed"), "lang_key", "source_key"), "sketches")
    coarse = materialize(merge_sketches(fine, "lang_key"), "sketches")
    overall = quartiles(merge_sketches(coarse)).first()  # one row: quartiles of all rows are constants
    of_all = {q: F.lit(overall[q] if overall else None).cast("double") for q in _QUARTILES}
    own = F.struct(*_QUARTILES).alias("own")
    langs = quartiles(coarse, "lang_key").select("lang_key", "n", own)
    langs = langs.select("lang_key", F.struct(*_lean("own", "n", of_all, prior_rows)).alias("of_lang"))
    groups = quartiles(fine, "lang_key", "source_key").select("lang_key", "source_key", "n", own).join(langs, "lang_key")
    groups = groups.select("lang_key", "source_key", "n", F.struct(*_lean("own", "n", {q: F.col(f"of_lang.{q}") for q in _QUARTILES}, prior_rows)).alias("q"))
    return groups.select("lang_key", "source_key", "n", _fence(lambda c: F.col(f"q.{c}")).alias("fence"))


def with_keys(rows: DataFrame) -> DataFrame:
    """Add lang_key and source_key, in which a null is a value of its own."""
    return rows.withColumns({f"{k}_key": F.concat(F.when(F.col(k).isNull(), "-").otherwise("+"), F.coalesce(k, F.lit(""))) for k in ("lang", "source")})


def apply_rules(rows: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """Add kept to measures().

    Fences come from the rows that pass the base rules. A group is a language and source; nulls are a
    language or source of their own. A row of a group in which none passes them isn't kept.
    """
    named = with_keys(rows)
    ends = materialize(fences(named, prior_rows), "fences").select(F.col("lang_key").alias("lang_of"), F.col("source_key").alias("source_of"), "fence")
    joined = named.join(ends, (F.col("lang_key") == F.col("lang_of")) & (F.col("source_key") == F.col("source_of")), "left")
    inside = F.lit(True)
    for m, (_, _, low) in MEASURES.items():
        inside = inside & (F.col(m) <= F.col(f"fence.{m}_high")) & ((F.col(m) >= F.col(f"fence.{m}_low")) if low else F.lit(True))
    return joined.withColumn("kept", F.coalesce(~F.col("base_failed") & inside, F.lit(False))).select(*rows.columns, "kept")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """measures() and kept for every row of df. Texts are read once; their measures are written to the shared folder.

    A group's quartiles lean on its language's by prior_rows rows, and those on all rows'. A null or
    empty text has no words and isn't kept.
    """
    return apply_rules(materialize(measures(df, id_col, text_col, lang_col, source_col), "measures"), prior_rows)


def keep_passing(df: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """The whole rows of df that quality_rules() keeps. They travel with their measures, so texts are measured once."""
    return apply_rules(materialize(measures(df, carry=True), "measures"), prior_rows).where("kept").select("row.*")
