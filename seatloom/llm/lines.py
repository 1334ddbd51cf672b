"""Operator 10, line dedup: repeated runs of lines, found in a suffix array by distributed prefix doubling.

Native: DataFrame functions only. Documents are sequences of line IDs. Suffixes are ranked by their
first 1, 2, 4, ... lines until no two agree any more, which is the order of the suffix array. Ranks
keep that order, so suffixes of equal rank are an interval of the array whose longest common prefix
is that many lines at least. Of each interval the first place in the corpus stays and the others are
later copies; copies that overlap in a document make up its maximal repeated runs, which are deleted
if they have min_words words.

Intervals of 1, 2, 4, ... lines cover every run but for its ends: two of the longest that fit cover
it wholly. Where those have fewer than min_words words, and so fewer than min_words lines, the depth
between two powers matters: a run is then the union of the shortest runs of min_words words that
begin or end at its lines, whose intervals are named by the two ranks that cover them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_crowded, materialize
from .rules import SPACES

MIN_WORDS = 10
#: Bits of the broadcast filter that keeps most rows without a cut out of the last join: 4 MB.
FILTER_BITS = 1 << 25

_KEY = ["doc", "h1", "h2"]


def _found_lines(text: Column) -> Column:
    """The lines of a text without outer white space, those without a word empty."""
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)))


def line_sequences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, h1, h2, words, n, lines): each document's lines that have a word, n of them, as (i, a, b, w).

    i: place among all lines; a, b: 128 bits of XXH64 of the line without outer white space; w: words, of
    which no more than min_words + 1 are told apart, since a line of min_words is a run by itself; words:
    their sum. h1, h2: the same of the whole text as a, b, which with the id names a document.
    """
    rows = df.select(df[id_col].cast("long").alias("doc"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    line = lambda x, i: F.struct(i.cast("int").alias("i"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.size(F.split(x, r"[\x20\x09-\x0D]+", min_words + 1)).alias("w"), (x == "").alias("blank"))
    found = F.transform(_found_lines(F.col("text")), line)
    rows = rows.select("doc", *_hashes(F.col("text")), F.filter(found, lambda x: ~x["blank"]).alias("lines"))
    rows = rows.withColumn("lines", F.transform("lines", lambda x: F.struct(x["i"].alias("i"), x["a"].alias("a"), x["b"].alias("b"), x["w"].alias("w"))))
    return rows.withColumns({"words": F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["w"]), "n": F.size("lines")})


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def order_ranks(keys: DataFrame, *cols: str) -> DataFrame:
    """Add rank to different keys: an increasing number in their global order, from a range-partitioned sort."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("rank", F.monotonically_increasing_id())


def first_ranks(lines: DataFrame) -> DataFrame:
    """(doc, h1, h2, q, rank) of lines that occur more than once, ranked by their ID."""
    repeated = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    ranked = materialize(order_ranks(repeated, "a", "b"), "ranks")
    return lines.select(*_KEY, "q", "a", "b").join(ranked, ["a", "b"]).select(*_KEY, "q", "rank")


def doubled_ranks(ranks: DataFrame, step: int) -> DataFrame:
    """Ranks by 2 * step lines from ranks by step lines: (doc, h1, h2, q, rank). Suffixes whose prefix occurs once drop out."""
    ahead = Window.partitionBy(*_KEY).orderBy("q").rangeBetween(step, step)
    pairs = materialize(ranks.withColumn("next", F.first("rank").over(ahead)).where("next is not null"), "pairs")
    keys = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rank").alias("r1"), F.col("next").alias("r2"))
    ranked = materialize(order_ranks(keys, "r1", "r2").select("r1", "r2", F.col("rank").alias("r")), "ranks")
    return pairs.join(ranked, (F.col("rank") == F.col("r1")) & (F.col("next") == F.col("r2"))).select(*_KEY, "q", F.col("r").alias("rank"))


def suffix_ranks(lines: DataFrame) -> list[tuple[int, DataFrame]]:
    """(step, ranks by the first step lines) for steps 1, 2, 4, ... while any prefix of that length occurs twice.

    The number of rounds is the logarithm of the longest repeated run.
    """
    levels, step = [], 1
    now = materialize(first_ranks(lines), "suffixes")
    while now.count():
        levels.append((step, now))
        now = materialize(doubled_ranks(now, step), "suffixes")
        step *= 2
    return levels


def _windows(min_words: int) -> Column:
    """The shortest runs of min_words words that begin or end at each line: array of (q, len), each once.

    A run that ends at a line is left out if it is also the shortest one that begins at its first line,
    which is so if it falls short without its last line.
    """
    step = f"aggregate({{}}, struct(0L AS w, 0 AS n, 0 AS last), (t, x) -> if(t.w >= {min_words}, t, struct(t.w + x.w AS w, t.n + 1 AS n, x.w AS last)))"
    forward = step.format(f"slice(lines, q + 1, {min_words})")
    backward = step.format(f"reverse(slice(lines, greatest(1, q + 2 - {min_words}), least(q + 1, {min_words})))")
    every = "sequence(0, size(lines) - 1)"
    begin = f"filter(transform({every}, q -> named_struct('q', q, 't', {forward})), x -> x.t.w >= {min_words})"
    end = f"filter(transform({every}, q -> named_struct('q', q, 't', {backward})), x -> x.t.w >= {min_words} AND x.t.w - lines[x.q].w >= {min_words})"
    return F.expr(f"concat(transform({begin}, x -> named_struct('q', x.q, 'len', x.t.n)), transform({end}, x -> named_struct('q', x.q + 1 - x.t.n, 'len', x.t.n)))")


def _later(intervals: DataFrame, *names: str) -> DataFrame:
    """(doc, h1, h2, q, len): the places of intervals, named by the columns given, but for the first of each in the corpus."""
    firsts = intervals.groupBy(*names).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select(*(F.col(c).alias(f"f_{c}") for c in names), "first")
    firsts = materialize(firsts, "firsts")  # so that both sides of the join are dealt out anew, and a crowded interval can be split
    on = [F.col(c) == F.col(f"f_{c}") for c in names]
    same = on[0]
    for more in on[1:]:
        same = same & more
    return intervals.join(firsts, same).where("place <> first").select("place.doc", "place.h1", "place.h2", "place.q", "len")


def later_copies(sequences: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, h1, h2, q, len): runs of len lines from line q on that occur before, of line_sequences() that are all different."""
    explode = lambda c: sequences.where("size(lines) > 0").select(*_KEY, c)
    lines = explode(F.posexplode("lines").alias("q", "line")).select(*_KEY, "q", "line.a", "line.b")
    levels = suffix_ranks(lines)
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "h1", "h2", "q").alias("place")
    kinds = {"len": "int", "r1": "long", "r2": "long", "place": "struct<none: boolean, doc: bigint, h1: bigint, h2: bigint, q: int>"}
    nothing = sequences.sparkSession.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()))
    found = []
    if levels:
        windows = explode(F.explode(_windows(min_words)).alias("x")).select(*_KEY, "x.q", "x.len")
        # A window begins at a repeated line, or it isn't repeated.
        windows = materialize(windows.join(levels[0][1].select(*_KEY, "q"), [*_KEY, "q"], "left_semi"), "windows")
        short = nothing
        for step, ranks in levels:
            if step > min_words:  # each line has a word at least, so a prefix of step lines is a run that counts
                found.append(_later(ranks.select(F.lit(step).alias("len"), "rank", place), "rank"))
                continue
            own = windows.where((F.col("len") >= step) & (F.col("len") < 2 * step))
            one = ranks.select(*_KEY, "q", F.col("rank").alias("r1"))
            two = ranks.select(*_KEY, F.col("q").alias("q2"), F.col("rank").alias("r2"))
            named = own.join(one, [*_KEY, "q"]).withColumn("q2", F.col("q") + F.col("len") - step).join(two, [*_KEY, "q2"])
            short = short.unionByName(named.select("len", "r1", "r2", place))
        found.append(_later(materialize(short, "intervals"), "len", "r1", "r2"))
    out = nothing.select("place.doc", "place.h1", "place.h2", "place.q", "len")
    for copies in found:
        out = out.unionByName(copies)
    return out


def maximal_runs(copies: DataFrame) -> DataFrame:
    """(doc, h1, h2, first, end): later_copies() of a document that overlap or touch, joined to runs of lines first to end - 1."""
    ordered = Window.partitionBy(*_KEY).orderBy("q", "len")
    reach = F.max(F.col("q") + F.col("len")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    begun = copies.withColumn("begins", F.when(reach >= F.col("q"), 0).otherwise(1))
    run = F.sum("begins").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return begun.withColumn("run", run).groupBy(*_KEY, "run").agg(F.min("q").alias("first"), F.max(F.col("q") + F.col("len")).alias("end")).drop("run")


def cuts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, h1, h2, n, deleted): documents that lose lines: how many lines with a word they have, and the places of the lost ones.

    deleted is null for a whole copy of an earlier document, which loses all.
    """
    sequences = materialize(line_sequences(df, id_col, text_col, min_words), "sequences")
    order = F.struct(F.col("doc").isNull().alias("none"), "doc")
    firsts = materialize(sequences.groupBy("h1", "h2").agg(F.min(order).alias("p"), F.count("*").alias("rows"), F.max("words").alias("words"), F.first("lines").alias("lines")).select("p.doc", "h1", "h2", "rows", "words", "lines"), "originals")
    copied = firsts.where((F.col("rows") > 1) & (F.col("words") >= min_words)).select(F.col("doc").alias("o"), F.col("h1").alias("o1"), F.col("h2").alias("o2"), "rows")
    copies = join_crowded(sequences.select(*_KEY, "n"), copied, [("h1", "o1"), ("h2", "o2")], "rows", sequences.count())
    whole = copies.where(~F.col("doc").eqNullSafe(F.col("o"))).select(*_KEY, "n").distinct().withColumn("deleted", F.lit(None).cast("array<int>"))
    runs = maximal_runs(later_copies(firsts, min_words)).groupBy(*_KEY).agg(F.collect_list(F.struct("first", "end")).alias("runs"))
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in _KEY]
    joined = runs.alias("f").join(firsts.alias("s"), same[0] & same[1] & same[2]).select(*(F.col(f"f.{k}") for k in _KEY), F.size("s.lines").alias("n"), "f.runs", F.col("s.lines.i").alias("i"))
    part = joined.select(*_KEY, "n", F.expr("array_sort(flatten(transform(runs, r -> slice(i, r.first + 1, r.end - r.first))))").alias("deleted"))
    return materialize(whole.unionByName(part), "cuts")


def _filtered(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """rows with hit: false for those whose h1 no cut has, true for those with a cut and a few others.

    The filter that is broadcast has FILTER_BITS bits, however many cuts there are.
    """
    bit = F.pmod("h1", F.lit(FILTER_BITS))
    bits = cut.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    rows = rows.withColumn("bit", bit).join(F.broadcast(bits), F.bitmap_bucket_number("bit") == F.col("bucket"), "left")
    octet = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(bit) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("shiftright({}, cast(bitmap_bit_position(bit) % 8 as int)) & 1".format("octet"))
    return rows.withColumn("octet", octet).withColumn("hit", F.coalesce(hit == 1, F.lit(False))).drop("bit", "bucket", "bits", "octet")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, counts: bool = True) -> DataFrame:
    """df's rows and columns with text_col cut; with counts also n_lines, n_deleted: lines with a word, and those deleted.

    Documents come in order of their id (nulls last), then of a hash of their text. Rows with equal id
    and text are one document and get the same result. Lines without a word are no part of runs and
    stay, but a document of which no other line is left becomes empty; a null text stays null. A
    document whose text is wholly that of an earlier one is one later copy, however many such copies
    there are: they are found by a minimum and take no part in the ranking. Columns of df are left
    alone whatever their names, but that with counts an own n_lines or n_deleted gives way to the
    result's. Rows without a cut reach the result without a shuffle, but for those few that the
    broadcast filter can't tell from rows with one.
    """
    cut = cuts(df, id_col, text_col, min_words).select(*(F.col(k).alias(f"cut_{k}") for k in _KEY), "n", "deleted")
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), df[id_col].cast("long").alias("doc"), *_hashes(text))
    rows = _filtered(rows, cut.withColumnRenamed("cut_h1", "h1"))
    whole = F.col(f"row.`{text_col}`")
    own = [c for c in df.columns if not (counts and c in ("n_lines", "n_deleted"))]

    def shaped(rows: DataFrame, text: Column, n: Column, gone: Column) -> DataFrame:
        columns = [(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in own]
        return rows.select(*columns, *([n.cast("long").alias("n_lines"), gone.cast("long").alias("n_deleted")] if counts else []))

    lines_of = F.size(F.filter(_found_lines(F.coalesce(whole.cast("string"), F.lit(""))), lambda x: x != ""))
    untouched = shaped(rows.where("not hit"), whole, lines_of, F.lit(0))
    joined = rows.where("hit").join(cut, F.col("doc").eqNullSafe(F.col("cut_doc")) & (F.col("h1") == F.col("cut_h1")) & (F.col("h2") == F.col("cut_h2")), "left")
    n = F.coalesce("n", lines_of)
    gone = F.when(F.col("n").isNull(), 0).otherwise(F.coalesce(F.size("deleted"), "n"))
    body = f"row.`{text_col}`"
    merged = f"array_sort(concat(transform(split({body}, '\\n'), (x, i) -> struct(i AS i, 1 AS k, x AS x)), transform(deleted, i -> struct(i AS i, 0 AS k, CAST(NULL AS STRING) AS x))))"
    kept = f"element_at(transform(array({merged}), m -> array_join(transform(filter(m, (e, t) -> e.k = 1 AND NOT (t > 0 AND m[t - 1].k = 0 AND m[t - 1].i = e.i)), e -> e.x), '\\n')), 1)"
    text = F.when(whole.isNull() | (gone == 0), whole).when(gone == F.col("n"), "").otherwise(F.expr(kept))
    return untouched.unionByName(shaped(joined, text, n, gone))
