"""Quality rules and line dedup against plain versions, and their plans without Python."""

import collections
import re
import statistics

from pyspark.sql import functions as F

from seatloom.llm import lines, queries, rules

from .conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORDS.findall(text)
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen, covered = collections.Counter(grams), set()
    for k, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(k, k + 8))
    lined = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lined) - len(set(lined)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_measures(edges, edge_rows, nothing):
    got = rules.measures(edges)
    no_python(got)
    assert sorted(map(str, (tuple(r)[0:1] + tuple(r)[3:9] for r in got.collect()))) == sorted(str((row[0], *base(row[1]))) for row in edge_rows)
    assert rules.quality_rules(nothing).count() == 0


def test_repeats_that_overlap(spark):
    w = [f"w{k}" for k in range(40)]
    texts = [" ".join(x) for x in (["a"] * 8, ["a"] * 9, ["a"] * 30, w[:12] * 2, w[:8] + w[20:] + w[:8], w[:7] * 2, [*w, *w[3:12], *w[5:20]])]
    df = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    assert [r.n_repeat_words for r in rules.measures(df).orderBy("doc_id").collect()] == [base(t)[4] for t in texts]


def test_fences_adapt_to_the_group(spark):
    plain, odd = "word " * 0 + " ".join(f"w{k}" for k in range(40)), " ".join(f"w{k}$$" for k in range(40))
    rows = [(k, plain + f" x{k}", "en", "a") for k in range(60)] + [(100, odd, "en", "a"), (101, odd, "en", "b")] + [(200 + k, odd + f" y{k}", "de", "c") for k in range(60)] + [(300, odd, None, None)]
    got = {r.doc_id: r.kept for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(60)) and not got[100] and not got[101]  # b is small: its language's fence
    assert all(got[200 + k] for k in range(60))  # usual in that source


FOUR = "doc_id bigint, text string, lang string, source string"


def test_fences_tell_mild_differences(spark):
    """Groups of like rows: only the length of words differs, then only that of texts."""
    text = lambda k, n, c: " ".join(f"{(k * 7919 + i) % 10**c:0{c}d}" for i in range(n))
    rows = [(k, text(k, 40, 5), "en", "a") for k in range(50)] + [(100 + k, text(k, 40, 7), "de", "b") for k in range(50)] + [(200 + k, text(k, 1000, 5), "en", "c") for k in range(50)]
    rows += [(900, text(900, 40, 8), "en", "a"), (901, text(900, 40, 8), "de", "b")]
    marked = lambda n: " ".join(x + "$" * (i % 5 == 0) for i, x in enumerate(text(950, n, 5).split()))
    rows += [(902, marked(40), "en", "a"), (903, marked(1000), "en", "c")]
    got = {r.doc_id: r.kept for r in rules.quality_rules(spark.createDataFrame(rows, FOUR)).collect()}
    assert not got.pop(900) and got.pop(901)  # words of 8 letters: odd beside 5, not beside 7
    assert got.pop(902) and not got.pop(903)  # a symbol in five words: chance in 40 words, not in 1,000
    assert all(got.values())


def test_fences_follow_the_rows(spark):
    """Fences of a group of 29, 30 and 31 rows differ by little, and lean on the language's the more the fewer rows there are."""
    high = []
    for n in (1, 10, 29, 30, 31, 300):
        rows = [(k, "abcde " * 3 + " ".join(f"{k:02d}{i:03d}" for i in range(30)), "en", "a") for k in range(400)]
        rows += [(1000 + k, " ".join(f"{k:04d}{i:03d}" for i in range(30)), "en", "b") for k in range(n)]
        ends = rules.fences(rules.with_keys(rules.measures(spark.createDataFrame(rows, FOUR)))).where("source_key = '+b'").first()
        assert ends.n == n
        high.append(ends.fence.chars_per_word_high)
    assert high == sorted(high) and max(high[3] - high[2], high[4] - high[3]) < 0.05 and high[-1] - high[0] > 1


def test_fences_differ_at_scale(spark):
    """In the documents no fence is the same in all groups."""
    rows = rules.with_keys(rules.measures(spark.read.parquet(SF + "/documents.parquet")))
    ends = [r.fence.asDict() for r in rules.fences(rows).collect()]
    for m in rules.MEASURES:
        assert len({round(e[f"{m}_high"], 4) for e in ends}) > len(ends) / 4


def test_sketches_merge(spark):
    """100,000 rows a group: quartiles against exact ones within a bin's width, and the same in any order."""
    values = {m: (F.pmod(F.xxhash64("id", F.lit(m)), F.lit(1_000_003)) / 1_000_003.0) ** 3 * scale for m, scale in zip(rules.SKETCHED, (1, 50, 1, 0.2, 3000, 8, 20_000, 90))}
    rows = spark.range(200_000).select(F.lit("x").alias("lang_key"), (F.col("id") % 2).cast("string").alias("source_key"), *(v.alias(m) for m, v in values.items()))
    def found(rows):
        fine = rules.sketches(rows, "lang_key", "source_key")
        return [rules.quartiles(x, *keys).orderBy(*keys).collect() for x, keys in ((fine, ["lang_key", "source_key"]), (rules.merge_sketches(fine, "lang_key"), ["lang_key"]))]

    fine, merged = found(rows)
    assert [r.n for r in fine] == [100_000] * 2 and merged[0].n == 200_000
    assert (fine, merged) == tuple(found(rows.repartition(13).sample(1.0)))
    table = rows.toPandas()
    for r, part in (*((r, table[table.source_key == r.source_key]) for r in fine), (merged[0], table)):
        for m in rules.SKETCHED:
            for name, p in ((1, 0.25), (3, 0.75)):
                exact = sorted(part[m])[-(-len(part) * int(100 * p) // 100) - 1]
                assert 0 <= exact - r[f"{m}_{name}"] <= max(1.0, exact) / rules.BINS


def test_keep_passing(edges):
    kept = rules.keep_passing(edges)
    assert kept.columns == edges.columns
    want = sorted(str(r.doc_id) for r in rules.quality_rules(edges).where("kept").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def plain_dedup(rows, least):
    """{(id, text): (lines, deleted lines, text)} by comparing maximal repeated runs, extended a line at a time."""
    docs = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is None, x[0] or 0))
    parts = []
    for d in docs:
        own = [(i, x.strip(" \t\n\x0b\f\r")) for i, x in enumerate(d[1].split("\n"))]
        parts.append([(i, x) for i, x in own if x])
    flat = [(d, q) for d, p in enumerate(parts) for q in range(len(p))]
    gone = collections.defaultdict(set)
    at = collections.defaultdict(list)
    for d, q in flat:
        for e, p in at[parts[d][q][1]]:
            n, words = 0, 0
            while q + n < len(parts[d]) and p + n < len(parts[e]) and parts[d][q + n][1] == parts[e][p + n][1]:
                words += len(WORDS.findall(parts[d][q + n][1]))
                n += 1
            if words >= least:
                gone[d].update(range(q, q + n))
        at[parts[d][q][1]].append((d, q))
    out = {}
    for d, (key, text) in enumerate(docs):
        cut = {parts[d][q][0] for q in gone[d]}
        kept = text if not cut else "" if len(cut) == len(parts[d]) else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in cut)
        out[key, text] = (len(parts[d]), len(cut), kept)
    return out


def test_line_dedup_is_maximal_runs(edges, edge_rows, nothing):
    for least in (1, 10, 26):
        got = lines.dedup_lines(edges, min_words=least)
        no_python(got)
        want = plain_dedup(edge_rows, least)
        expected = []
        for r in edge_rows:
            n, cut, kept = want[r[0], r[1] or ""]
            expected.append((r[0], None if r[1] is None else kept, n, cut))
        assert got.columns == [*edges.columns, "n_lines", "n_deleted"]
        others = [c for c in edges.columns if c != "text"]  # no column of the input is changed, whatever its name
        assert sorted(map(str, got.select(others).collect())) == sorted(map(str, edges.select(others).collect()))
        assert sorted(map(str, ((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in got.collect()))) == sorted(map(str, expected))
    assert lines.dedup_lines(nothing).count() == 0


def test_line_dedup_of_short_lines(spark):
    import random

    r = random.Random(9)
    rows = [(k, "\n".join(r.choice(["a", "b", "a b", "c c c", "", " d "]) for _ in range(r.randint(0, 25)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for least in (3, 7):
        want = plain_dedup(rows, least)
        assert {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in lines.dedup_lines(df, min_words=least).collect()} == {k: want[k, t] for k, t in rows}


def test_own_counts_stay_or_give_way(spark):
    df = spark.createDataFrame([(1, "a b c\nd", 77, "own"), (None, None, None, None)], "doc_id bigint, text string, n_lines int, h1 string")
    assert sorted(map(str, map(tuple, lines.dedup_lines(df, counts=False).collect()))) == sorted(map(str, map(tuple, df.collect())))
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "h1", "n_lines", "n_deleted"] and {(r.doc_id, r.n_lines) for r in got.collect()} == {(1, 2), (None, 0)}


def test_a_document_of_many_lines(spark):
    lined = "\n".join(f"line number {k % 20000} of a text with enough words in it" for k in range(24000))
    df = spark.createDataFrame([(1, lined), (2, "x\n" * 3000), (3, "\n".join(lined.split("\n")[100:20100]))], "doc_id bigint, text string")
    assert {r.doc_id: (r.n_lines, r.n_deleted) for r in lines.dedup_lines(df).collect()} == {1: (24000, 4000), 2: (3000, 2999), 3: (20000, 20000)}
    sequences = lines.line_sequences(df).select("doc", "h1", "h2", F.posexplode("lines").alias("q", "x")).select("doc", "h1", "h2", "q", "x.a", "x.b")
    levels = lines.suffix_ranks(sequences)
    assert [step for step, _ in levels] == [2**k for k in range(15)]  # the longest repeat has 20000 lines, a prefix of 16384
    order = {(r.doc, r.q): r["rank"] for r in levels[5][1].collect()}
    texts = {(r.doc, r.q): r for r in sequences.collect()}
    some = sorted(order, key=lambda x: order[x])[::97]
    prefix = lambda x: [(texts[x[0], x[1] + k].a, texts[x[0], x[1] + k].b) for k in range(32)]
    assert all((prefix(x) == prefix(y)) == (order[x] == order[y]) for x, y in zip(some, some[1:]))


def test_runs_are_maximal(spark):
    rows = [(1, 0, 0, 3, 4), (1, 0, 0, 5, 2), (1, 0, 0, 9, 1), (1, 0, 0, 0, 3), (2, 0, 0, 7, 2), (2, 0, 0, 7, 5)]
    got = lines.maximal_runs(spark.createDataFrame(rows, "doc bigint, h1 bigint, h2 bigint, q int, len int"))
    assert sorted((r.doc, r["first"], r.end) for r in got.collect()) == [(1, 0, 7), (1, 9, 10), (2, 7, 12)]


def test_order_ranks_keep_order(spark):
    df = spark.range(500).select((F.xxhash64("id") % 1000).alias("a"), F.col("id").alias("b"))
    rows = lines.order_ranks(df, "a", "b").orderBy("a", "b").collect()
    assert [r["rank"] for r in rows] == sorted({r["rank"] for r in rows})


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert sorted(found.columns) == sorted(names)
        assert sorted(str([r[c] for c in names]) for r in found.collect()) == sorted(str(list(r)) for r in cursor.fetchall()), name
