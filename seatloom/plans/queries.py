"""Queries over the driver's tables, each next to SQL for the same result written another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import allocate as al
from ..operators import changes, margins, reconcile, sorts, status, ticker
from ..streaming import live, replay
from ..sources.landing import once, work_path
from ..sources.readers import table
from . import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_BRANDS = """brand AS (SELECT p_brand AS party, sum(l_quantity)::BIGINT AS votes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
v AS (SELECT 0 AS e, party, votes, row_number() OVER (ORDER BY party) AS pos FROM brand),"""
_YEARS = """cnt AS (SELECT year(o_orderdate) AS e, n_name AS party, count(*) AS votes FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY party) AS pos FROM cnt),"""


def _allocation(house: int) -> str:
    """CTEs f (full seats) and w (awards, by a recursive loop over rounds: one award a step)."""
    return f"""
t AS (SELECT e, sum(votes) AS total FROM v GROUP BY e),
f AS (SELECT v.*, total, floor(votes / (total / {house}::DOUBLE))::BIGINT AS full_seats FROM v JOIN t USING (e)),
r AS (SELECT e, {house} - sum(full_seats)::BIGINT AS remainder FROM f GROUP BY e),
loop AS (
  SELECT e, 0 AS round, NULL::VARCHAR AS winner, map_from_entries(list((party, 0))) AS won FROM f GROUP BY e
  UNION ALL
  SELECT e, round + 1, best, map_from_entries(list_transform(map_entries(won), lambda x: (x.key, x.value + CASE WHEN x.key = best THEN 1 ELSE 0 END)))
  FROM (
    SELECT l.e, l.round, l.won, arg_max(f.party, (floor(f.votes / (f.full_seats + l.won[f.party] + 1)::DOUBLE + 0.5), -f.pos)) AS best
    FROM loop l JOIN f ON f.e = l.e AND f.full_seats > 0 JOIN r ON r.e = l.e AND l.round < r.remainder
    GROUP BY l.e, l.round, l.won
  )
),
w AS (SELECT e, round::BIGINT AS round, winner AS party FROM loop WHERE round > 0),
s AS (SELECT f.*, remainder, coalesce(n, 0)::BIGINT AS rest_seats, full_seats + coalesce(n, 0)::BIGINT AS seats, last_round
      FROM f JOIN r USING (e) LEFT JOIN (SELECT e, party, count(*) AS n, max(round) AS last_round FROM w GROUP BY e, party) c USING (e, party))"""


def _alloc_sql(base: str, house: int, columns: str) -> str:
    return f"WITH RECURSIVE {base} {_allocation(house)} SELECT {columns} FROM s"


_SEATS = ["party", "votes", "full_seats", "rest_seats", "seats"]


@query(_alloc_sql(_BRANDS, 150, ", ".join(_SEATS)))
def alloc_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.allocate(inputs.brand_votes(spark, sf_dir), []).select(*_SEATS)


@query(_alloc_sql(_BRANDS, 25, ", ".join(_SEATS)))
def alloc_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.allocate(inputs.brand_votes(spark, sf_dir), [], house=25).select(*_SEATS)


@query(_alloc_sql(_BRANDS, 15, ", ".join(_SEATS)))
def alloc_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.allocate(inputs.brand_votes(spark, sf_dir), [], house=15).select(*_SEATS)


@query(f"WITH RECURSIVE {_BRANDS} {_allocation(25)} SELECT party, (votes::HUGEINT * 25 // total)::BIGINT AS full_seats FROM f")
def alloc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.full_seats(inputs.brand_votes(spark, sf_dir), [], house=25, exact=True).select("party", "full_seats")


@query(_alloc_sql(_YEARS, 25, "e::INT AS election, " + ", ".join(_SEATS)))
def alloc_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.allocate(inputs.year_nation_votes(spark, sf_dir), ["election"], house=25).select("election", *_SEATS)


@query(_alloc_sql(_YEARS, 25, "e::INT AS election, " + ", ".join(_SEATS) + ", coalesce(last_round = remainder, false) AS last"))
def alloc_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remainder seats by a search of the last award's average, without a list of averages."""
    return al.allocate_by_price(inputs.year_nation_votes(spark, sf_dir), ["election"], house=25).select("election", *_SEATS, "last")


@query("""WITH v AS (SELECT year(o_orderdate) AS election, o_custkey AS party, 1000 * sum(o_orderkey % 10007 + 1)::BIGINT AS votes FROM orders GROUP BY ALL), t AS (SELECT election, sum(votes)::BIGINT AS total FROM v GROUP BY election),
f AS (SELECT v.*, floor(votes / (total / 20000::DOUBLE))::BIGINT AS full_seats FROM v JOIN t USING (election)), r AS (SELECT election, 20000 - sum(full_seats)::BIGINT AS remainder FROM f GROUP BY election),
x AS (SELECT election, party, remainder, row_number() OVER (PARTITION BY election ORDER BY floor(votes / (full_seats + k)::DOUBLE + 0.5) DESC, party, k) AS n FROM f JOIN r USING (election), generate_series(1, 40) AS g(k) WHERE full_seats > 0),
w AS (SELECT election, party, count(*) AS rest_seats FROM x WHERE n <= remainder GROUP BY ALL)
SELECT f.election::INT AS election, f.party, votes, full_seats, coalesce(rest_seats, 0)::BIGINT AS rest_seats FROM f LEFT JOIN w USING (election, party)""")
def alloc_large_house(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A house of 20,000 seats with every customer as a party: the search counts at some prices instead of listing parties x seats."""
    sums = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("election"), F.col("o_custkey").alias("party")).agg((F.sum(F.col("o_orderkey") % 10007 + 1) * 1000).cast("bigint").alias("votes"))
    return al.allocate_by_price(sums.withColumn("pos", F.col("party")), ["election"], house=20000).select("election", "party", "votes", "full_seats", "rest_seats")


@query(f"WITH RECURSIVE {_YEARS} {_allocation(25)} SELECT e::INT AS election, round, party FROM w")
def alloc_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    seats = al.full_seats(inputs.year_nation_votes(spark, sf_dir), ["election"], house=25)
    return al.awards(seats, ["election"]).select("election", "round", "party")


@query(f"WITH RECURSIVE {_YEARS} {_allocation(25)} SELECT e::INT AS election, string_agg(party, ',' ORDER BY round) AS winners FROM w GROUP BY e")
def winner_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    seats = al.full_seats(inputs.year_nation_votes(spark, sf_dir), ["election"], house=25)
    return al.winner_strip(seats, ["election"]).select("election", F.array_join("winners", ",").alias("winners"))


_MATRIX = f"""WITH RECURSIVE {_YEARS} {_allocation(25)},
m AS (SELECT f.e, f.party, f.votes, i AS round, f.votes / (f.full_seats + (SELECT count(*) FROM w WHERE w.e = f.e AND w.party = f.party AND w.round < i) + 1)::DOUBLE AS average
      FROM f JOIN r USING (e), generate_series(1, 25) AS g(i) WHERE full_seats > 0 AND i <= remainder)"""


@query(f"{_MATRIX} SELECT e::INT AS election, party, round, round(average, 6) AS average FROM m")
def avg_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    seats = al.full_seats(inputs.year_nation_votes(spark, sf_dir), ["election"], house=25)
    return al.average_matrix(seats, ["election"]).select("election", "party", "round", F.round("average", 6).alias("average"))


@query(f"""{_MATRIX}, x AS (SELECT e, round, max(average) AS a FROM m GROUP BY e, round), y AS (SELECT m.e, m.round, max(average) AS b FROM m JOIN x ON x.e = m.e AND x.round = m.round WHERE average < a GROUP BY m.e, m.round)
SELECT m.e::INT AS election, m.party, m.round, CASE WHEN average = a THEN 1 WHEN average = b AND b > 0 THEN 2 END::BIGINT AS place FROM m JOIN x ON x.e = m.e AND x.round = m.round LEFT JOIN y ON y.e = m.e AND y.round = m.round""")
def avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    seats = al.full_seats(inputs.year_nation_votes(spark, sf_dir), ["election"], house=25)
    return al.rank_averages(al.average_matrix(seats, ["election"]), ["election"]).select("election", "party", "round", "place")


@query(f"{_MATRIX} SELECT e::INT AS election, party, " + ", ".join(f"round(max(CASE WHEN round = {k} THEN average END), 6) AS round_{k}" for k in range(1, 6)) + " FROM m GROUP BY e, party HAVING min(round) <= 5")
def avg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    seats = al.full_seats(inputs.year_nation_votes(spark, sf_dir), ["election"], house=25)
    wide = al.pivot_rounds(al.average_matrix(seats, ["election"]), ["election"], 5)
    return wide.select("election", "party", *(F.round(f"round_{k}", 6).alias(f"round_{k}") for k in range(1, 6)))


def _margin_sql(base: str, house: int) -> str:
    return f"""WITH RECURSIVE {base} {_allocation(house)},
k AS (SELECT e, coalesce(max(CASE WHEN last_round = remainder AND full_seats > 0 THEN votes / seats::DOUBLE END), 0) AS mark FROM s GROUP BY e),
a AS (SELECT s.*, mark, CASE WHEN full_seats = 0 THEN NULL WHEN last_round = remainder THEN votes / seats::DOUBLE ELSE votes / (seats + 1)::DOUBLE END AS av FROM s JOIN k USING (e)),
l AS (SELECT e, list(av ORDER BY av DESC) FILTER (WHERE av IS NOT NULL) AS avs FROM a GROUP BY e),
g AS (SELECT a.*, CASE WHEN coalesce(CASE WHEN len(avs) > 1 THEN avs[2] ELSE avs[1] END, 0) = 0 THEN av WHEN len(avs) > 1 THEN avs[2] ELSE avs[1] END AS lv FROM a JOIN l USING (e)),
x AS (SELECT *, CASE WHEN full_seats = 0 THEN NULL WHEN av < mark THEN votes - seats * mark ELSE floor((votes / seats::DOUBLE - lv) * seats) END AS surplus,
  CASE WHEN full_seats = 0 THEN total / {house}::DOUBLE - votes WHEN av < mark THEN (mark - av) * (seats + 1) ELSE ceil((lv + 1) * (seats + 1)) - votes END AS short FROM g)"""


@query(f"{_margin_sql(_BRANDS, 25)} SELECT party, seats, round(surplus, 4) AS surplus, round(short, 4) AS short FROM x")
def margins_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = margins.margins(al.allocate(inputs.brand_votes(spark, sf_dir), [], house=25), [], house=25)
    return rows.select("party", "seats", F.round("surplus", 4).alias("surplus"), F.round("short", 4).alias("short"))


@query(f"""{_margin_sql(_YEARS, 25)}, z AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY short, pos) AS n FROM x),
p AS (SELECT e::INT AS election, arg_max(party, last_round) AS winner, max(last_round) AS round, ceil(arg_max(surplus, last_round))::BIGINT AS surplus, max(party) FILTER (WHERE n = 1) AS loser, ceil(max(short) FILTER (WHERE n = 1))::BIGINT AS short FROM z GROUP BY e)
SELECT *, CASE WHEN winner IS NULL THEN '-' ELSE format('{{}} houdt de laatste restzetel ({{}} over); {{}} komt {{}} stemmen tekort', winner, replace(format('{{:,}}', surplus), ',', '.'), loser, replace(format('{{:,}}', short), ',', '.')) END AS text FROM p""")
def margin_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = margins.margins(al.allocate(inputs.year_nation_votes(spark, sf_dir), ["election"], house=25), ["election"], house=25)
    return margins.margin_text(margins.margin_pair(rows, ["election"]))


_SUMMARY = f"""{_margin_sql(_BRANDS, 25)},
q AS (SELECT party, full_seats, rest_seats, seats, nullif(CASE WHEN seats = 0 THEN votes ELSE ceil(coalesce(surplus, 0))::BIGINT END, 0) AS surplus, nullif(ceil(coalesce(short, 0))::BIGINT, 0) AS short, pos, 0 AS is_total FROM x WHERE party NOT ILIKE '%OVERIG%')"""


@query(f"""{_SUMMARY}, u AS (SELECT * FROM q UNION ALL SELECT 'Totaal', sum(full_seats)::BIGINT, sum(rest_seats)::BIGINT, sum(seats)::BIGINT, NULL, NULL, 0, 1 FROM q)
SELECT party, full_seats, rest_seats, seats, surplus, short, is_total, row_number() OVER (ORDER BY is_total, seats DESC, coalesce(short, 0), pos) AS place FROM u""")
def summary_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = margins.margins(al.allocate(inputs.brand_votes(spark, sf_dir), [], house=25), [], house=25)
    return margins.with_total(margins.seat_rows(rows, []), []).drop("pos")


@query(f"""{_SUMMARY} SELECT place, party, seats, total > 10 AS overflow FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY seats DESC, coalesce(short, 0), pos) AS place FROM q WHERE seats > 0) WHERE place <= 10""")
def top10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = margins.margins(al.allocate(inputs.brand_votes(spark, sf_dir), [], house=25), [], house=25)
    return margins.top_list(margins.seat_rows(rows, []), [])


@query(f"""{_SUMMARY} SELECT 'Top 10' || chr(10) || string_agg(party || ' ' || seats, chr(10) ORDER BY place) || CASE WHEN max(total) > 10 THEN chr(10) || '…' ELSE '' END AS text
FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY seats DESC, coalesce(short, 0), pos) AS place FROM q WHERE seats > 0) WHERE place <= 10""")
def top10_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = margins.margins(al.allocate(inputs.brand_votes(spark, sf_dir), [], house=25), [], house=25)
    return margins.list_text(margins.top_list(margins.seat_rows(rows, []), []), [], "Top 10")


_FEEDS = "fd AS (SELECT CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'N' THEN 'b' ELSE 'official' END AS source, p_brand AS party, sum(l_quantity)::BIGINT AS votes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), tt AS (SELECT source, sum(votes)::BIGINT AS total, count(*) AS n FROM fd GROUP BY source)"


@query(f"WITH {_FEEDS} SELECT source, total, floor(total / 150::DOUBLE)::BIGINT AS quota_whole, nullif(round((total / 150::DOUBLE - floor(total / 150::DOUBLE)) * 150)::BIGINT, 0) AS quota_parts, floor(total / 150::DOUBLE * 0.25)::BIGINT AS threshold FROM tt")
def totals_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = reconcile.source_totals(inputs.feeds(spark, sf_dir), []).drop("n")
    return reconcile.quota_table(totals)


@query(f"""WITH {_FEEDS}, c AS (SELECT 'all' AS case_name, * FROM tt UNION ALL SELECT 'feeds', * FROM tt WHERE source <> 'official' UNION ALL SELECT 'empty_official', source, CASE WHEN source = 'official' THEN 0 ELSE total END, n FROM tt)
SELECT case_name, 'rows' AS mode, CASE WHEN count(*) FILTER (WHERE source = 'official' AND n > 0) > 0 THEN 'official' WHEN max(total) FILTER (WHERE source = 'b') > max(total) FILTER (WHERE source = 'a') THEN 'b' ELSE 'a' END AS source FROM c GROUP BY case_name
UNION ALL SELECT case_name, 'votes', CASE WHEN max(total) FILTER (WHERE source = 'official') > 0 THEN 'official' WHEN max(total) FILTER (WHERE source = 'b') > max(total) FILTER (WHERE source = 'a') THEN 'b' ELSE 'a' END FROM c GROUP BY case_name""")
def source_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = once(reconcile.source_totals(inputs.feeds(spark, sf_dir), []), "totals")
    empty = totals.withColumn("total", F.when(F.col("source") == "official", 0).otherwise(F.col("total")))
    cases = totals.withColumn("case_name", F.lit("all")).unionByName(totals.where("source <> 'official'").withColumn("case_name", F.lit("feeds"))).unionByName(empty.withColumn("case_name", F.lit("empty_official")))
    pick = lambda by_rows, mode: reconcile.choose_source(cases, ["case_name"], by_rows).select("case_name", F.lit(mode).alias("mode"), "source")
    return pick(True, "rows").unionByName(pick(False, "votes"))


@query("""WITH p AS (SELECT p_brand AS party, sum(CASE WHEN year(l_shipdate) = 1997 THEN l_quantity ELSE 0 END)::BIGINT AS votes, sum(CASE WHEN year(l_shipdate) = 1996 THEN l_quantity ELSE 0 END)::BIGINT AS previous,
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END)::BIGINT AS vb, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT AS vo FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
n AS (SELECT *, replace(party, 'Brand#', '')::INT AS k FROM p)
SELECT CASE WHEN k % 4 <> 0 THEN k ELSE row_number() OVER (ORDER BY party) END::BIGINT AS list_number, party, CASE WHEN k % 4 <> 0 THEN 'Brand ' || k ELSE '' END AS label, votes,
  CASE WHEN k % 4 <> 0 AND k % 3 <> 0 THEN vb ELSE 0 END AS votes_b, CASE WHEN k % 4 <> 0 THEN vo ELSE 0 END AS votes_official, votes - previous AS difference,
  CASE WHEN previous = 0 THEN '-' ELSE replace(printf('%.1f', round((votes - previous) / previous::DOUBLE * 100, 1)), '.', ',') END AS change, CASE WHEN votes = 0 THEN '-Infinity'::DOUBLE ELSE round((votes - previous)::DOUBLE / votes * 100, 1) END AS change_key FROM n""")
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _side_by_side(spark, sf_dir)


def _side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    of = lambda cond, name: F.sum(F.when(cond, F.col("l_quantity")).otherwise(0)).alias(name)
    flag, year = F.col("l_returnflag"), F.year("l_shipdate")
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(of(year == 1997, "votes"), of(year == 1996, "previous"), of(flag == "N", "vb"), of(flag == "R", "vo"))
    sums = sold.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("party")).agg(*(F.sum(c).cast("bigint").alias(c) for c in ("votes", "previous", "vb", "vo")))
    sums = once(sums, "sums").withColumn("pos", F.row_number().over(al.per([]).orderBy("party"))).withColumn("k", F.replace("party", F.lit("Brand#"), F.lit("")).cast("int"))
    code = F.when(F.col("k") % 3 != 0, F.concat(F.lit("B"), F.col("k").cast("string"))).otherwise(F.lower(F.concat(F.lit("B"), F.col("k").cast("string"))))
    labels = sums.where("k % 4 <> 0").select("party", F.col("k").alias("list_number"), code.alias("code"), F.format_string("Brand %d", F.col("k")).alias("label_long"), F.col("party").alias("label_short"))
    feed = sums.select(F.concat(F.lit("B"), F.col("k").cast("string")).alias("code"), F.col("vb").alias("votes"))
    official = sums.select(F.col("k").alias("list_number"), F.col("vo").alias("votes"))
    return reconcile.side_by_side(sums.select("party", "pos", "votes", "previous"), feed, official, labels)


_LABELS = "lb AS (SELECT n_nationkey + 1 AS list_number, 'p' || n_nationkey AS party, n_name, n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN NULL WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS code FROM nation), fb AS (SELECT upper(n_name) AS code, count(*) AS votes FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name)"


@query(f"WITH {_LABELS} SELECT coalesce(party, 'NOS:' || fb.code) AS party, votes FROM fb LEFT JOIN lb ON upper(lb.code) = upper(fb.code)")
def join_casefold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.feed_to_parties(inputs.nation_feed(spark, sf_dir), inputs.nation_labels(spark, sf_dir), []).select("party", "votes")


@query(f"WITH {_LABELS} SELECT coalesce(party, 'NOS:' || fb.code) AS party, votes FROM fb LEFT JOIN lb ON lb.code = fb.code")
def join_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.feed_to_parties(inputs.nation_feed(spark, sf_dir), inputs.nation_labels(spark, sf_dir), [], casefold=False).select("party", "votes")


@query("WITH o AS (SELECT n_nationkey + 3 AS list_number, count(*) AS votes FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey) SELECT CASE WHEN list_number <= 25 THEN 'p' || (list_number - 1) ELSE (list_number - 1)::VARCHAR END AS party, votes FROM o")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    official = inputs.nation_feed(spark, sf_dir).select((F.col("pos") + 3).alias("list_number"), "pos", "votes")
    return reconcile.official_to_parties(official, inputs.nation_labels(spark, sf_dir), []).select("party", "votes")


@query("SELECT c_custkey, coalesce(n_name, 'Onbekend') AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + 3")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("p"), (F.col("c_nationkey") + 3).cast("string")).alias("party"))
    labels = inputs.nation_labels(spark, sf_dir).withColumn("label_long", F.upper("label_long"))
    return reconcile.join_labels(rows, labels, ["party"], "Onbekend").select("c_custkey", F.col("label_long").alias("label"))


@query("WITH k AS (SELECT *, CASE WHEN n_nationkey % 5 = 0 THEN n_regionkey + 23 ELSE n_regionkey END AS parent FROM nation) SELECT k.n_name, CASE WHEN k.parent = 0 THEN '' ELSE coalesce(p.n_name, k.parent::VARCHAR) END AS parent_label FROM k LEFT JOIN nation p ON k.parent = p.n_nationkey")
def parent_selfjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("parent", F.when(F.col("n_nationkey") % 5 == 0, F.col("n_regionkey") + 23).otherwise(F.col("n_regionkey")))
    return status.with_parent(n, "n_nationkey", "parent", "n_name").select("n_name", "parent_label")


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM c)
SELECT c_nationkey, string_agg(CASE WHEN c_mktsegment = 'BUILDING' THEN 'Bouw' WHEN c_mktsegment = 'MACHINERY' THEN 'Machines' ELSE c_mktsegment END, ', ' ORDER BY r) AS labels FROM t WHERE r <= 3 GROUP BY c_nationkey""")
def array_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    ranked = c.withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "c_mktsegment"))).where("r <= 3")
    top = ranked.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("r", "c_mktsegment"))).alias("s")).select("c_nationkey", F.col("s.c_mktsegment").alias("keys"))
    labels = spark.createDataFrame([("BUILDING", "Bouw"), ("MACHINERY", "Machines")], "key string, label string")
    return status.array_labels(top, "c_nationkey", "keys", labels, "key", "label")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Nulstand' WHEN 'F' THEN 'Eindstand' ELSE o_orderstatus END AS passed, CASE o_orderstatus WHEN 'O' THEN 'Nulstand' WHEN 'F' THEN 'Eindstand' ELSE 'Onbekend' END AS named,
CASE o_orderstatus WHEN 'F' THEN 'final' ELSE 'zero' END AS class FROM orders""")
def enum_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"O": "Nulstand", "F": "Eindstand"}
    rows = table(spark, sf_dir, "orders").select("o_orderkey", fn.decode("o_orderstatus", names).alias("passed"), fn.decode("o_orderstatus", names, "Onbekend").alias("named"))
    return rows.withColumn("class", fn.status_class("passed"))


_EVENT_STATUS = "CASE event_type WHEN 'purchase' THEN 'Eindstand' WHEN 'click' THEN 'Tussenstand' ELSE 'Nulstand' END"


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), g AS (SELECT {_EVENT_STATUS} AS st, value::DECIMAL(18,2) AS population FROM f WHERE n = 1)
SELECT sum(CASE WHEN st <> 'Nulstand' THEN population ELSE 0 END)::DOUBLE AS counted, sum(population)::DOUBLE AS eligible, count(*) FILTER (WHERE st <> 'Nulstand') AS places_counted, count(*) AS places,
  round(sum(CASE WHEN st <> 'Nulstand' THEN population ELSE 0 END)::DOUBLE / sum(population)::DOUBLE, 9) AS percent FROM g""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.user_events(spark, sf_dir).select("event_id", "user_id", "ts", fn.decode("event_type", {"purchase": "Eindstand", "click": "Tussenstand"}, "Nulstand").alias("status"), F.col("value").cast("decimal(18,2)").alias("population"))
    out = status.progress(status.first_per_key(rows, F.col("user_id"), ["ts", "event_id"]), [])
    return out.select(F.col("counted").cast("double").alias("counted"), F.col("eligible").cast("double").alias("eligible"), "places_counted", "places", F.round("percent", 9).alias("percent"))


@query("SELECT l_orderkey, bool_and(l_linestatus = 'F') AS complete FROM lineitem GROUP BY l_orderkey")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.complete(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_linestatus") == "F")


@query("SELECT a AS max_a, b AS max_b, a || '|' || b AS signature FROM (SELECT coalesce(max(epoch(ts)) FILTER (WHERE event_type = 'view'), 0)::BIGINT AS a, coalesce(max(epoch(ts)) FILTER (WHERE event_type = 'nothing'), 0)::BIGINT AS b FROM (SELECT event_type, date_trunc('second', ts) AS ts FROM events))")
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.user_events(spark, sf_dir)
    return status.max_signature(e.where("event_type = 'view'"), e.where("event_type = 'nothing'"), "ts")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM b")
def distinct_until_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.until_changed(inputs.user_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return rows.select("event_id", "user_id", "event_type")


@query("""WITH c AS (SELECT *, CASE WHEN lag(event_id) OVER w IS NULL OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM c) SELECT event_id, island, epoch_us(min(ts) OVER (PARTITION BY user_id, island))::BIGINT AS since_us FROM i""")
def since_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.since(inputs.user_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type"), "ts")
    return rows.select("event_id", "island", F.unix_micros("since").alias("since_us"))


@query("""WITH h AS (SELECT event_id, CASE WHEN event_id % 100 <> 0 THEN 1 ELSE user_id END AS user_id, ts, event_type FROM events),
c AS (SELECT *, lag(event_id) OVER w IS NULL OR event_type IS DISTINCT FROM lag(event_type) OVER w AS changed FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(changed::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM c) SELECT event_id, changed, island, epoch_us(min(ts) OVER (PARTITION BY user_id, island))::BIGINT AS since_us FROM i""")
def hot_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal events of users of whom one has 99 % of the rows, cut by day."""
    events = inputs.user_events(spark, sf_dir).withColumn("user_id", F.when(F.col("event_id") % 100 != 0, 1).otherwise(F.col("user_id")))
    rows = changes.split_runs(events, ["user_id"], ["ts", "event_id"], F.col("event_type"), "ts", F.to_date("ts"))
    return rows.select("event_id", "changed", "island", F.unix_micros("since").alias("since_us"))


@query("""WITH d AS (SELECT ts::DATE AS day, event_type, count(*) AS votes FROM events GROUP BY ALL), s AS (SELECT day, event_type, votes, votes // 20 AS seats FROM d), t AS (SELECT day, sum(votes) AS total, dense_rank() OVER (ORDER BY day) AS n FROM s GROUP BY day)
SELECT strftime(t.day, '%Y-%m-%d') AS day, CASE WHEN EXISTS (SELECT 1 FROM s a LEFT JOIN s b ON b.day = p.day AND b.event_type = a.event_type WHERE a.day = t.day AND a.seats <> coalesce(b.seats, 0)) THEN 'seats' WHEN t.total > p.total THEN 'votes' ELSE 'none' END AS event
FROM t JOIN t p ON p.n = t.n - 1""")
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = inputs.user_events(spark, sf_dir).groupBy(F.lit("e").alias("election"), F.to_date("ts").alias("day"), F.col("event_type").alias("party")).agg(F.count("*").alias("votes"))
    rows = changes.seat_changes(days.withColumn("seats", F.expr("votes div 20")), ["election"], "day")
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.latest_per_key(inputs.user_events(spark, sf_dir), ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events WHERE event_type <> 'view' GROUP BY user_id")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.first_match(inputs.user_events(spark, sf_dir), ["user_id"], F.col("event_type") != "view", "event_id", "event_type", "event_id")


_TICKER = """tk AS (SELECT *, row_number() OVER (ORDER BY ts DESC, feed, event_id) AS place FROM (SELECT 0 AS feed, event_id, user_id, ts, 'B' AS source FROM events WHERE event_type = 'view' UNION ALL SELECT 1, event_id, user_id, ts, 'A' FROM events WHERE event_type = 'click') QUALIFY place <= 5)"""


def _ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.user_events(spark, sf_dir)
    item = lambda kind, source: e.where(F.col("event_type") == kind).select(F.col("user_id").cast("string").alias("name"), F.lit(kind).alias("status"), "ts", F.lit(source).alias("source"), F.col("event_id").alias("pos"))
    return ticker.latest(item("view", "B"), item("click", "A"))


@query(f"WITH {_TICKER} SELECT place, source, user_id::VARCHAR AS name, epoch_us(ts)::BIGINT AS ts_us FROM tk")
def ticker_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sorts.place(_ticker(spark, sf_dir), [], F.desc("ts"), F.col("_feed"), F.col("pos"))
    return rows.select("place", "source", "name", F.unix_micros("ts").alias("ts_us"))


@query(f"WITH {_TICKER} SELECT string_agg(source || '|' || user_id || '|' || (epoch_us(ts) // 1000), '||' ORDER BY place) AS signature FROM tk")
def ticker_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticker.signature(_ticker(spark, sf_dir))


@query(_alloc_sql(_BRANDS, 25, "party, seats, CASE WHEN pos % 5 = 0 THEN 0 ELSE 1 END::INT AS expected, CASE WHEN pos % 5 <> 0 THEN seats - 1 END AS difference"))
def seat_diff_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = al.allocate(inputs.brand_votes(spark, sf_dir), [], house=25)
    poll = rows.where("pos % 5 <> 0").select(F.upper("party").alias("name"), F.lit(1).alias("expected"))
    return margins.poll_difference(rows, poll, fn.normal_name(F.concat(F.lit(" "), F.col("party")))).select("party", "seats", "expected", "difference")


@query("""WITH a AS (SELECT * FROM (VALUES ('voters', (SELECT count(*)::VARCHAR FROM customer), (SELECT count(*)::VARCHAR FROM supplier)), ('turnout', '12,5', ''), ('turnoutCount', '0', NULL), ('invalid', '', '7'), ('blank', NULL, NULL)) AS t(statistic, c, p)),
b AS (SELECT * FROM (VALUES ('voters', '10', '20'), ('turnout', '80,1', '79,0'), ('turnoutCount', '5', '6'), ('invalid', '1', '2'), ('blank', '3', '0')) AS t(statistic, c, p))
SELECT a.statistic, coalesce(nullif(a.c, ''), b.c) AS current, coalesce(nullif(a.p, ''), b.p) AS previous FROM a JOIN b USING (statistic)""")
def unpivot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda name: table(spark, sf_dir, name).agg(F.count("*").cast("string").alias(name)).withColumn("_k", F.lit(1))
    base = n("customer").join(n("supplier"), "_k")
    t = lambda x, name: F.lit(x).cast("string").alias(name)
    a = base.select(F.col("customer").alias("voters_current"), F.col("supplier").alias("voters_previous"), t("12,5", "turnout_current"), t("", "turnout_previous"), t("0", "turnoutCount_current"), t(None, "turnoutCount_previous"), t("", "invalid_current"), t("7", "invalid_previous"), t(None, "blank_current"), t(None, "blank_previous"))
    from ..schemas import INDEX

    election = lambda *v: dict(zip(("kiesgerechtigden", "opkomst", "opkomst_promillage", "ongeldig", "blanco"), v, strict=True))
    index = spark.createDataFrame([({"huidige_verkiezing": election(10, 5, 801, 1, 3), "vorige_verkiezing": election(20, 6, 790, 2, None)}, [])], INDEX)
    return reconcile.build_stats(a, index)


@query("""WITH r AS (SELECT event_type, md5(printf('{"event_id":%d,"event_type":"%s","user_id":%d}', event_id, event_type, user_id)) AS d FROM events),
h AS (SELECT event_type, ('0x' || substr(d, 1, 15))::BIGINT::HUGEINT AS a, ('0x' || substr(d, 16, 15))::BIGINT::HUGEINT AS b FROM r)
SELECT coalesce(event_type, 'all') AS event_type, count(*) AS n, (sum(a) % 1152921504606846976)::BIGINT AS a, (sum(b) % 1152921504606846976)::BIGINT AS b FROM h GROUP BY GROUPING SETS ((event_type), ())""")
def table_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the events of each type, and that of all events as the sum of those."""
    from ..sources.landing import merge_tags, table_tag

    tags = table_tag(inputs.user_events(spark, sf_dir).select("event_id", "event_type", "user_id"), "event_type")
    return tags.unionByName(merge_tags(tags).withColumn("event_type", F.lit("all")))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, sha1('{\"k\":' || (props::JSON ->> 'k') || '}') AS tag FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.user_events(spark, sf_dir).select("event_id", F.explode(F.from_json("props", "map<string, string>")).alias("name", "value")).where("name = 'k'")
    return rows.select("event_id", fn.parse_int("value").alias("k"), fn.content_tag(fn.parse_int("value").alias("k")).alias("tag"))


@query("""SELECT event_id, CASE WHEN second(ts) = 0 THEN strftime(t, '%d-%m-%Y %H:%M') ELSE strftime(t, '%d-%m-%Y %H:%M:%S') END AS text, epoch_ms(date_trunc('second', t))::BIGINT AS back FROM (SELECT event_id, ts, ts AS t FROM events)""")
def fmt_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.user_events(spark, sf_dir).select("event_id", fn.format_datetime_nl("ts").alias("text"))
    return rows.withColumn("back", fn.parse_nl_datetime("text"))


_AGE = "CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'u' ELSE s // 86400 || 'd' END"


@query(f"""WITH a AS (SELECT event_id, epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts) AS d FROM events), b AS (SELECT event_id, d, greatest(0, d // 1000000) AS s, CASE WHEN d < 0 THEN (-d) // 1000000 END AS f FROM a)
SELECT event_id, {_AGE} || ' geleden' AS text, CASE WHEN d >= 0 THEN {_AGE} || ' geleden' ELSE 'over ' || {_AGE.replace('s <', 'f <').replace('s ||', 'f ||').replace('s //', 'f //')} END AS signed FROM b""")
def fmt_reltime(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return inputs.user_events(spark, sf_dir).select("event_id", fn.relative_time("ts", as_of).alias("text"), fn.relative_time_signed("ts", as_of).alias("signed"))


@query("SELECT o_orderkey, replace(format('{:,}', o_orderkey * 1001), ',', '.') AS number, CASE WHEN o_orderkey % 1000 = 0 THEN '' ELSE replace(printf('%.1f', (o_orderkey % 1000) / 10.0::DOUBLE), '.', ',') || '%' END AS permille, CASE WHEN o_custkey % 3 = 0 THEN '-' ELSE replace(printf('%.1f', round((o_orderkey - o_custkey) / o_custkey::DOUBLE * 100, 1)), '.', ',') END AS change FROM orders")
def fmt_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.format_number_nl(F.col("o_orderkey") * 1001).alias("number"), fn.format_permille(fn.blank_zero(F.col("o_orderkey") % 1000), "%").alias("permille"), fn.format_change(F.col("o_orderkey"), before).alias("change"))


@query(r"""SELECT p_partkey, try_cast(nullif(regexp_extract(p_size || ' maat', '^\s*([+-]?\d+)', 1), '') AS BIGINT) AS leading, coalesce(try_cast(p_size || CASE WHEN p_size % 2 = 0 THEN '' ELSE 'x' END AS DOUBLE), 0) AS whole, round(p_size + 0.5, 1)::DOUBLE AS comma,
(p_size * 1000 + 7)::BIGINT AS stripped, regexp_extract('jaar ' || (1900 + p_size) || ' en 2001', '\d{4}') AS year, right((1900 + p_size)::VARCHAR, 2) AS yy, CASE WHEN length(p_name || ' ' || p_type || ' ' || p_brand) > 34 THEN left(p_name || ' ' || p_type || ' ' || p_brand, 31) || '…' ELSE p_name || ' ' || p_type || ' ' || p_brand END AS short,
CASE WHEN p_size % 2 = 0 THEN 'TK' || (1900 + p_size) ELSE 'PS' || (1900 + p_size) END AS election FROM part""")
def parse_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, text = F.col("p_size"), F.col("p_size").cast("string")
    whole = F.concat(text, F.when(size % 2 == 0, "").otherwise("x"))
    long = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    year = (size + 1900).cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey", fn.parse_int(F.concat(text, F.lit(" maat"))).alias("leading"), fn.number_or_zero(whole).alias("whole"), fn.parse_decimal_comma(F.concat(text, F.lit(",5"))).alias("comma"),
        fn.strip_separators(F.concat(text, F.lit(".007"))).alias("stripped"), fn.year_of(F.concat(F.lit("jaar "), year, F.lit(" en 2001"))).alias("year"), fn.two_digit_year(size + 1900).alias("yy"), fn.truncate_text(long).alias("short"),
        fn.election_key(F.when(size % 2 == 0, year).otherwise(F.concat(F.lit("ps"), year))).alias("election"),
    )


@query("""WITH x AS (SELECT p_partkey, (p_partkey % 97) / (p_size + 1)::DOUBLE AS v FROM part), d AS (SELECT p_partkey, v, min(d) AS d FROM x, generate_series(2, 99) AS g(d) WHERE abs(round(v * d) - v * d) < 1e-6 GROUP BY ALL)
SELECT p_partkey, CASE WHEN round(v * d)::BIGINT % d = 0 THEN round(v * d)::BIGINT // d ELSE round(v * d)::BIGINT END AS numerator, CASE WHEN round(v * d)::BIGINT % d = 0 THEN 1 ELSE d END::BIGINT AS denominator FROM d""")
def fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = (F.col("p_partkey") % 97) / (F.col("p_size") + 1).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", fn.fraction(value).alias("f")).select("p_partkey", "f.numerator", "f.denominator").where("denominator is not null")


@query("SELECT p_partkey FROM part WHERE NOT (p_name || CASE WHEN p_partkey % 7 = 0 THEN ' Overige' ELSE '' END) ILIKE '%overig%'")
def residual_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat("p_name", F.when(F.col("p_partkey") % 7 == 0, " Overige").otherwise(""))
    return table(spark, sf_dir, "part").where(margins.not_residual(label)).select("p_partkey")


@query("SELECT p_brand, row_number() OVER (ORDER BY replace(p_brand, 'Brand#', '')::INT) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorts.place(table(spark, sf_dir, "part").select("p_brand").distinct(), [], *fn.natural_key("p_brand"))


@query("""WITH c AS (SELECT c_custkey, ['a', 'A', 'B', 'é', 'f'][1 + c_custkey % 5] AS l, c_custkey % 13 AS n, c_custkey % 31 AS m FROM customer)
SELECT c_custkey, l || n || 'b' || m AS name, row_number() OVER (ORDER BY CASE l WHEN 'B' THEN 1 WHEN 'é' THEN 2 WHEN 'f' THEN 3 ELSE 0 END, n, m, l = 'A', c_custkey) AS place FROM c""")
def locale_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with several numbers, capitals and an accent in the order of the locale."""
    k = F.col("c_custkey")
    letter = F.element_at(F.array(*map(F.lit, ["a", "A", "B", "é", "f"])), (k % 5 + 1).cast("int"))
    name = F.concat(letter, (k % 13).cast("string"), F.lit("b"), (k % 31).cast("string"))
    return sorts.place(table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")), [], *fn.natural_key("name"), k)


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 3 THEN p_size WHEN 4 THEN p_size / 10.0::DOUBLE WHEN 6 THEN -p_size - 0.5::DOUBLE WHEN 7 THEN 5 ELSE 0 END::DOUBLE AS value FROM part""")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are numbers, and some that only look like them: a suffix, NaN, nothing."""
    k, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    forms = [size, F.concat(size, F.lit("d")), F.lit("NaN"), F.concat(F.lit("0x"), F.hex(F.col("p_size").cast("bigint"))), F.concat(F.lit(" "), size, F.lit("e-1\t")), F.lit(""), F.concat(F.lit("-"), size, F.lit(".5")), F.lit("0b101")]
    return table(spark, sf_dir, "part").select("p_partkey", fn.number_or_zero(F.element_at(F.array(*forms), (k + 1).cast("int"))).alias("value"))


@query("""WITH t AS (SELECT p_partkey, p_partkey::BIGINT * 1234567 - CASE WHEN p_partkey % 5 = 0 THEN p_partkey * 1234567 % 1000 ELSE 0 END AS t FROM part)
SELECT p_partkey, replace(format('{:,}', t // 1000), ',', '.') || CASE WHEN t % 1000 = 0 THEN '' ELSE ',' || rtrim(lpad((t % 1000)::VARCHAR, 3, '0'), '0') END AS number FROM t""")
def fmt_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with four decimals, of which three at most are shown."""
    raw = F.col("p_partkey").cast("bigint") * 1234567
    whole = F.when(F.col("p_partkey") % 5 == 0, raw - raw % 1000).otherwise(raw)
    return table(spark, sf_dir, "part").select("p_partkey", fn.format_number_nl((whole * 10 + 4) / F.lit(10000.0)).alias("number"))


@query("SELECT coalesce(sum(c_custkey), 0)::BIGINT AS eligible FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def eligible_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("cbs_code"))
    detail = F.struct(F.col("c_mktsegment").alias("verkiezing_code"), F.col("c_custkey").alias("kiesgerechtigden"))
    details = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cbs_code"), detail.alias("huidige_verkiezing"))
    return status.eligible_total(index, details, "BUILDING")


@query("""SELECT s_suppkey, 'TK' || (2000 + s_suppkey % 30) AS election, CASE WHEN s_suppkey % 4 = 1 THEN 400 WHEN s_suppkey % 4 = 2 AND s_suppkey % 8 <> 2 THEN 400 ELSE 200 END AS code FROM supplier""")
def resolve_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import resolve

    k = F.col("s_suppkey")
    source = F.when(k % 4 == 1, "nothing").when(k % 4 == 2, "municipality").otherwise("results")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 30 + 2000).cast("string").alias("election"), source.alias("source"), F.when(k % 8 == 2, "GM0001").alias("cbs_code"))
    return resolve(rows).select("s_suppkey", "election", "code")


@query("WITH y AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) % 2 = 0) SELECT DISTINCT year(o_orderdate)::INT AS election, CASE WHEN year(o_orderdate) % 2 = 0 THEN 'local' ELSE 'remote' END AS origin, right((year(o_orderdate) - 2)::VARCHAR, 2) AS previous FROM orders")
def route_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import route

    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("election")).distinct()
    official = years.where("election % 2 = 0").select("election", F.lit(1).alias("votes"))
    return route(years, official).withColumn("previous", reconcile.election_labels(F.col("election"))["previous"])


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit polls as JSON texts: an election for each region, its nations as parties, two or three times each, one value that is no number."""
    from ..sources.readers import exit_poll

    k = F.col("n_nationkey").cast("string")
    series = F.concat(F.lit('": {"21:45": '), k, F.lit(', "21:00": "'), (F.col("n_nationkey") + 1).cast("string"), F.lit('"'), F.when(F.col("n_nationkey") % 2 == 0, ', "22:30": "x"').otherwise(', "23:00": 7'), F.lit("}"))
    entry = F.concat(F.lit('" '), F.lower("n_name"), series)
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("x")))).alias("s"))
    maps = n.select(F.lit(0).alias("pos"), F.col("n_regionkey").cast("string").alias("key"), F.concat(F.lit("{"), F.array_join("s.x", ", "), F.lit("}")).alias("value"))
    return exit_poll(maps)


@query("SELECT n_regionkey::VARCHAR AS election, upper(n_name) AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 1 ELSE 7 END::INT AS expected FROM nation")
def poll_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import latest_poll

    return latest_poll(_polls(spark, sf_dir))


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'number' WHEN 1 THEN 'text' WHEN 2 THEN 'null' WHEN 3 THEN 'object' WHEN 4 THEN 'boolean' WHEN 5 THEN 'array' WHEN 6 THEN 'text' END AS kind,
CASE WHEN c_custkey % 8 = 0 THEN c_acctbal::DOUBLE ELSE 0 END AS strict, CASE c_custkey % 8 WHEN 0 THEN c_acctbal::DOUBLE WHEN 1 THEN c_acctbal::DOUBLE WHEN 2 THEN 0 WHEN 4 THEN (c_nationkey > 9)::INT::DOUBLE END AS loose FROM customer""")
def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of a JSON document that holds another kind of value from row to row, told apart as VARIANT."""
    k, number = F.col("c_custkey") % 8, F.col("c_acctbal").cast("string")
    values = [number, F.concat(F.lit('" '), number, F.lit('"')), F.lit("null"), F.concat(F.lit('{"n": '), number, F.lit("}")), (F.col("c_nationkey") > 9).cast("string"), F.concat(F.lit("["), number, F.lit("]")), F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))]
    field = F.get(F.array(*values), k)
    text = F.when(k < 7, F.concat(F.lit('{"votes": '), field, F.lit("}"))).otherwise("{}")
    field = F.try_variant_get(F.try_parse_json(text), "$.votes", "variant")
    return table(spark, sf_dir, "customer").select("c_custkey", fn.json_kind(field).alias("kind"), fn.strict_number(field).alias("strict"), fn.loose_number(field).alias("loose"))


@query("SELECT e::VARCHAR AS election, row_number() OVER (PARTITION BY e ORDER BY f)::BIGINT AS place, t AS time FROM (SELECT n_regionkey AS e, t, min(n_nationkey * 3 + p) AS f FROM nation, (VALUES ('21:45', 0), ('21:00', 1), ('23:00', 2)) AS x(t, p) WHERE p < 2 OR n_nationkey % 2 = 1 GROUP BY ALL)")
def poll_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import poll_times as times

    return times(_polls(spark, sf_dir))


@query("SELECT user_id::VARCHAR AS source, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS event_id FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type <> 'error') > 0")
def last_good_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import last_good

    e = inputs.user_events(spark, sf_dir).select(F.col("user_id").cast("string").alias("source"), F.struct("ts", "event_id").alias("snapshot_ts"), F.when(F.col("event_type") != "error", F.col("event_id")).alias("body"))
    return last_good(e).select("source", F.col("body").alias("event_id"))


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' AND ts >= TIMESTAMP '2024-01-20 11:00:00'")
def fresh_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import fresh

    e = inputs.user_events(spark, sf_dir).withColumnRenamed("ts", "snapshot_ts")
    return fresh(e, "2024-01-20 12:00:00", 3600).select("event_id")


@query("SELECT list_number::INT AS list_number, party, label_long, label_short FROM (SELECT *, row_number() OVER (PARTITION BY party ORDER BY list_number DESC) AS n FROM (SELECT n_nationkey + 1 AS list_number, 'p' || (n_nationkey % 20) AS party, CASE WHEN n_nationkey % 3 = 0 THEN substr(n_name, 1, 3) ELSE n_name END AS label_long, CASE WHEN n_nationkey % 4 = 1 AND n_nationkey % 3 <> 0 THEN n_name ELSE substr(n_name, 1, 3) END AS label_short FROM nation)) WHERE n = 1")
def label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import labels

    k = F.col("n_nationkey")
    short = F.when((k % 4 == 1) & (k % 3 != 0), "").otherwise(F.substring("n_name", 1, 3))
    item = F.struct(F.concat(F.lit("p"), (k % 20).cast("string")).alias("key"), F.lit(None).cast("string").alias("color"), F.when(k % 3 != 0, F.col("n_name")).alias("labelLong"), short.alias("labelShort"), F.lit(None).cast("string").alias("labelShortNOS"))
    maps = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct(k, item.alias("x")))).alias("s")).select(F.lit("TK1").alias("key"), F.col("s.x").alias("value"))
    return labels(maps).select("list_number", "party", "label_long", "label_short")


@query("""WITH r AS (SELECT *, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE ((n_nationkey + 7) % 30)::VARCHAR END AS parent FROM nation)
SELECT r.n_name AS label, CASE r.n_nationkey % 4 WHEN 0 THEN 'Gemeente' WHEN 1 THEN 'Provincie' WHEN 2 THEN 'Land' ELSE '3' END AS type, CASE r.n_nationkey % 5 WHEN 0 THEN 'Nulstand' WHEN 2 THEN 'Tussenstand' WHEN 4 THEN 'Eindstand' ELSE (r.n_nationkey % 5)::VARCHAR END AS status,
  CASE WHEN r.n_nationkey * 61 % 60 = 0 THEN strftime(make_timestamp(r.n_nationkey * 61000000), '%d-%m-%Y %H:%M') ELSE strftime(make_timestamp(r.n_nationkey * 61000000), '%d-%m-%Y %H:%M:%S') END AS updated_text, CASE WHEN r.parent IN ('', '0') THEN '' ELSE coalesce(p.n_name, r.parent) END AS parent_label, lower(r.n_name) || ', zz' AS top_current, '' AS top_previous
FROM r LEFT JOIN nation p ON p.n_nationkey::VARCHAR = r.parent""")
def region_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    parent = F.when(k % 5 == 0, "").otherwise(((k + 7) % 30).cast("string"))
    views = n.select(k.alias("pos"), k.cast("string").alias("key"), (k % 4).alias("type"), F.col("n_name").alias("label"), F.lit(1).alias("countParties"), (k % 5).alias("status"), (k * 61).cast("bigint").alias("updated"), parent.alias("parent"), F.array(k.cast("string"), F.lit("zz")).alias("topPartiesCurrent"), F.lit(None).cast("array<string>").alias("topPartiesPrevious"))
    labels = n.select(k.cast("string").alias("party"), F.lower("n_name").alias("label_short"))
    return status.region_rows(views, labels).select("label", "type", "status", "updated_text", "parent_label", "top_current", "top_previous")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 = 0 THEN '' ELSE (c_custkey % 10)::VARCHAR END AS shown FROM customer WHERE c_nationkey % 5 = 3")
def zero_stand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 5).cast("string").alias("election"), (F.col("c_custkey") % 10).alias("v"))
    return changes.reject_late(rows, "3").select("c_custkey", reconcile.blank_at_zero(F.col("v").cast("string"), F.col("v"), F.col("c_custkey") % 2 == 0).alias("shown"))


@query("WITH t AS (SELECT p_brand AS name, count(*) AS n, 0 AS is_total FROM part GROUP BY p_brand UNION ALL SELECT 'Totaal', count(*), 1 FROM part) SELECT name, n, row_number() OVER (ORDER BY is_total, try_cast(replace(name, 'Brand#', '') AS INT) DESC) AS place FROM t")
def pinned_total_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n")).withColumn("is_total", F.lit(0))
    rows = rows.unionByName(part.agg(F.lit("Totaal").alias("name"), F.count("*").alias("n"), F.lit(1).alias("is_total")))
    return sorts.place(rows, [], F.col("is_total"), *(k.desc_nulls_last() for k in fn.natural_key("name"))).drop("is_total")


_DAYS = """d AS (SELECT ts::DATE AS day, event_type, count(*) AS votes FROM events GROUP BY ALL), s AS (SELECT day, event_type, votes, votes // 20 AS seats FROM d), t AS (SELECT day, sum(votes) AS total, dense_rank() OVER (ORDER BY day) AS n, string_agg(event_type || seats, ',' ORDER BY event_type) AS st FROM s GROUP BY day)"""
_REPLAYED = f"""WITH {_DAYS} SELECT 'e' AS election, (t.day - DATE '1970-01-01')::BIGINT AS seq, CASE WHEN p.n IS NULL THEN 'first' WHEN EXISTS (SELECT 1 FROM s a LEFT JOIN s b ON b.day = p.day AND b.event_type = a.event_type WHERE a.day = t.day AND a.seats <> coalesce(b.seats, 0)) THEN 'seats' WHEN t.total > p.total THEN 'votes' ELSE 'none' END AS event
FROM t LEFT JOIN t p ON p.n = t.n - 1 WHERE p.n IS NULL OR p.total <> t.total OR p.st <> t.st"""


@query(_REPLAYED)
def streaming_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily snapshots of event counts through the streaming operator, read back from its sink."""
    return replay.replay(spark, replay.daily_snapshots(inputs.user_events(spark, sf_dir))).drop("signature")


@query(_REPLAYED.replace("WHERE p.n IS NULL OR p.total", "WHERE t.n > 11 AND (p.total") + ")")
def streaming_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the twelfth day on: the stream's state begins with the stored snapshots of the days before."""
    days = once(replay.daily_snapshots(inputs.user_events(spark, sf_dir)), "days").withColumn("_place", F.row_number().over(Window.partitionBy("election").orderBy("seq")))
    stored, rest = (days.where(c).drop("_place") for c in ("_place <= 11", "_place > 11"))
    with live.typed_state(spark):
        return replay.replay(spark, rest, lambda stream: live.changes_after(stream, stored)).drop("signature")


@query(_REPLAYED)
def polling_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by polling each second, stopped once the last snapshot has come."""
    days = once(replay.daily_snapshots(inputs.user_events(spark, sf_dir)), "days")
    return replay.replay(spark, days, until=days.agg(F.max("seq")).first()[0]).drop("signature")


_PAIRS = """z AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL), y AS (SELECT (day - DATE '1970-01-01')::BIGINT AS seq, arg_max(event_type, (n, event_type)) || '|' || arg_min(event_type, (n, event_type)) AS signature FROM z GROUP BY day),
x AS (SELECT *, (seq * 86400 + 43200) * 1000000 AS now, CASE seq % 3 WHEN 0 THEN (seq * 86400 + 40000) * 1000000 WHEN 1 THEN (seq * 86400 + 50000) * 1000000 END AS updated FROM y),
c AS (SELECT *, CASE WHEN lag(signature) OVER (ORDER BY seq) = signature THEN 0 ELSE 1 END AS ch FROM x), i AS (SELECT *, sum(ch) OVER (ORDER BY seq) AS island FROM c),
b AS (SELECT island, arg_min(CASE WHEN updated > 0 AND updated <= now THEN updated ELSE now END, seq) AS since FROM i GROUP BY island), q AS (SELECT i.*, since FROM i JOIN b USING (island))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most and the least frequent type of event of each day as the pair of a snapshot; the update's time is before now, after it, or unknown in turn."""
    counts = inputs.user_events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    seq = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("bigint")
    at = lambda s: (F.col("seq") * 86400 + s) * 1_000_000
    pairs = counts.groupBy(seq.alias("seq")).agg(F.max_by("event_type", F.struct("n", "event_type")).alias("winner"), F.min_by("event_type", F.struct("n", "event_type")).alias("loser"))
    updated = F.when(F.col("seq") % 3 == 0, at(40_000)).when(F.col("seq") % 3 == 1, at(50_000))
    return pairs.select(F.lit("e").alias("election"), "seq", "winner", "loser", F.concat_ws("|", "winner", "loser").alias("signature"), updated.alias("updated"), at(43_200).alias("now"))


@query(f"WITH {_PAIRS} SELECT 'e' AS election, seq, signature, since::BIGINT AS since FROM q")
def streaming_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).drop("winner", "loser")
    return replay.replay(spark, pairs, live.since, live.PAIR, live.SINCE)


@query(f"""WITH {_PAIRS}, w AS (SELECT seq, since, split_part(signature, '|', 1) AS winner, split_part(signature, '|', 2) AS loser, seq % 5 = 0 AS finalized, (now - since) // 1000000 AS s FROM q),
l AS (SELECT *, 'Laatste restzetel gaat naar: ' || CASE WHEN seq % 4 = 0 THEN '-' ELSE winner END || ', dit gaat ten koste van: ' || CASE WHEN seq % 4 = 0 THEN '-' ELSE loser END AS line FROM w)
SELECT seq, since::BIGINT AS since, line || CASE WHEN finalized OR seq % 4 = 0 THEN '' ELSE ' (sinds ' || {_AGE} || ' geleden)' END AS text FROM l""")
def since_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = lambda c: F.timestamp_micros(F.col(c)).alias(c)
    rows = _pairs(spark, sf_dir).select("election", "seq", "winner", "loser", "signature", time("updated"), time("now"))
    states = changes.since_states(rows, ["election"], "seq").withColumn("finalized", F.col("seq") % 5 == 0)
    named = states.withColumns({c: F.when(F.col("seq") % 4 != 0, F.col(c)) for c in ("winner", "loser")})
    return changes.banner(named).select("seq", F.unix_micros("since").alias("since"), "text")


_PLACES = """h AS (SELECT user_id, event_id, event_id % 13 AS k, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events),
pl AS (SELECT user_id::VARCHAR AS place, event_id AS seq, CASE WHEN back = 1 THEN 'Eindstand' WHEN k < 5 THEN 'Nulstand' ELSE 'Tussenstand' END AS status, (100 + user_id % 50)::BIGINT AS population FROM h)"""


def _places(spark: SparkSession, sf_dir: str, open_ended: bool = False) -> DataFrame:
    """Every user as a place whose status comes with each of its events; the last one is final, unless the count stays open."""
    e = inputs.user_events(spark, sf_dir)
    last = e.groupBy("user_id").agg(F.max("event_id").alias("last"))
    rows = e.join(last, "user_id")
    status_of = F.when(F.lit(not open_ended) & (F.col("event_id") == F.col("last")), "Eindstand").when(F.col("event_id") % 13 < 5, "Nulstand").otherwise("Tussenstand")
    return rows.select(F.col("user_id").cast("string").alias("place"), F.col("event_id").cast("bigint").alias("seq"), status_of.alias("status"), (F.col("user_id") % 50 + 100).cast("bigint").alias("population"))


@query(f"WITH {_PLACES} SELECT place, max(seq)::BIGINT AS seq, arg_max(status, seq) AS status FROM pl GROUP BY place")
def streaming_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places followed until all are final: the stream ends by itself, by the metrics that it observes."""
    landing, out, state = (work_path(spark, x) for x in ("landing", "places", "state"))
    _places(spark, sf_dir).repartitionByRange(4, "seq").write.parquet(landing)
    live.run_until_settled(live.read_snapshots(spark, landing, live.PLACE, files=2), live.write_batches(out), state, every="0 seconds")
    return live.last_batch(spark, out, live.PLACE).select("place", "seq", "status")


@query(f"""WITH {_PLACES}, l AS (SELECT place, arg_max(CASE WHEN status = 'Eindstand' AND TRUE THEN CASE WHEN seq % 13 < 5 THEN 'Nulstand' ELSE 'Tussenstand' END ELSE status END, seq) AS status, any_value(population) AS population FROM pl GROUP BY place)
SELECT coalesce(sum(population) FILTER (WHERE status <> 'Nulstand'), 0)::BIGINT AS counted, sum(population)::BIGINT AS eligible, count(*) FILTER (WHERE status <> 'Nulstand') AS places_counted, count(*) AS places FROM l""")
def streaming_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of a count that stays open, kept up by the changes of each batch."""
    landing, out, state = (work_path(spark, x) for x in ("landing", "progress", "state"))
    _places(spark, sf_dir, open_ended=True).repartitionByRange(4, "seq").write.parquet(landing)
    stream = live.progress_changes(live.read_snapshots(spark, landing, live.PLACE, files=2))
    writer = stream.writeStream.outputMode("update").foreachBatch(live.sum_batches(out)).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination()
    return live.last_batch(spark, out, live.DELTA)


@query("""SELECT feed, pos, name FROM (SELECT 0::INT AS feed, event_id::BIGINT AS pos, user_id::VARCHAR AS name, ts FROM events WHERE event_type = 'view' UNION ALL SELECT 1, event_id, user_id::VARCHAR, ts FROM events WHERE event_type = 'click') ORDER BY ts DESC, feed, pos LIMIT 5""")
def streaming_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticker's five newest items of two streams, of which five rows each are kept."""
    e = inputs.user_events(spark, sf_dir)
    out, state = (work_path(spark, x) for x in ("ticker", "state"))
    streams = []
    for feed, kind in enumerate(("view", "click")):
        landing = work_path(spark, "landing")
        items = e.where(F.col("event_type") == kind).select(F.lit(feed).alias("feed"), F.col("event_id").cast("bigint").alias("pos"), F.col("user_id").cast("string").alias("name"), "ts")
        items.repartition(4, "pos").write.parquet(landing)
        streams.append(live.read_snapshots(spark, landing, live.ITEM, files=2))
    live.start(streams[0].unionByName(streams[1]), live.top_batches(out), state, every=None).awaitTermination()
    return live.top_items(live.last_batch(spark, out, live.ITEM)).select("feed", "pos", "name")
