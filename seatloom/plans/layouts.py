"""Queries over the JSON layouts and the tables shown from them.

Documents are written from the driver's tables into landing folders and read back by the readers, so
each layout goes through a file. Like the queries beside them, all have SQL written another way.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import schemas
from ..operators import allocate as al
from ..operators import margins, reconcile, sorts, status, ticker
from ..sources import readers
from ..sources.landing import ingest, land, once, publish, published, work_path
from . import inputs
from .queries import _SUMMARY, _YEARS, _allocation, _polls, _side_by_side, query

_N = "b AS (SELECT n_nationkey AS k, n_regionkey AS r, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation)"


def _krc() -> tuple[Column, Column, Column]:
    """The columns of inputs.nation_counts()."""
    return F.col("k"), F.col("r"), F.col("c")


def _text(x: Column) -> Column:
    return x.cast("string")


def _one_document(rows: DataFrame, name: str, item: Column) -> DataFrame:
    """{"name": [items in order of k]} as one JSON document."""
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("k", item.alias("x")))).alias("s"))
    return listed.select(F.to_json(F.struct(F.col("s.x").alias(name))).alias("value"))


# Feed A's results: an election for each region, its nations as parties


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Party results as read from a folder for each election. Votes are 0 for some parties and empty for others."""
    k, r, c = _krc()
    figures = lambda votes: F.struct(votes.alias("votes"), F.concat(_text(c % 100), F.lit(","), _text(k % 10)).alias("percentage"), _text(k % 5).alias("seats"))
    now = F.when(k % 7 == 0, "0").when(k % 11 == 5, "").otherwise(_text(c * 10 + k % 3))
    results = F.struct(figures(_text(c * 10)).alias("previous"), figures(now).alias("current"), figures(_text(k % 3)).alias("diff"))
    n = inputs.nation_counts(spark, sf_dir)
    parties = n.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("k", F.struct(F.concat(F.lit("p"), _text(k)).alias("key"), results.alias("results")).alias("x")))).alias("s"))
    document = F.struct((r * 61 + 1_700_000_000).cast("double").alias("updated"), (r % 3 * 2).alias("status"), F.col("s.x").alias("parties"))
    path = land(parties.select(F.concat(F.lit("TK"), _text(r + 2021)).alias("election"), F.to_json(document).alias("value")), work_path(spark, "results"))
    return readers.party_results(readers.read_elections(spark, path, schemas.RESULTS))


@query(f"""WITH {_N}, x AS (SELECT 'TK' || (2021 + r) AS election, 'p' || k AS party, k, CASE WHEN k % 7 = 0 THEN 0 WHEN k % 11 = 5 THEN NULL ELSE c * 10 + k % 3 END::BIGINT AS current_votes, c * 10 AS previous_votes, (k % 3)::BIGINT AS diff_votes, (c % 100 + (k % 10) / 10.0)::DOUBLE AS percentage, (k % 5)::INT AS seats, (1700000000 + r * 61)::BIGINT AS updated FROM b)
SELECT election, party, current_votes, previous_votes, diff_votes, percentage, seats, updated, row_number() OVER (PARTITION BY election ORDER BY current_votes DESC NULLS LAST, k) AS place, row_number() OVER (PARTITION BY election ORDER BY k) AS by_name FROM x""")
def raw_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed A's votes of local elections, in the order of the raw table and in natural order of the party."""
    rows = _results(spark, sf_dir).select("election", "pos", "party", "current_votes", "previous_votes", "diff_votes", F.col("current_percentage").cast("double").alias("percentage"), F.col("current_seats").alias("seats"), F.unix_seconds("updated").alias("updated"))
    rows = sorts.place(rows, ["election"], *sorts.order_keys("current_votes", False, "number"))
    return sorts.place(rows, ["election"], *sorts.order_keys("party", True), name="by_name").drop("pos")


_OLD = f"""WITH {_N} SELECT 'N' || k AS party, (c + k)::BIGINT AS current_votes, c::BIGINT AS previous_votes, k::BIGINT AS diff_votes, (k / 10.0)::DOUBLE AS current_percentage, (k % 4)::INT AS current_seats, epoch_us(TIMESTAMP '2019-03-20 21:00:00')::BIGINT AS updated FROM b"""


@query(_OLD)
def old_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older provincial layout in the columns of the newer one."""
    k, _, c = _krc()
    count = lambda votes, perc: F.struct(_text(votes).alias("count"), perc.alias("perc"), _text(k % 4).alias("seats"))
    tenths = F.concat(_text(F.floor(k / 10)), F.lit("."), _text(k % 10))
    party = F.struct(F.concat(F.lit("Name "), _text(k)).alias("label"), F.concat(F.lit("N"), _text(k)).alias("labelShort"), count(c + k, tenths).alias("now"), count(c, F.lit("0.5")).alias("last"))
    whole = _one_document(inputs.nation_counts(spark, sf_dir), "parties", party)
    document = whole.select(F.concat(F.lit('{"status": 4, "updated": "2019-03-20 21:00:00", '), F.substr("value", F.lit(2))).alias("value"))
    path = land(document, work_path(spark, "old"))
    rows = readers.old_party_results(readers.read_document(spark, path, schemas.OLD_RESULTS))
    return rows.select("party", "current_votes", "previous_votes", "diff_votes", F.col("current_percentage").cast("double").alias("current_percentage"), "current_seats", F.unix_micros("updated").alias("updated"))


# Feed B's index: nations as municipalities


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as read: missing names, codes and times, a code that two share, figures that are missing."""
    k, r, c = _krc()
    n = inputs.nation_counts(spark, sf_dir)
    code = F.when(k % 8 == 3, "").otherwise(F.concat(F.lit("GM"), _text(F.when(k % 6 == 5, k - 1).otherwise(k))))
    area = F.struct(F.when(k % 9 != 4, F.col("name")).alias("naam"), code.alias("cbs_code"), F.when(k % 12 != 11, c * 100).alias("aantal_inwoners"), F.concat(F.lit("K"), _text(r)).alias("kieskring"), F.struct(F.concat(F.lit("Provincie "), _text(r)).alias("naam"), (r * 1000).alias("aantal_inwoners")).alias("provincie"))
    turnout = lambda x: F.struct(x.alias("opkomst_promillage"))
    time = F.when(k % 10 != 7, F.date_format(F.timestamp_seconds(k * 3600 + 1_704_067_200), "yyyy-MM-dd'T'HH:mm:ss"))
    state = F.when(k % 3 == 0, "Nulstand").when(k % 3 == 1, "Tussenstand").otherwise("Eindstand")
    place = F.struct(state.alias("status"), time.alias("publicatie_datum_tijd"), area.alias("gemeente"), F.struct(F.concat(F.lit("A"), _text(k % 4)).alias("short_name")).alias("eerste_partij"), F.when(k % 2 == 1, F.struct(F.lit("B").alias("short_name"))).alias("tweede_partij"), turnout(k + 500).alias("huidige_verkiezing"), F.when(k % 5 != 0, turnout(k + 400)).alias("vorige_verkiezing"))
    party = F.struct(F.struct(F.upper("name").alias("short_name")).alias("partij"), F.struct(F.when(k % 13 != 6, c).alias("stemmen")).alias("huidig"))
    listed = n.agg(F.array_sort(F.collect_list(F.struct("k", place.alias("g"), party.alias("p")))).alias("s"))
    document = F.struct(F.struct(F.col("s.p").alias("partijen")).alias("landelijke_uitslag"), F.col("s.g").alias("gemeentes"))
    path = land(listed.select(F.to_json(document).alias("value")), work_path(spark, "index"))
    return readers.read_document(spark, path, schemas.INDEX)


_INDEX = f"""{_N}, m AS (SELECT k, CASE WHEN k % 9 = 4 THEN NULL ELSE name END AS name, CASE WHEN k % 8 = 3 THEN '' ELSE 'GM' || CASE WHEN k % 6 = 5 THEN k - 1 ELSE k END END AS code, CASE WHEN k % 12 = 11 THEN NULL ELSE c * 100 END AS population, r, ['Nulstand', 'Tussenstand', 'Eindstand'][k % 3 + 1] AS status, CASE WHEN k % 10 = 7 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + to_hours(k) END AS ts FROM b)"""


@query(f"""WITH {_INDEX}, f AS (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(code, ''), name) ORDER BY k) AS n FROM m WHERE coalesce(nullif(code, ''), name) IS NOT NULL)
SELECT coalesce(sum(population) FILTER (WHERE status <> 'Nulstand'), 0)::BIGINT AS counted, sum(population)::BIGINT AS eligible, count(*) FILTER (WHERE status <> 'Nulstand') AS places_counted, count(*) AS places, round(coalesce(sum(population) FILTER (WHERE status <> 'Nulstand'), 0)::DOUBLE / sum(population)::DOUBLE, 9) AS percent FROM f WHERE n = 1""")
def index_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress from the index, each municipality once."""
    return status.index_progress(readers.municipalities(_index(spark, sf_dir))).withColumn("percent", F.round(fn.clamp_percent(F.col("percent") * 100) / 100, 9))


@query(f"""WITH {_INDEX} SELECT coalesce(name, '') AS name, code AS cbs_code, status, 'K' || r AS district, coalesce(strftime(ts, '%d-%m-%Y %H:%M'), '') AS published_text, replace(printf('%.1f', (k + 500) / 10.0), '.', ',') || '%' AS turnout_now_text, CASE WHEN k % 5 = 0 THEN '' ELSE replace(printf('%.1f', (k + 400) / 10.0), '.', ',') || '%' END AS turnout_before_text, 'A' || k % 4 AS first_party, CASE WHEN k % 2 = 1 THEN 'B' ELSE '' END AS second_party,
  row_number() OVER (ORDER BY ts DESC NULLS LAST, k) AS place, row_number() OVER (ORDER BY coalesce(population, 0), k) AS by_population FROM m""")
def municipality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's municipalities as shown, newest first, and by inhabitants."""
    rows = status.municipality_rows(readers.municipalities(_index(spark, sf_dir)))
    rows = sorts.place(rows, [], *sorts.order_keys(F.unix_micros("published"), False, "number"))
    rows = sorts.place(rows, [], *sorts.order_keys(F.coalesce("population", F.lit(0)), True, "number"), name="by_population")
    return rows.select("name", "cbs_code", "status", "district", "published_text", "turnout_now_text", "turnout_before_text", "first_party", "second_party", "place", "by_population")


@query(f"WITH {_N} SELECT k AS pos, upper(name) AS code, CASE WHEN k % 13 = 6 THEN 0 ELSE c END::BIGINT AS votes FROM b")
def index_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National votes of the index: what isn't a number counts 0."""
    return readers.index_votes(_index(spark, sf_dir)).select(F.col("pos").cast("int").alias("pos"), "code", "votes")


# Feed A's regions


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, _, _ = _krc()
    view = F.struct(_text(k).alias("key"), (k % 3).alias("type"), F.lit(None).cast("string").alias("cbsCode"), F.when(k % 9 != 4, F.col("name")).alias("label"), F.lit(3).alias("countParties"), (k % 5).alias("status"), (k % 6 * 3600 + 1_704_069_000).cast("bigint").alias("updated"), F.when(k % 5 == 0, "").otherwise(_text((k + 7) % 30)).alias("parent"), F.array(F.concat(F.lit("p"), _text(k)), F.lit("zz")).alias("topPartiesCurrent"))
    path = land(_one_document(inputs.nation_counts(spark, sf_dir), "views", view), work_path(spark, "regions"))
    return readers.region_views(readers.read_document(spark, path, schemas.REGIONS))


_VIEWS = f"{_N}, v AS (SELECT k, r, CASE WHEN k % 9 = 4 THEN NULL ELSE name END AS label, k % 3 AS type, k % 5 AS st, TIMESTAMP '2024-01-01 00:30:00' + to_hours(k % 6) AS ts, CASE WHEN k % 5 = 0 THEN '' ELSE ((k + 7) % 30)::VARCHAR END AS parent FROM b)"
_STATE = "CASE st WHEN 0 THEN 'Nulstand' WHEN 2 THEN 'Tussenstand' WHEN 4 THEN 'Eindstand' ELSE {} END"


@query(f"""WITH {_VIEWS} SELECT v.label, CASE v.type WHEN 0 THEN 'Gemeente' WHEN 1 THEN 'Provincie' ELSE 'Land' END AS type, {_STATE.format('st::VARCHAR').replace('st ', 'v.st ').replace('st::', 'v.st::')} AS status, strftime(v.ts, '%d-%m-%Y %H:%M') AS updated_text, CASE WHEN v.parent IN ('', '0') THEN '' ELSE coalesce(p.label, v.parent) END AS parent_label, 'p' || v.k || ', zz' AS top_current,
  row_number() OVER (ORDER BY v.ts DESC, v.k) AS place, row_number() OVER (ORDER BY v.k) AS by_key FROM v LEFT JOIN v p ON p.k::VARCHAR = v.parent""")
def region_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed A's regions as shown, newest first, without the columns that no region fills."""
    views = _views(spark, sf_dir)
    labels = inputs.nation_counts(spark, sf_dir).select(F.lit("").alias("party"), F.col("name").alias("label_short"))
    rows = status.region_rows(views, labels).join(views.select("pos", "key", "cbsCode"), "pos")
    rows = sorts.place(rows, [], *sorts.order_keys(F.unix_micros("updated"), False, "number"))
    rows = sorts.place(rows, [], *sorts.order_keys("key", True), name="by_key")
    return status.drop_empty_columns(rows, ["label", "cbsCode", "top_current", "top_previous"]).drop("pos", "key", "updated", "countParties")


@query(f"""WITH {_INDEX}, v AS (SELECT * FROM (SELECT k, CASE WHEN k % 9 = 4 THEN NULL ELSE name END AS label, k % 3 AS type, k % 5 AS st, TIMESTAMP '2024-01-01 00:30:00' + to_hours(k % 6) AS ts FROM b) WHERE type = 0),
a AS (SELECT coalesce(name, '') AS name, status, ts, 'B' AS source, 0 AS feed, k FROM m UNION ALL SELECT coalesce(label, ''), {_STATE.format("'Nulstand'")}, ts, 'A', 1, k FROM v)
SELECT name, status, epoch_us(ts)::BIGINT AS ts_us, source, place FROM (SELECT *, row_number() OVER (ORDER BY ts DESC NULLS LAST, feed, k) AS place FROM a) WHERE place <= 30""")
def ticker_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest items of both feeds' documents."""
    both = ticker.latest(ticker.items_from_index(readers.municipalities(_index(spark, sf_dir))), ticker.items_from_regions(_views(spark, sf_dir)), 30)
    rows = sorts.place(both, [], F.desc_nulls_last("ts"), F.col("_feed"), F.col("pos"))
    return rows.select("name", "status", F.unix_micros("ts").alias("ts_us"), "source", "place")


@query(f"""WITH {_VIEWS} SELECT strftime(TIMESTAMP '2023-11-14 22:13:20', '%d-%m-%Y %H:%M:%S') AS document_time, label AS municipality, strftime(ts, '%d-%m-%Y %H:%M') AS municipality_time FROM v WHERE type = 0 ORDER BY k LIMIT 1""")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of a results document and the first municipality of the regions."""
    document = spark.createDataFrame([('{"updated": 1700000000, "parties": []}',)], "value string")
    results = readers.read_document(spark, land(document, work_path(spark, "results")), schemas.RESULTS)
    return status.document_status(results, _views(spark, sf_dir))


@query(f"""WITH {_INDEX}, o AS (SELECT arg_max(coalesce(name, ''), (ts, -k)) FILTER (WHERE ts IS NOT NULL) AS name, max(ts) AS ts FROM m), v AS (SELECT k, CASE WHEN k % 9 = 4 THEN NULL ELSE name END AS label, TIMESTAMP '2024-01-01 00:30:00' + to_hours(k % 6) AS ts FROM b WHERE k % 3 = 0)
SELECT 'B' AS source, name, epoch_us(ts)::BIGINT AS ts_us FROM o UNION ALL SELECT 'A', coalesce(arg_max(label, (ts, -k)), ''), epoch_us(max(ts))::BIGINT FROM v""")
def meta_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest municipality of each feed."""
    items = ticker.items_from_index(readers.municipalities(_index(spark, sf_dir))).unionByName(ticker.items_from_regions(_views(spark, sf_dir)))
    return status.latest_per_key(items, ["source"], "ts", ["pos"]).select("source", "name", F.unix_micros("ts").alias("ts_us"))


# Maps of elections


def _official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official votes as a map: keys of every kind, one without rows."""
    k, r, c = _krc()
    keys = F.element_at(F.array(*map(F.lit, ("TK2021", "TK2023", "2019", "PS2023", "TK2025"))), r + 1)
    lists = inputs.nation_counts(spark, sf_dir).groupBy("r").agg(F.array_sort(F.collect_list(F.struct((k + 1).alias("lijstnummer"), c.alias("votes")))).alias("x"))
    entry = F.concat(F.lit('"'), keys, F.lit('": '), F.when(r == 4, "[]").otherwise(F.to_json("x")))
    whole = lists.agg(F.array_sort(F.collect_list(F.struct("r", entry.alias("e")))).alias("s"))
    path = land(whole.select(F.concat(F.lit("{"), F.array_join("s.e", ", "), F.lit("}")).alias("value")), work_path(spark, "official"))
    return readers.read_map(spark, path, schemas.OFFICIAL)


_KEYS = f"{_N}, o AS (SELECT ['TK2021', 'TK2023', '2019', 'PS2023', 'TK2025'][r + 1] AS election, k + 1 AS list_number, c AS votes, row_number() OVER (PARTITION BY r ORDER BY k) - 1 AS pos, r FROM b)"


@query(f"WITH {_KEYS} SELECT election, pos::INT AS pos, list_number::INT AS list_number, votes::BIGINT AS votes, true AS final FROM o WHERE r <> 4")
def official_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official votes of each election, all of which are therefore final."""
    rows = readers.official_votes(_official(spark, sf_dir))
    return rows.join(readers.finalized(rows).withColumn("final", F.lit(True)), "election").select("election", F.col("pos").cast("int").alias("pos"), "list_number", "votes", "final")


@query("SELECT * FROM (VALUES ('all', 2019, 1, false), ('all', 2021, 2, false), ('all', 2023, 3, false), ('all', 2025, 4, true), ('plain', 2019, 1, true)) AS t(kind, year, place, latest)")
def election_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years that the official map names, of all keys or of plain years, and which is the latest."""
    maps, found = _official(spark, sf_dir), []
    for kind, plain in (("all", False), ("plain", True)):
        years = readers.elections(maps, plain)
        found.append(sorts.place(years, [], F.col("year")).join(readers.latest_election(maps, plain).withColumnRenamed("year", "last")).select(F.lit(kind).alias("kind"), "year", F.col("place").cast("int").alias("place"), (F.col("year") == F.col("last")).alias("latest")))
    return found[0].unionByName(found[1])


# Tables as shown


@query(f"""{_SUMMARY}, u AS (SELECT party, seats, surplus, pos, is_total FROM (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM q) UNION ALL SELECT 'Totaal', sum(seats)::BIGINT, NULL, 0, 1 FROM q)
SELECT party, seats, row_number() OVER (ORDER BY is_total, seats DESC, pos) AS by_seats, row_number() OVER (ORDER BY is_total, coalesce(surplus, 0), pos) AS by_surplus, row_number() OVER (ORDER BY is_total, party DESC, pos) AS by_party FROM u""")
def table_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seat table sorted by seats, by votes to spare as they are shown, and by party; the total stays last."""
    rows = margins.margins(al.allocate(inputs.brand_votes(spark, sf_dir), [], house=25), [], house=25)
    rows = margins.with_total(margins.seat_rows(rows, []), []).withColumn("shown", F.coalesce(fn.format_number_nl("surplus"), F.lit("")))
    for name, column, ascending, kind in (("by_seats", "seats", False, "number"), ("by_surplus", "shown", True, "shown"), ("by_party", "party", False, "plain")):
        rows = sorts.place(rows, [], *sorts.order_keys(column, ascending, kind, "is_total"), name=name)
    return sorts.table_order(rows, F.col("by_seats")).select("party", "seats", "by_seats", "by_surplus", "by_party")


@query(f"WITH RECURSIVE {_YEARS} {_allocation(25)} SELECT e::INT AS election, party, row_number() OVER (PARTITION BY e ORDER BY votes DESC, pos) AS place FROM f JOIN r USING (e) WHERE full_seats > 0 AND remainder > 0")
def matrix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parties of the average matrix, most votes first."""
    seats = al.full_seats(inputs.year_nation_votes(spark, sf_dir), ["election"], house=25)
    rows = al.average_matrix(seats, ["election"]).select("election", "party", "pos", "votes").distinct()
    return sorts.place(rows, ["election"], *sorts.order_keys("votes", False, "number")).select("election", "party", "place")


_SIDES = """p AS (SELECT p_brand AS party, sum(CASE WHEN year(l_shipdate) = 1997 THEN l_quantity ELSE 0 END)::BIGINT AS votes, sum(CASE WHEN year(l_shipdate) = 1996 THEN l_quantity ELSE 0 END)::BIGINT AS previous,
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END)::BIGINT AS vb, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT AS vo FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
n AS (SELECT *, replace(party, 'Brand#', '')::INT AS k, row_number() OVER (ORDER BY party) AS pos FROM p),
s AS (SELECT CASE WHEN k % 4 <> 0 THEN k ELSE pos END::BIGINT AS list_number, pos, party, CASE WHEN k % 4 <> 0 THEN 'Brand ' || k ELSE '' END AS label, votes, CASE WHEN k % 4 <> 0 AND k % 3 <> 0 THEN vb ELSE 0 END AS votes_b, CASE WHEN k % 4 <> 0 THEN vo ELSE 0 END AS votes_official, votes - previous AS difference, CASE WHEN votes = 0 THEN '-Infinity'::DOUBLE ELSE round((votes - previous)::DOUBLE / votes * 100, 1) END AS change_key FROM n)"""
_VOTE_KEYS = (("lijst", "list_number", "number"), ("key", "label", "text"), ("votes", "votes", "number"), ("nos_votes", "votes_b", "number"), ("official_votes", "votes_official", "number"), ("percentage", "share", "text"), ("vote_diff", "difference", "number"), ("percentage_diff", "change_key", "number"))


@query(f"""WITH {_SIDES}, x AS (SELECT *, coalesce(try_cast(nullif(replace(label, 'Brand ', ''), '') AS INT), 0) AS lab, votes * 1000 // (SELECT sum(votes)::BIGINT FROM s) AS share FROM s)
SELECT party, row_number() OVER (ORDER BY list_number, party) AS by_lijst, row_number() OVER (ORDER BY label <> '', lab, party) AS by_key, row_number() OVER (ORDER BY votes DESC, party) AS by_votes, row_number() OVER (ORDER BY votes_b DESC, party) AS by_nos_votes, row_number() OVER (ORDER BY votes_official DESC, party) AS by_official_votes,
  row_number() OVER (ORDER BY share DESC, party) AS by_percentage, row_number() OVER (ORDER BY difference DESC, party) AS by_vote_diff, row_number() OVER (ORDER BY change_key DESC, party) AS by_percentage_diff FROM x""")
def vote_table_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The votes table by each of its eight keys: the first two ascending, the others descending; ties by party."""
    rows = once(_side_by_side(spark, sf_dir), "sides")
    total = rows.agg(F.sum("votes").alias("all_votes"))
    rows = rows.join(total).withColumn("share", _text(F.expr("votes * 1000 div all_votes"))).drop("all_votes")
    for name, column, kind in _VOTE_KEYS:
        rows = sorts.place(rows, [], *sorts.order_keys(column, name in ("lijst", "key"), kind, pos="party"), name=f"by_{name}")
    return rows.select("party", *(f"by_{name}" for name, _, _ in _VOTE_KEYS))


@query(f"""WITH {_SIDES}, t AS (SELECT sum(votes)::BIGINT AS a, sum(votes_b)::BIGINT AS b, sum(votes_official)::BIGINT AS o FROM s), z AS (SELECT list_number, label, votes, votes_b, votes_official, 0 AS is_total FROM s UNION ALL SELECT NULL, 'Totaal', a, b, o, 1 FROM t)
SELECT list_number, label, CASE WHEN votes = 0 THEN '' ELSE replace(format('{{:,}}', votes), ',', '.') END AS votes, CASE WHEN votes_b = 0 THEN '' ELSE replace(format('{{:,}}', votes_b), ',', '.') END AS votes_b, CASE WHEN votes_official = 0 THEN '' ELSE replace(format('{{:,}}', votes_official), ',', '.') END AS votes_official, is_total FROM z""")
def votes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The votes table as shown, with its total row."""
    return reconcile.with_votes_total(once(_side_by_side(spark, sf_dir), "sides"), "Totaal")


@query(f"""WITH {_SIDES}, t AS (SELECT sum(votes)::BIGINT AS votes, sum(votes_b)::BIGINT AS votes_b, sum(votes_official)::BIGINT AS votes_official FROM s), u AS (SELECT 'all' AS case_name, * FROM t UNION ALL SELECT 'feeds', votes, votes_b, 0 FROM t UNION ALL SELECT 'tie', votes, votes, 0 FROM t),
c AS (SELECT *, CASE WHEN votes_official > 0 THEN 'official' WHEN votes_b > votes THEN 'b' ELSE 'a' END AS sort_column, CASE WHEN votes_official > 0 THEN votes_official WHEN votes_b > votes THEN votes_b ELSE votes END::BIGINT AS total FROM u)
SELECT case_name, sort_column, total, floor(total / 150::DOUBLE)::BIGINT AS quota_whole, nullif(round((total / 150::DOUBLE - floor(total / 150::DOUBLE)) * 150)::BIGINT, 0) AS quota_parts, floor(total / 150::DOUBLE * 0.25)::BIGINT AS threshold FROM c""")
def votes_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column that the votes table is sorted by at first, and the quota of its source: with official votes, without, and with equal feeds."""
    rows = once(_side_by_side(spark, sf_dir), "sides")
    cases = {"all": rows, "feeds": rows.withColumn("votes_official", F.lit(0)), "tie": rows.withColumns({"votes_official": F.lit(0), "votes_b": F.col("votes")})}
    found = [reconcile.votes_total(x).select(F.lit(name).alias("case_name"), "sort_column", "total", "quota_whole", "quota_parts", "threshold") for name, x in cases.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"WITH RECURSIVE {_YEARS.replace('AS votes FROM', 'AS raw FROM').replace('SELECT *, row_number()', 'SELECT e, party, CASE WHEN e % 2 = 0 THEN 0 ELSE raw END AS votes, row_number()')} {_allocation(25).replace('floor(votes / (total / 25::DOUBLE))', 'CASE WHEN total = 0 THEN 0 ELSE floor(votes / (total / 25::DOUBLE)) END')} SELECT e::INT AS election, party, CASE WHEN total > 0 THEN full_seats END AS full_seats, CASE WHEN total > 0 THEN seats END AS seats FROM s")
def no_votes_yet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elections of even years have no votes yet: their tables stay empty."""
    votes = inputs.year_nation_votes(spark, sf_dir).withColumn("votes", F.when(F.col("election") % 2 == 0, 0).otherwise(F.col("votes")))
    return al.shown_seats(al.allocate(votes, ["election"], house=25), ["election"]).select("election", "party", "full_seats", "seats")


@query("""WITH n AS (SELECT n_regionkey AS e, n_nationkey AS k, upper(n_name) AS name FROM nation), t AS (SELECT e, t, min(k * 3 + p) AS f FROM n, (VALUES ('21:45', 0), ('21:00', 1), ('23:00', 2)) AS x(t, p) WHERE p < 2 OR k % 2 = 1 GROUP BY e, t),
z AS (SELECT e, string_agg(t || ' 0 zetels', chr(10) ORDER BY f) AS zeros FROM t GROUP BY e), p AS (SELECT *, 'N' AS kind FROM n UNION ALL SELECT DISTINCT e, e, 'ABSENT', 'X' FROM n)
SELECT p.e::VARCHAR AS election, name, 'Exitpoll Ipsos' || chr(10) || CASE WHEN kind = 'X' THEN zeros ELSE '21:45 ' || k || ' zetels' || chr(10) || '21:00 ' || (k + 1) || ' zetels' || CASE WHEN k % 2 = 1 THEN chr(10) || '23:00 7 zetels' ELSE '' END END AS text FROM p JOIN z ON z.e = p.e""")
def poll_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each party's exit polls by time, and noughts for a party that the poll lacks."""
    _, r, _ = _krc()
    polls = once(_polls(spark, sf_dir), "polls")
    n = inputs.nation_counts(spark, sf_dir)
    rows = n.select(_text(r).alias("election"), "name").unionByName(n.select(_text(r).alias("election"), F.lit("absent").alias("name")).distinct())
    found = margins.poll_series(rows.withColumnRenamed("name", "party"), polls, readers.poll_times(polls), fn.normal_name("party"))
    return found.select("election", F.upper("party").alias("name"), margins.series_text(F.col("series")).alias("text"))


# Remote sources


_SOURCES = {"results": schemas.RESULTS, "regions": schemas.REGIONS, "index": schemas.INDEX}


@query("""SELECT * FROM (VALUES ('bundle', true, true, true, 200), ('singles', true, false, true, 200), ('nothing', false, false, false, 502)) AS t(case_name, results, regions, "index", code)""")
def remote_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote documents landed by one request, by single ones after it failed, and not at all; then read as one bundle."""
    texts = {"results": '{"key": "TK2025", "updated": 1.5, "parties": []}', "regions": '{"views": []}', "index": '{"gemeentes": []}'}

    def fetch_bundle(name: str) -> str | None:
        return json.dumps({x: json.loads(y) for x, y in texts.items()}) if name == "all" else None

    def fetch_singles(name: str) -> str | None:
        if name == "all":
            raise OSError("bad gateway")
        return {**texts, "regions": "<html>"}[name]

    found = None
    for case, fetch in (("bundle", fetch_bundle), ("singles", fetch_singles), ("nothing", lambda name: None)):
        path = work_path(spark, case)
        ingest(spark, fetch, _SOURCES, path)
        row = readers.bundle(*(readers.read_document(spark, f"{path}/{x}", schema) for x, schema in _SOURCES.items()))
        row = row.select(F.lit(case).alias("case_name"), *(F.col(x).isNotNull().alias(x) for x in _SOURCES), "code")
        found = row if found is None else found.unionByName(row)
    return found


@query("""WITH s AS (SELECT user_id % 20 AS election, event_type AS version, epoch_us(ts) AS t, CASE WHEN event_id % 4 <> 0 THEN event_id END AS body FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'), w AS (SELECT * FROM s WHERE body IS NOT NULL),
n AS (SELECT election, version, arg_max(body, (t, body)) AS body, max(t) AS t FROM w GROUP BY ALL), o AS (SELECT election, arg_max(body, (t, body)) AS stale FROM w GROUP BY election), q AS (SELECT DISTINCT user_id % 20 AS election, event_type AS version FROM events)
SELECT q.election::VARCHAR AS election, q.version, n.body, CASE WHEN n.body IS NULL THEN 'fetch' ELSE 'cache' END AS origin, o.stale FROM q LEFT JOIN n ON n.election = q.election AND n.version = q.version AND n.t >= epoch_us(TIMESTAMP '2024-01-20 12:00:00') - 1800000000 LEFT JOIN o ON o.election = q.election""")
def cached_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by election and version, answered by snapshots of the last half hour; some snapshots are broken."""
    e = inputs.user_events(spark, sf_dir).select(_text(F.col("user_id") % 20).alias("election"), F.col("event_type").alias("version"), F.col("ts").alias("snapshot_ts"), F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("body"))
    return readers.serve(e.select("election", "version").distinct(), e, "2024-01-20 12:00:00", 1800)


@query(f"WITH {_N} SELECT k, name, 2::BIGINT AS version FROM b WHERE k % 2 = 0")
def published_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers see after two versions of a table have been published."""
    k, _, _ = _krc()
    rows, path = inputs.nation_counts(spark, sf_dir).select("k", "name"), work_path(spark, "bundle")
    publish(rows, path, 1)
    publish(rows.where(k % 3 == 0), path, 2)
    publish(rows.where(k % 2 == 0), path, 2)
    return published(spark, path, "k int, name string")


@query(f"WITH {_N} SELECT 'GM' || k AS cbs_code, c AS eligible FROM b WHERE k = 7")
def municipality_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One municipality's detail, from a table partitioned by code."""
    k, _, c = _krc()
    path = work_path(spark, "details")
    inputs.nation_counts(spark, sf_dir).select(F.concat(F.lit("GM"), _text(k)).alias("cbs_code"), c.alias("eligible")).write.partitionBy("cbs_code").parquet(path)
    return readers.municipality_detail(spark.read.parquet(path), "GM7").select("cbs_code", "eligible")


@query("""SELECT event_id, epoch_us(date_trunc('second', ts))::BIGINT AS iso_us, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts))::BIGINT END AS epoch_us, greatest(0, least(100, value - 20))::DOUBLE AS clamped, event_type || '&quot;' AS quoted, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id END::BIGINT AS typed, coalesce(CASE WHEN event_id % 7 <> 0 THEN event_type END, '-') AS named FROM events""")
def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as ISO text and as seconds, clamped shares, quoted text, numbers that a schema demands, and nested values with a default."""
    e = inputs.user_events(spark, sf_dir)
    whole = F.date_trunc("second", "ts")
    number = F.from_json(F.concat(F.lit('{"n": '), F.when(F.col("event_id") % 5 == 0, '"12"').otherwise(_text(F.col("event_id"))), F.lit("}")), "n double")
    nested = F.struct(F.when(F.col("event_id") % 7 != 0, F.struct(F.col("event_type").alias("b"))).alias("a"))
    return e.select(
        "event_id", F.unix_micros(fn.from_iso(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss"))).alias("iso_us"), F.unix_micros(fn.from_epoch(F.when(F.col("event_id") % 3 != 0, _text(F.unix_seconds(whole))))).alias("epoch_us"),
        fn.clamp_percent(F.col("value") - 20).alias("clamped"), fn.html_quote(F.concat("event_type", F.lit('"'))).alias("quoted"), fn.nullish(number["n"], 0).cast("bigint").alias("typed"), fn.nullish(nested["a"]["b"], "-").alias("named"),
    )
