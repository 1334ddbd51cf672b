"""Allocation against a plain greedy loop, and against the seats of known elections."""

import json
import math
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seatloom import schemas
from seatloom.operators import allocate as al
from seatloom.operators import margins as mg
from seatloom.operators.reconcile import official_to_parties
from seatloom.sources import readers

# Official votes by list in order of list number, and the seats of the parties that won any.
VOTES = {
    "TK2021": [
        ("VVD", 2279130), ("PVV", 1124482), ("CDA", 990601), ("D66", 1565861), ("GL", 537308), ("SP", 623371), ("PVDA", 597192), ("CU", 351275), ("PVDD", 399750), ("50PLUS", 106702),
        ("SGP", 215249), ("DENK", 211237), ("FVD", 523083), ("BIJ1", 87238), ("JA21", 246620), ("COORANJE", 40731), ("VOLT", 252480), ("NIDA", 33834), ("PIRATEN", 22816), ("LIBERP", 5546),
        ("JONG", 15297), ("SPLINTER", 30328), ("BBB", 104319), ("NLBETER", 8657), ("HENKKROL", 9264), ("OPRECHT", 5449), ("JEZUSLFT", 5015), ("TROTS", 13198), ("UBUNTU", 1880), ("BLANCOZV", 8277),
        ("PVDE", 804), ("DFP", 3744), ("VSN", 942), ("WIJZNL", 553), ("MODERNNL", 245), ("GROENEN", 119), ("PVDR", 255),
    ],
    "TK2023": [
        ("VVD", 1589519), ("D66", 656292), ("GL-PvdA", 1643073), ("PVV", 2450878), ("CDA", 345822), ("SP", 328225), ("FvD", 232963), ("PVDD", 235148), ("ChristenUnie", 212532), ("Volt", 178802),
        ("JA21", 71345), ("SGP", 217270), ("Denk", 246765), ("50Plus", 51043), ("BBB", 485551), ("Bij1", 44253), ("Piraten", 9117), ("BVNL", 52913), ("NSC", 1343287), ("Splinter", 12838),
        ("LP", 4152), ("LEF", 5122), ("SAMEN", 5325), ("NLPLAN", 5487), ("PvdSport", 3966), ("PvBasisinkomen", 1038),
    ],
}
SEATS = {
    "TK2021": {"VVD": 34, "PVV": 17, "CDA": 15, "D66": 24, "GL": 8, "SP": 9, "PVDA": 9, "CU": 5, "PVDD": 6, "50PLUS": 1, "SGP": 3, "DENK": 3, "FVD": 8, "BIJ1": 1, "JA21": 3, "VOLT": 3, "BBB": 1},
    "TK2023": {"VVD": 24, "D66": 9, "GL-PvdA": 25, "PVV": 37, "CDA": 5, "SP": 5, "FvD": 3, "PVDD": 3, "ChristenUnie": 3, "Volt": 2, "JA21": 1, "SGP": 3, "Denk": 3, "BBB": 7, "NSC": 20},
}


def greedy(votes, house):
    quota = sum(votes) / house
    full = [math.floor(v / quota) if quota else 0 for v in votes]
    rest, order = [0] * len(votes), []
    for _ in range(house - sum(full)):
        best, at = -1, None
        for i, v in enumerate(votes):
            if full[i] >= 1 and math.floor(v / (full[i] + rest[i] + 1) + 0.5) > best:
                best, at = math.floor(v / (full[i] + rest[i] + 1) + 0.5), i
        if at is None:
            break
        rest[at] += 1
        order.append(at)
    return full, rest, order


@given(st.lists(st.lists(st.integers(0, 5000), min_size=1, max_size=9), min_size=1, max_size=8), st.integers(5, 40))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_allocation_is_the_greedy_loop(spark, elections, house):
    rows = [(e, f"p{i}", i, v) for e, votes in enumerate(elections) for i, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "e int, party string, pos int, votes bigint")
    got = {(r.e, r.pos): (r.full_seats, r.rest_seats) for r in al.allocate(df, ["e"], house).collect()}
    order = {}
    for r in al.awards(al.full_seats(df, ["e"], house), ["e"]).orderBy("e", "round").collect():
        order.setdefault(r.e, []).append(r.pos)
    for e, votes in enumerate(elections):
        full, rest, rounds = greedy(votes, house)
        assert [got[e, i] for i in range(len(votes))] == list(zip(full, rest))
        assert order.get(e, []) == rounds
        if any(full):
            assert sum(full) + sum(rest) == house


def test_quota_in_doubles_and_exact(spark):
    df = spark.createDataFrame([("a", 1, 7), ("b", 2, 14)], "party string, pos int, votes bigint")
    seats = lambda exact: {r.party: r.full_seats for r in al.full_seats(df, [], 150, exact).collect()}
    assert seats(False)["a"] == 49
    assert seats(True)["a"] == Fraction(7 * 150, 21)


def test_nobody_votes(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 2, None)], "party string, pos int, votes bigint")
    assert [(r.full_seats, r.rest_seats) for r in al.allocate(df, []).collect()] == [(0, 0), (0, 0)]
    assert al.allocate(df.limit(0), []).count() == 0


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The JSON layouts with the fixed values."""
    folder = tmp_path_factory.mktemp("json")
    (folder / "official.json").write_text(json.dumps({e: [{"lijstnummer": k, "votes": n} for k, (_, n) in enumerate(rows, 1)] for e, rows in VOTES.items()}, indent=1))
    (folder / "labels.json").write_text(json.dumps({e: [{"key": f"k{k}", "labelLong": "", "labelShort": name} for k, (name, _) in enumerate(rows)] for e, rows in VOTES.items()}, indent=1))
    return folder


@pytest.fixture(scope="module")
def labels(spark, folder):
    return readers.labels(readers.read_map(spark, str(folder / "labels.json"), schemas.LABELS))


GOLDEN = {
    "TK2021": (10_422_852, 139, "SP VVD D66 GL VVD PVDD PVDA PVV CDA FVD D66", "D66", "VVD", 4418),
    "TK2023": (10_432_726, 140, "BBB CDA VVD GL-PvdA PVV NSC PVV VVD GL-PvdA SP", "SP", "D66", 159),
}


@pytest.mark.parametrize("election", GOLDEN)
def test_known_elections(spark, folder, labels, election):
    total, full, order, winner, loser, short = GOLDEN[election]
    rows = readers.official_votes(readers.read_map(spark, str(folder / "official.json"), schemas.OFFICIAL)).where(F.col("election") == election)
    votes = official_to_parties(rows, labels, ["election"])
    seats = al.allocate(votes, ["election"])
    named = {r.party: r.label_short.upper() for r in labels.where(F.col("election") == election).collect()}
    rows = seats.collect()
    assert sum(r.votes for r in rows) == total and sum(r.full_seats for r in rows) == full and sum(r.seats for r in rows) == 150
    won = al.awards(al.full_seats(votes, ["election"]), ["election"]).orderBy("round").collect()
    assert [named[r.party] for r in won] == order.upper().split()
    pair = mg.margin_pair(mg.margins(seats, ["election"]), ["election"]).first()
    assert (named[pair.winner], named[pair.loser], pair.short) == (winner, loser, short)
    assert {named[r.party]: r.seats for r in rows if r.seats} == {k.upper(): n for k, n in SEATS[election].items()}


def test_documents_of_both_layouts(spark, tmp_path):
    figures = lambda v, p, s: {"votes": v, "percentage": p, "seats": s}
    party = {"key": 37, "results": {"current": figures("1588436", "15,3", "0"), "previous": figures("2279130", "21,9", "34"), "diff": figures("-690694", "-6,6", "")}}
    (tmp_path / "new.json").write_text(json.dumps({"key": "500", "updated": 1761935897.5, "status": 4, "parties": [party]}, indent=1))
    row = readers.party_results(readers.read_document(spark, str(tmp_path / "new.json"), schemas.RESULTS), "TKx").first()
    assert (row.party, row.current_votes, float(row.current_percentage), row.diff_votes, row.diff_seats, row.election) == ("37", 1588436, 15.3, -690694, None, "TKx")
    old = {"updated": "2019-03-22 12:25:52", "parties": [{"labelShort": "VVD", "now": {"count": "1015216", "perc": "13.9", "seats": "12"}, "last": {"count": "960000", "perc": "15.8", "seats": "13"}}]}
    (tmp_path / "old.json").write_text(json.dumps(old))
    row = readers.old_party_results(readers.read_document(spark, str(tmp_path / "old.json"), schemas.OLD_RESULTS), "PSx").first()
    assert (row.party, row.current_votes, row.current_seats, row.diff_votes, row.diff_seats, float(row.diff_percentage)) == ("VVD", 1015216, 12, 55216, -1, -1.9)
    assert readers.read_document(spark, str(tmp_path / "none.json"), schemas.RESULTS).count() == 0


def test_exit_poll_takes_the_last_in_document_order(spark, tmp_path):
    path = tmp_path / "poll.json"
    path.write_text('{"TK1": {"aa ": {"21:45": 5, "21:00": "7", "x": "none"}}, "TK0": [{"party": "b", "seats": 3}]}')
    polls = readers.exit_poll(readers.read_map(spark, str(path), schemas.EXIT_POLL))
    assert {(r.election, r.name, r.expected) for r in readers.latest_poll(polls).collect()} == {("TK1", "AA", 7), ("TK0", "B", 3)}
    path.write_text('{"TK1": {"aa": {"21:00": null, "x": {}}, "bb": 4, "cc": {"21:00": [], "22:00": "1e1"}, " ": {"21:00": 1}}, "TK0": [{"party": "b", "seats": true}, {"party": "c"}, {"seats": 9}, 5, {"party": "d", "seats": ""}], "TK2": 7, "TK3": null}')
    polls = readers.exit_poll(readers.read_map(spark, str(path), schemas.EXIT_POLL))
    assert {(r.election, r.name, r.expected) for r in readers.latest_poll(polls).collect()} == {("TK1", "AA", 0), ("TK1", "CC", 10), ("TK0", "B", 1), ("TK0", "D", 0)}
    path.write_text('{"TK2023": {}, "PS2019": {}, "2021": {}, "TK2021": {}}')
    maps = readers.read_map(spark, str(path), schemas.EXIT_POLL)
    assert [r.year for r in readers.elections(maps).collect()] == [2021, 2023]
    assert [r.year for r in readers.elections(maps, plain=True).collect()] == [2021]
