"""Explicit schemas of the JSON layouts. Keys that some files give as numbers are read as text."""

_FIGURES = "struct<votes: string, percentage: string, seats: string>"
_PAIR = "struct<current: string, previous: string>"

#: Party results of feed A, a document for each election.
RESULTS = f"""key string, source string, updated double, cbsCode string, status int, statusExtra string, parent string,
parties array<struct<key: string, results: struct<previous: {_FIGURES}, current: {_FIGURES}, diff: {_FIGURES}>>>,
turnout {_PAIR}, turnoutCount {_PAIR}, voters {_PAIR}, invalid {_PAIR}, blank {_PAIR},
countStatus struct<total: string, completed: string>"""

_COUNT = "struct<count: string, perc: string, seats: string>"
_TIMES = f"struct<now: {_COUNT}, last: {_COUNT}>"

#: The older provincial layout.
OLD_RESULTS = f"""status int, updated string, title string, source string, guid string,
totals struct<blanc: {_TIMES}, attendance: {_TIMES}, invalid: {_TIMES}, voters: {_TIMES}, countedPercentage: string>,
parties array<struct<label: string, labelShort: string, now: {_COUNT}, last: {_COUNT}>>"""

#: Region status of feed A.
REGIONS = """views array<struct<key: string, type: int, cbsCode: string, label: string, countParties: int, status: int,
updated: bigint, parent: string, topPartiesCurrent: array<string>, topPartiesPrevious: array<string>>>"""

_ELECTION = "struct<kiesgerechtigden: bigint, opkomst: bigint, opkomst_promillage: int, ongeldig: bigint, blanco: bigint>"

#: The index of feed B.
INDEX = f"""landelijke_uitslag struct<publicatie_datum_tijd: timestamp,
  partijen: array<struct<partij: struct<short_name: string>, huidig: struct<stemmen: bigint>>>,
  huidige_verkiezing: {_ELECTION}, vorige_verkiezing: {_ELECTION}>,
gemeentes array<struct<status: string, publicatie_datum_tijd: timestamp,
  gemeente: struct<naam: string, cbs_code: string, aantal_inwoners: bigint, kieskring: string, provincie: struct<naam: string, aantal_inwoners: bigint>>,
  eerste_partij: struct<short_name: string>, tweede_partij: struct<short_name: string>,
  huidige_verkiezing: struct<opkomst_promillage: int>, vorige_verkiezing: struct<opkomst_promillage: int>>>"""

#: A municipality's detail in feed B.
DETAIL = "cbs_code string, huidige_verkiezing struct<verkiezing_code: string, kiesgerechtigden: bigint>"

LABELS = "map<string, array<struct<key: string, color: string, labelLong: string, labelShort: string, labelShortNOS: string>>>"
OFFICIAL = "map<string, array<struct<lijstnummer: int, votes: bigint>>>"
EXIT_POLL = "map<string, string>"
