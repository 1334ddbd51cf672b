"""Scalar functions as Column expressions: parsing, nl-NL formatting, defaults, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Amsterdam"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Parsing


def parse_int(x: Column | str) -> Column:
    """The leading integer of a text, null without one."""
    return F.regexp_extract(col(x).cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def number_or_null(x: Column | str) -> Column:
    """The whole text as a number, null if it isn't one, 0 if it is blank: decimal with a sign and an exponent or without, Infinity, or whole in base 16, 8 or 2 (0x, 0o, 0b; up to 64 bits). White space around it doesn't count."""
    text = F.regexp_replace(col(x).cast("string"), r"^[\s\u00A0\uFEFF]+|[\s\u00A0\uFEFF]+$", "")
    based = F.when(F.lit(False), 0.0)
    for mark, base, digits in (("x", 16, "0-9a-f"), ("o", 8, "0-7"), ("b", 2, "01")):
        based = based.when(text.rlike(f"^(?i)0{mark}[{digits}]+$"), F.conv(F.substring(text, 3, 1 << 20), base, 10).try_cast("double"))
    endless = F.when(text.startswith("-"), float("-inf")).otherwise(float("inf"))
    number = based.when(text.rlike(r"^[+-]?Infinity$"), endless).when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(text == "", 0.0).otherwise(number)


def number_or_zero(x: Column | str) -> Column:
    """number_or_null(), 0 instead of null."""
    return F.coalesce(number_or_null(x), F.lit(0.0))


def json_kind(x: Column | str) -> Column:
    """What a VARIANT holds: number, text, boolean, null, object or array; null where there is none."""
    shape = F.schema_of_variant(col(x))
    named = F.when(shape == "VOID", "null").when(shape == "STRING", "text").when(shape == "BOOLEAN", "boolean")
    return named.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape.isNotNull(), "number")


def strict_number(x: Column | str) -> Column:
    """The number that a VARIANT holds, 0 if it holds anything else: a text of digits isn't a number."""
    return F.when(json_kind(x) == "number", F.try_variant_get(col(x), "$", "double")).otherwise(0.0)


def loose_number(x: Column | str) -> Column:
    """A VARIANT's number: null and blank texts are 0, booleans 0 or 1, texts what they say; null for objects, arrays and what isn't there."""
    kind = json_kind(x)
    as_text = number_or_null(F.try_variant_get(col(x), "$", "string"))
    return F.when(kind == "number", F.try_variant_get(col(x), "$", "double")).when(kind == "null", 0.0).when(kind == "boolean", F.try_variant_get(col(x), "$", "boolean").cast("double")).when(kind == "text", as_text)


def parse_decimal_comma(x: Column | str) -> Column:
    return F.regexp_replace(col(x), "^([^,]*),", "$1.").try_cast("double")


def strip_separators(x: Column | str) -> Column:
    return parse_int(F.regexp_replace(col(x), "[.,]", ""))


def parse_nl_datetime(x: Column | str) -> Column:
    """Epoch milliseconds of a text that begins dd-mm-yyyy HH:MM[:SS], read in the session's zone; 0 for any other."""
    pattern = r"^(\d{2})-(\d{2})-(\d{4}) (\d{2}):(\d{2})(?::(\d{2}))?"
    part = lambda n: F.regexp_extract(col(x), pattern, n)
    seconds = F.when(part(6) == "", "00").otherwise(part(6))
    iso = F.concat(part(3), F.lit("-"), part(2), F.lit("-"), part(1), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), seconds)
    return F.coalesce(F.unix_millis(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm:ss"))), F.lit(0).cast("bigint"))


def from_epoch(x: Column | str) -> Column:
    return F.timestamp_seconds(col(x).try_cast("double"))


def from_iso(x: Column | str) -> Column:
    return F.try_to_timestamp(col(x).cast("string"))


def year_of(x: Column | str) -> Column:
    """The first four digits, empty without them."""
    return F.regexp_extract(col(x), r"\d{4}", 0)


def two_digit_year(x: Column | str) -> Column:
    return F.right(col(x).cast("string"), F.lit(2))


def election_key(x: Column | str, default: str = "TK2025") -> Column:
    """PSyyyy or TKyyyy in any case; otherwise TK and the digits; the default without digits."""
    text = F.upper(F.trim(F.coalesce(col(x), F.lit(""))))
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(text.rlike(r"^(PS|TK)\d{4}$"), text).when(digits != "", F.concat(F.lit("TK"), digits)).otherwise(default)


# Defaults: null only, or null and what counts as nothing


def nullish(x: Column | str, default: object) -> Column:
    return F.coalesce(col(x), F.lit(default) if not isinstance(default, Column) else default)


def falsy_number(x: Column | str, default: object) -> Column:
    return nullish(F.when(F.isnan(col(x).cast("double")) | (col(x) == 0), None).otherwise(col(x)), default)


def falsy_text(x: Column | str, default: object) -> Column:
    return nullish(F.nullif(col(x), F.lit("")), default)


def blank_zero(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(0))


# Formatting


def format_number_nl(x: Column | str) -> Column:
    """A number with points between thousands and, after a comma, up to three decimals."""
    text = F.format_number(F.round(col(x), 3), 3)
    return F.translate(F.regexp_replace(text, r"\.?0+$", ""), ",.", ".,")


def format_fixed_nl(x: Column | str, digits: int = 1) -> Column:
    text = F.replace(F.format_string(f"%.{digits}f", col(x).cast("double")), F.lit("."), F.lit(","))
    return F.when(col(x).isNotNull(), text)


def round_scaled(x: Column | str, digits: int = 1) -> Column:
    """A double rounded half away from zero once it is scaled, as SQL's round does: (316174 - 4000) / 4000 * 100 is
    7804.349999999999 in doubles, but 78043.5 tenths, hence 7804.4. What rounds to 0 keeps its sign."""
    scaled = col(x).cast("double") * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < 0.5, scaled * 0).otherwise(F.round(scaled)) / F.lit(10.0**digits)


def format_permille(x: Column | str, mark: str = "") -> Column:
    """Permille as a percentage with one decimal; empty for null."""
    return F.coalesce(F.concat(format_fixed_nl(col(x) / 10), F.lit(mark)), F.lit(""))


def format_change(now: Column | str, before: Column | str) -> Column:
    """Change against before in percent with one decimal, a dash where there was nothing before."""
    a, b = col(now), F.coalesce(col(before), F.lit(0))
    return F.when(b == 0, "-").otherwise(format_fixed_nl(round_scaled((a - b) / F.nullif(b, F.lit(0)) * 100)))


def format_datetime_nl(x: Column | str) -> Column:
    """dd-MM-yyyy HH:mm, with seconds unless they are 00; empty for null. The session's zone holds."""
    t = col(x)
    return F.coalesce(F.when(F.second(t) == 0, F.date_format(t, "dd-MM-yyyy HH:mm")).otherwise(F.date_format(t, "dd-MM-yyyy HH:mm:ss")), F.lit(""))


def _age(seconds: Column) -> Column:
    n = lambda d: F.floor(seconds / d).cast("string")
    return F.when(seconds < 60, F.concat(n(1), F.lit("s"))).when(seconds < 3600, F.concat(n(60), F.lit("m"))).when(seconds < 86400, F.concat(n(3600), F.lit("u"))).otherwise(F.concat(n(86400), F.lit("d")))


def relative_time(x: Column | str, as_of: Column) -> Column:
    """How long ago in the largest whole unit; times to come are 0s ago; empty for null."""
    seconds = F.greatest(F.lit(0).cast("bigint"), F.floor((F.unix_micros(as_of) - F.unix_micros(col(x))) / 1_000_000))
    return F.when(col(x).isNull(), "").otherwise(F.concat(_age(seconds), F.lit(" geleden")))


def relative_time_signed(x: Column | str, as_of: Column) -> Column:
    """As relative_time, but a time to come reads as a time from now."""
    late = F.unix_micros(as_of) >= F.unix_micros(col(x))
    ahead = F.floor((F.unix_micros(col(x)) - F.unix_micros(as_of)) / 1_000_000)
    return F.when(col(x).isNull(), "").when(late, relative_time(x, as_of)).otherwise(F.concat(F.lit("over "), _age(ahead)))


def fraction(x: Column | str, most: int = 100, near: float = 1e-6) -> Column:
    """(numerator, denominator) with the least denominator from 2 that fits x, reduced; null where none does."""
    value = col(x)
    fits = F.filter(F.sequence(F.lit(2), F.lit(most - 1)), lambda d: F.abs(F.round(value * d) - value * d) < near)
    d = F.get(fits, F.lit(0))
    n = F.round(value * d).cast("bigint")
    # A denominator from 2 up may share a factor only for whole numbers, where the least fit is 2.
    whole = n % d == 0
    return F.when(d.isNotNull(), F.struct(F.when(whole, (n / d).cast("bigint")).otherwise(n).alias("numerator"), F.when(whole, 1).otherwise(d).cast("bigint").alias("denominator")))


def quota_parts(total: Column, house: int) -> tuple[Column, Column]:
    """The quota's whole part and its rest in parts of the house, not reduced; a rest of 0 is null."""
    quota = total / F.lit(float(house))
    whole = F.floor(quota)
    return whole, blank_zero(F.round((quota - whole) * house).cast("bigint"))


def truncate_text(x: Column | str, most: int = 34) -> Column:
    return F.when(F.length(col(x)) > most, F.concat(F.substring(col(x), 1, most - 3), F.lit("…"))).otherwise(col(x))


def html_quote(x: Column | str) -> Column:
    return F.replace(col(x), F.lit('"'), F.lit("&quot;"))


def clamp_percent(x: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), col(x).cast("double")))


# Names, codes, keys


def normal_name(x: Column | str) -> Column:
    return F.upper(F.trim(F.coalesce(col(x), F.lit(""))))


def decode(x: Column | str, names: dict, default: Column | str | None = None) -> Column:
    """An enumeration's name. default: a Column, a text, or None for the code itself."""
    pairs = F.create_map(*(F.lit(v) for pair in names.items() for v in pair))
    other = col(x).cast("string") if default is None else (default if isinstance(default, Column) else F.lit(default))
    return F.coalesce(F.try_element_at(pairs, col(x)), other)


def status_class(x: Column | str) -> Column:
    low = F.lower(F.coalesce(col(x), F.lit("")))
    return F.when(low.startswith("tussen"), "partial").when(low.startswith("eind"), "final").otherwise("zero")


def natural_key(x: Column | str) -> list[Column]:
    """Sort keys that order texts by locale with numbers by their value: each run of digits is led by its length, letters are in the order of Unicode's root collation (case and accents only settle ties)."""
    digits = lambda run: F.regexp_replace(run, "^0+(?=[0-9])", "")
    runs = F.regexp_extract_all(col(x), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    keyed = F.transform(runs, lambda run: F.when(run.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(run)).cast("string"), 9, "0"), digits(run))).otherwise(run))
    return [F.collate(F.array_join(keyed, ""), "UNICODE")]


def content_tag(*columns: Column | str) -> Column:
    """A fingerprint of values by their JSON text."""
    return F.sha1(F.to_json(F.struct(*columns)))
