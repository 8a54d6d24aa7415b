"""Column expressions that turn raw cells into numbers, dates, booleans and pattern flags.

Everything here is a built-in Spark expression, so it stays in whole-stage code generation.
Text is gated by a regular expression before it is parsed: a cell that cannot be a date never
reaches a date parser, whatever its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions.constants import (
    BOOL_LIKE, CASE_FREE_PATTERNS, FALSE_WORDS, NULL_TOKENS, PATTERNS, SENTINEL_WORDS, TRUE_WORDS,
    WHITESPACE,
)

NUMBER_RE = (
    r"(?i)\A\s*[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity)\s*\z"
)
INTEGER_RE = r"\A\s*[+-]?\d+\s*\z"

_TIME = r"(?:[ T]+(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{1,9})?)?(?: ?[AaPp][Mm])?(?: ?Z| ?[+-]\d{2}:?\d{2})?)?"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH_NAME = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    r"sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
# Years a nanosecond timestamp can hold in full.
_YEAR = r"(167[89]|16[89]\d|1[7-9]\d\d|2[01]\d\d|22[0-5]\d|226[01])"
# Year first: separated, compact, year and month, year alone. Groups of the forms not met are empty.
_YEAR_FIRST_RE = (
    r"\A(?:" + _YEAR + r"([-/.])(\d{1,2})\2(\d{1,2})" + _TIME + "|" + _YEAR + r"(\d{2})(\d{2})|"
    + _YEAR + r"[-/](\d{1,2})|" + _YEAR + r")\z"
)
_YEAR_FIRST_TO = "$1$5$8$10-$3$6$9-$4$7"
_MDY_RE = r"\A(\d{1,2})([-/.])(\d{1,2})\2(?:" + _YEAR + r"|(\d{2}))" + _TIME + r"\z"
_NAME_FIRST_RE = r"(?i)\A" + _MONTH_NAME + r"\.? (\d{1,2}),? " + _YEAR + _TIME + r"\z"
_DAY_FIRST_RE = r"(?i)\A(\d{1,2})[ -]" + _MONTH_NAME + r"\.?,?[ -]" + _YEAR + _TIME + r"\z"
_QUARTER_RE = r"(?i)\A" + _YEAR + r"-?q([1-4])\z"
# Any accepted date starts with a digit or a month name and is short; one cheap test first.
_DATE_GATE_RE = r"(?i)\A(?:\d{1,4}[-/. qjfmasond]|\d{8}\z|\d{4}\z|" + _MONTH_NAME + r"\b)"


def col(name: str) -> Column:
    """A column by its literal name; dots and back-ticks in the name are data, not syntax."""
    return F.col("`" + name.replace("`", "``") + "`")


def any_of(flags: list[Column]) -> Column:
    """True where any flag is true; false for an empty list."""
    return reduce(lambda a, b: a | b, flags) if flags else F.lit(False)


def storage_of(data_type: T.DataType) -> str:
    """Storage class of a Spark type: int, float, bool, timestamp or object (text)."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(data_type, T.StringType):
        return "object"
    raise TypeError(f"column type {data_type.simpleString()} is not a table cell; flatten it first")


def nan_to_null(c: Column, data_type: T.DataType) -> Column:
    """NaN counts as missing."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def fold_null_tokens(c: Column) -> Column:
    return F.when(~c.isin(*NULL_TOKENS), c)


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` alone removes only blanks)."""
    return F.btrim(c, F.lit(WHITESPACE))


def to_number(c: Column, storage: str = "object") -> Column:
    """Number in the cell as double, null where there is none.

    The regular expression is needed because ``try_cast`` also accepts suffixes such as ``5f``.
    """
    if storage in ("int", "float", "bool"):
        return c.cast("double")
    if storage == "timestamp":
        return F.lit(None).cast("double")
    return F.when(c.rlike(NUMBER_RE), c.try_cast("double"))


def _month_number(name: Column) -> Column:
    at = F.instr(F.lit(_MONTHS), F.lower(F.substring(name, 1, 3)))
    return ((at + 2) / 3).cast("int").cast("string")


def to_date(c: Column, storage: str = "object") -> Column:
    """Calendar date in the cell, null where there is none.

    Each cell is matched to one written form (year first, month first with day first as second
    reading, month names, quarter), rewritten to ``year-month-day`` text and cast once. Clock words
    such as ``now`` and bare times are not dates. Years 1678 to 2261 are accepted.
    """
    if storage == "timestamp":
        return c.cast("date")
    if storage != "object":
        return F.lit(None).cast("date")
    s = strip(c)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(s, pattern, group)

    century = (F.when(part(_MDY_RE, 5) == "", F.lit("")).when(part(_MDY_RE, 5) >= "70", F.lit("19"))
               .otherwise(F.lit("20")))
    day_first = part(_MDY_RE, 1).try_cast("int") > 12
    order = F.when(day_first, F.lit("$4$5-$3-$1")).otherwise(F.lit("$4$5-$1-$3"))
    written = (
        F.when(s.rlike(_YEAR_FIRST_RE), F.rtrim(F.regexp_replace(s, _YEAR_FIRST_RE, _YEAR_FIRST_TO), F.lit("-")))
        .when(s.rlike(_MDY_RE), F.concat(century, F.regexp_replace(s, F.lit(_MDY_RE), order)))
        .when(s.rlike(_NAME_FIRST_RE), F.concat_ws(
            "-", part(_NAME_FIRST_RE, 3), _month_number(part(_NAME_FIRST_RE, 1)), part(_NAME_FIRST_RE, 2)))
        .when(s.rlike(_DAY_FIRST_RE), F.concat_ws(
            "-", part(_DAY_FIRST_RE, 3), _month_number(part(_DAY_FIRST_RE, 2)), part(_DAY_FIRST_RE, 1)))
        .when(s.rlike(_QUARTER_RE), F.concat_ws(
            "-", part(_QUARTER_RE, 1), (part(_QUARTER_RE, 2).try_cast("int") * 3 - 2).cast("string"), F.lit("1")))
    )
    return F.when(s.rlike(_DATE_GATE_RE), written).try_cast("date")


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def to_bool(c: Column, storage: str = "object") -> Column:
    """true / false words, trimmed and in any case; numeric 1 and 0; everything else null."""
    if storage == "bool":
        return c
    if storage in ("int", "float"):
        return F.when(c == 1, F.lit(True)).when(c == 0, F.lit(False))
    if storage == "timestamp":
        return F.lit(None).cast("boolean")
    word = F.lower(strip(c))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def cell_text(c: Column, storage: str) -> Column:
    """Text of a cell as reports show it; booleans read True / False."""
    if storage == "bool":
        return F.initcap(c.cast("string"))
    return c.cast("string")


def number_text(c: Column) -> Column:
    """Text of a double as reports show listed numbers: 12000000.0, 0.5, 1e+16."""
    short = c.cast("string")
    plain = F.regexp_replace(short.cast("decimal(38,22)").cast("string"), "0+$", "")
    power = F.split_part(short, F.lit("E"), F.lit(2)).cast("int")
    far = F.format_string("%se%s%02d", F.regexp_replace(F.split_part(short, F.lit("E"), F.lit(1)), r"\.0$", ""),
                          F.when(power < 0, "-").otherwise("+"), F.abs(power))
    return (F.when(F.abs(c) == float("inf"), F.when(c < 0, "-inf").otherwise("inf")).when(c == 0, "0.0")
            .when((F.abs(c) >= 1e-4) & (F.abs(c) < 1e16), F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain))
            .otherwise(far))


def matches(c: Column, pattern: str) -> Column:
    """The whole cell has the named format."""
    flags = "(?iU)" if pattern in CASE_FREE_PATTERNS else "(?U)"
    return c.rlike(flags + r"\A(?:" + PATTERNS[pattern] + r")\z")


def is_bool_like(c: Column) -> Column:
    return c.isin(*BOOL_LIKE)


def is_sentinel_word(c: Column) -> Column:
    """A word for "no value"; only cells as short as such words are lowered and compared."""
    s = strip(c)
    return (F.length(s) <= max(map(len, SENTINEL_WORDS))) & F.lower(s).isin(*SENTINEL_WORDS)


def equals_any(c: Column, values: list, storage: str, coerce: bool = False) -> Column:
    """The cell equals one of a plan's sentinel values, compared within its storage type.

    A number in the list does not equal a text cell unless ``coerce`` is set.
    """
    numbers = [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    words = [v for v in values if isinstance(v, str)]
    flags = []
    if storage in ("int", "float") and numbers:
        flags.append(c.isin(*numbers))
    if storage == "object":
        if words:
            flags.append(c.isin(*words))
        if numbers and coerce:
            flags.append(F.coalesce(to_number(c).isin(*numbers), F.lit(False)))
    return F.coalesce(any_of(flags), F.lit(False))
