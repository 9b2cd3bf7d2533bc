"""Column-level building blocks. All are built-in expressions, so they stay inside codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ZONED = r":\d{2}(\.\d+)?\s*(Z|[+-]\d{2}(:?\d{2})?)$"


def money(text: Column, missing: float | None = None) -> Column:
    """Currency text to double: drop the rupee sign, commas and blanks; bad text is null (or ``missing``)."""
    bare = F.trim(F.translate(text.cast("string"), "₹,", ""))
    value = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
    return value if missing is None else F.coalesce(value, F.lit(float(missing)))


def iso_date(text: Column) -> Column:
    """Timestamp text to a UTC date. Text without an offset is taken as UTC; bad text is null."""
    text = F.trim(text.cast("string"))
    plain = text.try_cast("timestamp_ntz").cast("date")
    zoned = F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("date")
    return F.when(text.rlike(ZONED), zoned).otherwise(plain)


def iso_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def rounded(value: Column, places: int) -> Column:
    """Round half to even after scaling, the rule numeric Python libraries use."""
    scale = float(10**places)
    return F.rint(value * scale) / scale


def exact_sum(amount: Column) -> Column:
    """Sum of two-decimal money that does not depend on the order of the rows."""
    return F.sum(amount.cast("decimal(18,2)")).cast("double")


def exact_avg(amount: Column) -> Column:
    return F.try_divide(exact_sum(amount), F.count(amount).cast("double"))


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def finite(value: Column) -> Column:
    """Infinite and NaN become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp, keeping null (``greatest``/``least`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def holds(condition: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    return holds(condition).cast("int")


def clean_text(text: Column) -> Column:
    """Lower case, everything but letters and digits to single blanks, null to empty."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.trim(spaced)


def char_count(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def word_count(text: Column) -> Column:
    words = F.split(F.coalesce(text, F.lit("")), r"\s+")
    return F.size(F.filter(words, lambda w: w != ""))


def place_key(text: Column) -> Column:
    return F.coalesce(F.upper(F.trim(text)), F.lit("NAN"))


def block_key(state: Column, constituency: Column) -> Column:
    return F.concat_ws(
        "___",
        F.coalesce(state, F.lit("UNKNOWN_STATE")),
        F.coalesce(constituency, F.lit("UNKNOWN_CONST")),
    )


def recode(value: Column, mapping: Mapping[str, str]) -> Column:
    """Dictionary replacement; values outside the dictionary pass through."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), value)


def in_years(year: Column, years: Iterable[int]) -> Column:
    return holds(year.isin([int(y) for y in years]))


def grouped(value: Column, places: int) -> Column:
    """Number text with thousands separators."""
    return F.format_number(value, places)


def fixed(value: Column, places: int) -> Column:
    """Number text without separators, half-even on the binary value."""
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def signed(value: Column, places: int) -> Column:
    return F.concat(F.when(value >= 0, "+").otherwise(""), fixed(value, places))


def headline(text: Column, width: int = 100) -> Column:
    """Second line of a text, or its first ``width`` characters when it has one line."""
    lines = F.split(text, "\n")
    return F.when(F.size(lines) > 1, F.element_at(lines, 2)).otherwise(F.substring(text, 1, width))
