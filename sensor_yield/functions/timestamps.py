"""Timestamp parsing with whole-column format choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensor_yield import config


def _try_parse(c: Column, fmt: str | None) -> Column:
    parsed = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return parsed.cast("timestamp_ntz")


#: A date of three parts, then perhaps a time of day: part, separator, part, separator, part, rest.
LAYOUT = r"^([0-9]{1,4}|[A-Za-z]{3,9})([-/. ])([0-9]{1,2}|[A-Za-z]{3,9})([-/., ]{1,2})([0-9]{2}|[0-9]{4})((?:[T ].*)?)$"
CLOCK = r"^([T ])([0-9]{1,2}):([0-9]{2})(:[0-9]{2})?(\.[0-9]{1,9})?( ?[AaPp][Mm])?$"


def _kind(part: Column) -> Column:
    """What a date part may be: a word, a year of four digits, or a small number."""
    return (F.when(part.rlike("^[A-Za-z]{3}$"), "MMM").when(part.rlike("^[A-Za-z]"), "MMMM")
            .when(F.length(part) == 4, "yyyy").otherwise("n"))


def inferred_format(df: DataFrame, text: Column) -> str | None:
    """The one format of a column of times, learned from a histogram of its values' layouts.

    Values of one layout (kinds of the three date parts, separators, parts of the clock) are counted with the
    greatest number in each part, in one aggregate; there are a few hundred layouts at most. The most frequent
    layout gives the format. Where day and month are both numbers, a part beyond 12 is the day; if neither
    goes beyond, the month comes first."""
    part = [F.regexp_extract(text, LAYOUT, i) for i in range(1, 7)]
    clock = [F.regexp_extract(part[5], CLOCK, i) for i in range(1, 7)]
    rows = df.where(text.rlike(LAYOUT)).select(
        F.array(*[_kind(part[i]) for i in (0, 2, 4)]).alias("kinds"), part[1].alias("s1"), part[3].alias("s2"), part[5].alias("rest"),
        F.array(clock[0], F.lit(":"), F.when(clock[3] != "", ":ss").otherwise(""), F.length(clock[4]).cast("string"),
                F.regexp_replace(clock[5], "[AaPp][Mm]", "a")).alias("clock"),
        *[part[i].try_cast("int").alias(f"v{i}") for i in (0, 2)])
    known = rows.where((F.col("rest") == "") | F.col("rest").rlike(CLOCK))
    layout = F.struct("kinds", "s1", "s2", (F.col("rest") != "").alias("timed"), "clock")
    best = (known.groupBy(layout.alias("l")).agg(F.count(F.lit(1)).alias("n"), F.max("v0").alias("m0"), F.max("v2").alias("m1"))
            .orderBy(F.desc("n"), F.col("l").cast("string")).first())
    if best is None:
        return None
    kinds, year = list(best.l.kinds), "yyyy"
    if kinds[0] == "n" and kinds[2] in ("n", "yyyy") and kinds[1] == "n":
        kinds[:2] = ["d", "M"] if (best.m0 or 0) > 12 else ["M", "d"]
        year = "yyyy" if kinds[2] == "yyyy" else "yy"
        kinds[2] = year
    elif kinds[0] == "yyyy" and kinds[1:] == ["n", "n"]:
        kinds[1:] = ["d", "M"] if (best.m1 or 0) > 12 else ["M", "d"]
    else:  # a month by name: the other small number is the day
        kinds = ["d" if k == "n" and "yyyy" in kinds else "yy" if k == "n" else k for k in kinds]
    if sorted(k[0] for k in kinds) != ["M", "d", "y"]:
        return None
    fmt = f"{kinds[0]}{best.l.s1}{kinds[1]}{best.l.s2}{kinds[2]}"
    if best.l.timed:
        gap, _, seconds, fraction, half = best.l.clock
        fmt += ("'T'" if gap == "T" else gap) + ("h" if half else "H") + ":mm" + seconds
        fmt += ("." + "S" * (int(fraction) - 1) if int(fraction) else "") + half
    return fmt


def parse_time_column(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """Parse ``col`` to TIMESTAMP_NTZ.

    Each known format is scored by its parsed share over the whole column in ONE
    aggregate job (all formats at once); the first format whose share is strictly
    above 0.9 wins for every row. Otherwise one further format is learned from the
    column (``inferred_format``) and used for every row, values that do not fit it by
    the known formats; only where no layout is recognised is each value parsed on its
    own (any known format, else Spark's default parser). Unparseable values become
    NULL, never an error.
    """
    out_col = out_col or col
    raw = F.trim(F.col(col).cast("string"))
    shares = df.agg(*[
        F.avg(_try_parse(raw, fmt).isNotNull().cast("double")).alias(f"s{i}")
        for i, fmt in enumerate(config.TIME_FORMATS)
    ]).first()
    chosen = None
    for i, fmt in enumerate(config.TIME_FORMATS):
        share = shares[f"s{i}"] if shares is not None else None
        if share is not None and share > config.TIME_FORMAT_WIN_SHARE:
            chosen = fmt
            break
    if chosen is not None:
        return df.withColumn(out_col, _try_parse(raw, chosen))
    learned = inferred_format(df, raw)
    if learned is not None:
        return df.withColumn(out_col, F.coalesce(*[_try_parse(raw, f) for f in (learned, *config.TIME_FORMATS)]))
    return df.withColumn(out_col, F.coalesce(*[_try_parse(raw, f) for f in config.TIME_FORMATS],
                                             _try_parse(raw, None)))


def year_month(ts: Column) -> Column:
    """``YYYY-MM`` month bucket."""
    return F.date_format(ts, "yyyy-MM")


def days_between_cols(start_col: str, end_col: str) -> Column:
    """Elapsed whole days between two timestamp columns (floor of elapsed time),
    not the calendar-day difference (F03). ``timestampdiff``'s unit is a keyword,
    hence the SQL expression."""
    return F.expr(f"timestampdiff(DAY, `{start_col}`, `{end_col}`)")
