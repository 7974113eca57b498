"""Numbers for readers, as column expressions; and tables, badges and bars for a terminal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The colours of severities, by their terminal codes.
COLOURS = {"critical": 31, "error": 31, "warning": 33, "info": 36, "ok": 32}


def _tenths(value: Column) -> Column:
    return F.replace(F.format_number(value, 1), F.lit(","), F.lit(""))


def humanize_ms(ms: Column) -> Column:
    """850ms, 1.5s, 2m5s."""
    seconds = F.floor(ms / 1000).cast("long")
    return (
        F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(_tenths(ms / 1000), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"), (seconds % 60).cast("string"), F.lit("s")))
    )


def humanize_bytes(size: Column) -> Column:
    """512B, 1.5KB, 3.0MB, 2.2GB, by powers of 1024."""
    out = F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit("B")))
    for power, unit in ((1, "KB"), (2, "MB")):
        out = out.when(size < 1024 ** (power + 1), F.concat(_tenths(size / 1024**power), F.lit(unit)))
    return out.otherwise(F.concat(_tenths(size / 1024**3), F.lit("GB")))


def humanize_age(at: Column, now: Column) -> Column:
    """5s ago, 3m ago, 7h ago, 12d ago; null for what is yet to come."""
    seconds = (F.unix_timestamp(now) - F.unix_timestamp(at)).cast("long")
    out = F.when(seconds < 0, F.lit(None).cast("string"))
    for below, size, unit in ((60, 1, "s"), (3600, 60, "m"), (86_400, 3600, "h")):
        out = out.when(seconds < below, F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{unit} ago")))
    return out.otherwise(F.concat(F.floor(seconds / 86_400).cast("string"), F.lit("d ago")))


def bar(value: Column, most: Column, width: int = 20) -> Column:
    """A bar of so many characters, filled by the share of value in most."""
    filled = F.least(F.lit(width), F.greatest(F.lit(0), F.round(F.when(most > 0, value / most * width).otherwise(0)))).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), width - filled))


def badge(label: str, severity: str, colour: bool = True) -> str:
    return f"\x1b[{COLOURS[severity]}m[{label}]\x1b[0m" if colour else f"[{label}]"


def terminal_table(df: DataFrame, most: int = 20) -> str:
    """The first rows as aligned columns, numbers to the right."""
    rows = [["" if v is None else str(v) for v in r] for r in df.limit(most).collect()]
    right = [t in ("int", "bigint", "double", "float") for _, t in df.dtypes]
    widths = [max(map(len, column)) for column in zip(df.columns, *rows, strict=True)]
    line = lambda cells: "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, widths, right, strict=True)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in widths]), *map(line, rows)])
