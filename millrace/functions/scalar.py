"""Scalar functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"": 0, "K": 1, "M": 2, "G": 3, "T": 4}


def split_id(stage: str, parents: Column, sequence: Column) -> Column:
    """A stage's split id from its parents, in any order, and a number: the same content gives the same id."""
    content = F.concat(F.array_join(F.array_sort(parents), ","), F.lit("|"), sequence.cast("string"))
    return F.concat(F.lit(f"{stage}:"), F.substring(F.sha2(content, 256), 1, 12))


def short_md5(text: Column, length: int = 16) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, length)


def memory_bytes(text: Column) -> Column:
    """Bytes of a size such as ``10``, ``10K``, ``1.5 gb``; null if it is none."""
    form = "(?i)^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*([KMGT]?)B?\\s*$"
    n, unit = F.regexp_extract(text, form, 1), F.upper(F.regexp_extract(text, form, 2))
    scale = F.lit(1.0)
    for name, power in _UNITS.items():
        scale = F.when(unit == name, F.lit(float(1024**power))).otherwise(scale)
    return F.when(n != "", F.floor(n.cast("double") * scale)).cast("long")


def parse_memory(text: str) -> int:
    """:func:`memory_bytes` for a driver-side value; refuses what is none."""
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)B?\s*", text, re.IGNORECASE)
    if not m:
        raise ValueError(f"{text!r} is no size")
    return int(float(m[1]) * 1024 ** _UNITS[m[2].upper()])


def fraction(text: Column) -> Column:
    """``30000/1001`` as a number; null over zero or if it is none."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, F.try_divide(parts[0].try_cast("double"), parts[1].try_cast("double"))).otherwise(text.try_cast("double"))


def is_identifier(text: Column) -> Column:
    return text.rlike("^[a-zA-Z_][a-zA-Z0-9_]*\\z")


def contains_ignoring_case(text: Column, part: str | None) -> Column:
    """Whether a text holds a part; an empty or absent part passes."""
    return F.lit(True) if not part else F.lower(text).contains(part.lower())


def _one_digit(x: Column) -> Column:
    """A number with one decimal; what lies midway goes to the even digit."""
    return F.format_string("%.1f", F.bround(x.cast("double"), 1))


def human_duration(seconds: Column) -> Column:
    """``250ms``, ``12.5s``, ``3m 20s``, ``2h 5m``; milliseconds are rounded, to even where they lie midway."""
    whole = F.floor(seconds)
    return (
        F.when(seconds < 1, F.concat(F.bround(seconds * 1000).cast("long").cast("string"), F.lit("ms")))
        .when(seconds < 60, F.concat(_one_digit(seconds), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(whole / 3600).cast("string"), F.lit("h "), F.floor((whole % 3600) / 60).cast("string"), F.lit("m")))
    )


def _scaled(x: Column, step: float, names: list[str], plain: Column) -> Column:
    out = F.concat(_one_digit(x / step ** len(names)), F.lit(names[-1]))
    for i in range(len(names) - 1, 0, -1):
        out = F.when(x < step ** (i + 1), F.concat(_one_digit(x / step**i), F.lit(names[i - 1]))).otherwise(out)
    return F.when(x < step, plain).otherwise(out)


def human_bytes(n: Column) -> Column:
    """``10.0B``, ``2.0KB``, up to ``PB``; null is null."""
    n = n.cast("double")
    return F.when(n.isNotNull(), _scaled(n, 1024.0, ["KB", "MB", "GB", "TB", "PB"], F.concat(_one_digit(n), F.lit("B"))))


def human_number(n: Column) -> Column:
    """``999``, ``1.5K``, ``2.5M``, ``1.0B``; null is ``0``."""
    return F.when(n.isNull(), "0").otherwise(_scaled(n.cast("double"), 1000.0, ["K", "M", "B"], n.cast("string")))


def human_time(seconds: Column) -> Column:
    """Epoch seconds as ``2026-01-06 12:53:23`` in the session's time zone; ``Unknown`` for null and what is no time."""
    usable = seconds.isNotNull() & ~F.isnan(seconds.cast("double")) & (F.abs(seconds.cast("double")) < 2.0e11)
    at = F.timestamp_seconds(F.floor(F.when(usable, seconds.cast("double"))))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("Unknown"))


def iso_time(text: Column) -> Column:
    """An ISO-8601 time, ``Z`` for UTC, as a timestamp; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def url_name(url: Column) -> Column:
    """The last part of a URL's path."""
    return F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "([^/]*)$", 1)


def is_remote(path: Column) -> Column:
    return path.rlike("^(s3a?|gs|https?|az|abfss?)://")


#: A type of error, words of its message in small letters, and what is said of it; the first that holds.
CAUSES = [
    ("OutOfMemoryError", ["memory"], "Memory exhaustion. Consider increasing worker memory or reducing batch size."),
    ("TimeoutError", ["timeout"], "Operation timeout. Check for slow data sources or network issues."),
    (None, ["connection", "network"], "Network connectivity issue. Check queue backend and network configuration."),
    (None, ["permission", "access denied"], "Permission issue. Check file system or S3 bucket permissions."),
]
NO_CAUSE = "No specific root cause identified. Check full stacktrace for details."


def likely_cause(kind: Column, message: Column) -> Column:
    """What is said of an error, by its type and words of its message; null counts as empty."""
    text, out = F.lower(F.coalesce(message, F.lit(""))), F.lit(NO_CAUSE)
    for name, words, said in reversed(CAUSES):
        holds = F.lit(False) if name is None else F.coalesce(kind == name, F.lit(False))
        for w in words:
            holds = holds | text.contains(w)
        out = F.when(holds, F.lit(said)).otherwise(out)
    return out


def matches(column: Column, op: str, value) -> Column:
    """A predicate by name."""
    ops = {"equals": lambda: column == value, "not_equals": lambda: column != value, "greater_than": lambda: column > value, "less_than": lambda: column < value, "contains": lambda: column.cast("string").contains(str(value))}
    if op not in ops:
        raise ValueError(f"operation is one of {', '.join(ops)}")
    return ops[op]()
