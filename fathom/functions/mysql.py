"""MySQL-style scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# MySQL date format letters and their Spark patterns.
DATE_LETTERS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "i": "mm", "s": "ss", "M": "MMMM", "b": "MMM", "a": "EEE", "W": "EEEE", "j": "DDD", "p": "a", "h": "hh", "T": "HH:mm:ss", "e": "d", "c": "M", "k": "H"}


def mysql_concat(*cols: str | Column) -> Column:
    """concat() that takes null as empty; Spark's own stays as it is."""
    return F.concat_ws("", *cols)


def length(col: str | Column) -> Column:
    """Bytes, as LENGTH has it."""
    return F.octet_length(col)


def char_length(col: str | Column) -> Column:
    return F.char_length(col)


def safe_div(a: Column, b: Column) -> Column:
    """x / 0 is null."""
    return F.try_divide(a, b)


def date_format(col: str | Column, fmt: str) -> Column:
    """DATE_FORMAT with % letters; other characters stand for themselves."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in DATE_LETTERS and fmt[i + 1] != "%":
                raise ValueError(f"unsupported date letter %{fmt[i + 1]}")
            out.append(DATE_LETTERS.get(fmt[i + 1], "'%'"))
            i += 2
        else:
            out.append(fmt[i] if not fmt[i].isalpha() and fmt[i] != "'" else "''" if fmt[i] == "'" else f"'{fmt[i]}'")
            i += 1
    return F.date_format(col, "".join(out))


def json_value(col: str | Column, path: str, as_type: str = "string") -> Column:
    """JSON_EXTRACT / JSON_VALUE of one path; try_cast, so what is not of the type is null."""
    return F.get_json_object(col, path).try_cast(as_type)


def json_contains(col: str | Column, path: str, value: str) -> Column:
    return F.coalesce(F.get_json_object(col, path) == value, F.lit(False))
