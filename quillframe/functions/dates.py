"""Date text: lenient parsing and strftime patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date layouts accepted when no format is given, tried in this order.
LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss",
           "yyyy/MM/dd", "M/d/yyyy HH:mm:ss", "M/d/yyyy", "d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy",
           "MMMM d, yyyy", "dd.MM.yyyy", "yyyyMMdd")

# Strftime codes and their Spark pattern letters.
STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
            "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%p": "a", "%%": "%"}


def java_pattern(fmt: str) -> str:
    """Spark pattern of a strftime format; text without codes is taken as a Spark pattern."""
    if "%" not in fmt:
        return fmt
    out, i, literal = "", 0, ""
    while i < len(fmt):
        if fmt[i] == "%":
            code = fmt[i:i + 2]
            if code not in STRFTIME:
                raise ValueError(f"date code {code!r} is not supported")
            out += (f"'{literal}'" if literal else "") + STRFTIME[code]
            literal, i = "", i + 2
        elif fmt[i].isalpha():
            literal, i = literal + fmt[i], i + 1
        else:
            out += (f"'{literal}'" if literal else "") + fmt[i]
            literal, i = "", i + 1
    return out + (f"'{literal}'" if literal else "")


def shape(layout: str) -> str:
    """Rough regular expression of a layout: text that cannot match is never handed to the (slow) parser."""
    rules = {"yyyy": r"\d{4}", "MMMM": r"\p{L}+", "MMM": r"\p{L}+", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}",
             "ss": r"\d{2}", "M": r"\d{1,2}", "d": r"\d{1,2}", "'T'": "T"}
    return "^" + re.sub(r"'T'|([A-Za-z])\1*|[.]", lambda m: rules.get(m[0], r"\."), layout) + "$"


def parse(c: Column, fmt: str | None = None) -> Column:
    """Timestamp of a text column; unreadable text gives null."""
    if fmt is not None:
        return F.try_to_timestamp(c, F.lit(java_pattern(fmt)))
    t = F.trim(c)
    return F.coalesce(*[F.when(t.rlike(shape(p)), F.try_to_timestamp(t, F.lit(p))) for p in LAYOUTS])
