"""Byte spans of source lines and ranges, for edits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SPAN = StructType([StructField("lo", LongType()), StructField("hi", LongType())])


def line_span(content: Column, first: Column, last: Column) -> Column:
    """(lo, hi) in bytes of lines first..last (from 1), line ends included; null where they don't exist or hold no byte."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.octet_length(x) + 1)
    before = lambda n: F.aggregate(F.slice(lines, 1, n), F.lit(0), lambda s, x: s + x)
    ok = (first >= 1) & (last >= first) & (last <= F.size(lines))
    lo = F.when(ok, before(first - 1))
    hi = F.when(ok, F.least(before(last), F.octet_length(content)))
    return F.when(hi > lo, F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi")))


@F.pandas_udf(SPAN)
def widened(content: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
    """A deleted range with the indent before it, its line end, and the blank lines that follow."""
    out = []
    for text, a, b in zip(content, lo, hi, strict=True):
        src, a, b = text.encode(), int(a), int(b)
        while a > 0 and src[a - 1] in b" \t":
            a -= 1
        end = b + 2 if src[b : b + 2] == b"\r\n" else b + 1 if src[b : b + 1] == b"\n" else b
        while end > b:  # whole blank lines, once a line end was passed
            i = end
            while i < len(src) and src[i] in b" \t\r":
                i += 1
            if i >= len(src) or src[i] != 10:
                break
            end = i + 1
        out.append((a, end))
    return pd.DataFrame(out, columns=["lo", "hi"])


def trimmed_end(content: Column) -> Column:
    """content with one line end behind its last word where blank lines stood there; unchanged without any word."""
    body = F.regexp_replace(content, "[\\n\\r \\t]+$", "")
    return F.when((F.length(body) > 0) & (F.length(body) + 1 < F.length(content)), F.concat(body, F.lit("\n"))).otherwise(content)
