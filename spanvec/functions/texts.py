"""Text expressions: snippets, white space, titles, escapes, names, vector literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET = 240


def stringify(c: Column) -> Column:
    """As text; null reads None."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def snippet(c: Column, n: int = SNIPPET) -> Column:
    return F.substring(c, 1, n)


def one_line(c: Column, n: int = SNIPPET) -> Column:
    """The snippet with runs of white space as single spaces."""
    return F.regexp_replace(snippet(c, n), r"\s+", " ")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def title(title: Column, text: Column, key: Column) -> Column:
    """The first of title and text that isn't empty, else the id in words."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(text, F.lit("")), F.concat(F.lit("(id="), key.cast("string"), F.lit(")")))


def shard_name(prefix: str, index: Column) -> Column:
    return F.concat(F.lit(f"{prefix}.shard"), F.lpad(index.cast("string"), 3, "0"))


def delta_name(seq: Column) -> Column:
    return F.concat(F.lpad(seq.cast("string"), 4, "0"), F.lit(".delta"))


def parse_vector(c: Column) -> Column:
    """Numbers between commas or white space; anything else is an error."""
    return F.transform(F.filter(F.split(F.trim(c), r"[\s,]+"), lambda x: x != ""), lambda x: x.cast("double"))
