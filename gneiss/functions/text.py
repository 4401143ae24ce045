"""Column expressions over text: lines, trimming, stable ids and embedding texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The line breaks that split a text, as str.splitlines has them.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
#: White space as str.strip has it.
SPACE = r"[\s\x1c-\x1f]"


def lines_of(text: Column) -> Column:
    """The lines of a text without their breaks; no line for an empty or null text."""
    parts = F.split(text, LINE_BREAK, -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.coalesce(whole, F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return text.rlike(f"(?U)^{SPACE}*$")


def joined(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, both included) as one text."""
    return F.array_join(F.slice(lines, start, end - start + 1), "\n")


def chunk_id(*parts: Column | str) -> Column:
    """16 hexadecimal digits that depend on the parts only."""
    return F.substring(F.sha2(F.concat_ws("::", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256), 1, 16)


def point_id(identifier: Column) -> Column:
    """The 63-bit number of a 16-digit id."""
    return (F.conv(identifier, 16, 10).cast("decimal(20,0)") % F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


def section_text(breadcrumb: Column, body: Column) -> Column:
    """What is embedded for a section: its breadcrumb as a heading, and the body."""
    return F.when(F.size(breadcrumb) > 0, F.concat(F.lit("# "), F.array_join(breadcrumb, " > "), F.lit("\n\n"), body)).otherwise(body)


def code_text(labels: Column, file_path: Column, start: Column, end: Column, symbol: Column, body: Column) -> Column:
    """What is embedded for code: labels (array of key=value, may be empty), place, symbol, body."""
    tags = F.when(F.size(labels) > 0, F.concat(F.lit("# "), F.array_join(labels, " "), F.lit("\n"))).otherwise("")
    name = F.when(symbol != "", F.concat(F.lit(" "), symbol)).otherwise("")
    return F.concat(tags, F.lit("# "), file_path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), name, F.lit("\n\n"), body)
