"""Markdown sections with line spans, breadcrumbs and stable ids.

A section starts at each heading of level 1 or 2 outside code fences. A section over the size
budget is cut at its highest deeper headings, then between paragraphs, then between lines, then
inside a line. Reading a text is one forward pass with a fence and a heading stack, which is
state a window cannot hold, so this runs as one Arrow map; ids and numbers are columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.functions.text import chunk_id, section_text
from gneiss.operators.arrow import explode_rows
from gneiss.operators.spans import Lines

SPLIT_LEVEL = 2
_ATX = re.compile(r"(#{1,6}) +(.*\S)\s*")
_FENCE = re.compile(r" {0,3}(?P<mark>(?P<c>[`~])(?P=c){2,})(?P<info>.*)")


def headings(lines: list[str]) -> list[tuple[int, int, tuple[str, ...]]]:
    """(line, level, breadcrumb with the heading's own text last) outside fences."""
    found, trail, fence = [], [], ""
    for n, line in enumerate(lines, 1):
        if m := _FENCE.fullmatch(line):
            mark = m["mark"]
            if not fence:
                fence = mark
            elif mark.startswith(fence) and not m["info"].strip():
                fence = ""
        elif not fence and (m := _ATX.fullmatch(line)):
            level = len(m[1])
            trail = [t for t in trail if t[0] < level] + [(level, m[2].strip())]
            found.append((n, level, tuple(t for _, t in trail)))
    return found


def _paragraphs(text: Lines, start: int, end: int) -> Iterator[tuple[int, int]]:
    first = None
    for n in range(start, end + 2):
        solid = n <= end and not text.blank[n]
        if solid and first is None:
            first = n
        elif not solid and first is not None:
            yield first, n - 1
            first = None


def _packed(text: Lines, start: int, end: int, most: int) -> Iterator[tuple[int, int, str | None]]:
    """Spans of at most ``most`` characters: whole paragraphs, else lines, else slices."""
    units: list[tuple[int, int, bool]] = []  # the flag: nothing may join what comes after it
    for a, b in _paragraphs(text, start, end):
        if text.size(a, b) <= most:
            units.append((a, b, False))
        else:
            units += [(a, a - 1, True), *[(n, n, False) for n in range(a, b + 1)], (b + 1, b, True)]
    held = None
    for a, b, stop in units:
        long = not stop and text.size(a, b) > most
        if held and (stop or long or text.size(held[0], b) > most):
            yield (*held, None)
            held = None
        if long:
            whole = text.lines[a - 1]
            yield from ((a, a, whole[i : i + most]) for i in range(0, len(whole), most))
        elif not stop:
            held = (held[0] if held else a, b)
    if held:
        yield (*held, None)


def sections(source: str, most: int = 0) -> list[tuple[int, int, tuple[str, ...], str | None]]:
    """(first line, last line, breadcrumb, text if it is part of a line) of the chunks."""
    text = Lines(source)
    heads = headings(text.lines)
    out = []

    def cut(start: int, end: int, level: int, crumb: tuple[str, ...]) -> None:
        first = start + (level > 0)
        if not any(not text.blank[n] for n in range(first, end + 1)):
            return
        start, end = text.trim(start, end)
        if most <= 0 or text.size(start, end) <= most:
            out.append((start, end, crumb, None))
            return
        inner = [h for h in heads if start < h[0] <= end and h[1] > level]
        if not inner:
            out.extend((a, b, crumb, t) for a, b, t in _packed(text, start, end, most))
            return
        top = min(h[1] for h in inner)
        marks = [h for h in inner if h[1] == top]
        edges = [h[0] for h in marks] + [end + 1]
        cut(start, edges[0] - 1, level, crumb)
        for (line, deeper, trail), stop in zip(marks, edges[1:], strict=True):
            cut(line, stop - 1, deeper, trail)

    starts = [h for h in heads if h[1] <= SPLIT_LEVEL]
    if not starts or starts[0][0] > 1:
        starts.insert(0, (1, 0, ()))
    for (line, level, crumb), after in zip(starts, [*starts[1:], None], strict=True):
        cut(line, after[0] - 1 if after else len(text.lines), level, crumb)
    return out


def chunk_markdown(df: DataFrame, keep: list[str], text_col: str = "text", max_chars: int = 0, path_col: str | None = "file_path", repo_col: str = "repo_name", source_col: str = "source") -> DataFrame:
    """Columns ``keep`` with ord, heading, breadcrumb, start_line, end_line, text, id, embed_text.

    Ids depend on repository, path, breadcrumb and the section's turn among those with the same
    breadcrumb; without a path, on source, heading and place. Blank texts give no rows."""
    fields = [
        T.StructField("ord", T.IntegerType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
        T.StructField("breadcrumb", T.ArrayType(T.StringType())), T.StructField("turn", T.IntegerType()), T.StructField("chunk_text", T.StringType()),
    ]

    def one(source):
        lines, turns, rows = Lines(source), {}, []
        for n, (a, b, crumb, part) in enumerate(sections(source, max_chars)):
            turns[crumb] = turns.get(crumb, -1) + 1
            rows.append((n, a, b, list(crumb), turns[crumb], lines.text(a, b) if part is None else part))
        return rows

    out = explode_rows(df, text_col, keep, fields, one)
    out = out.withColumn("heading", F.when(F.size("breadcrumb") > 0, F.element_at("breadcrumb", -1)).otherwise(""))
    if path_col:
        made = chunk_id(F.col(repo_col), F.col(path_col), F.array_join("breadcrumb", " > "), F.col("turn").cast("string"))
        embed = section_text(F.col("breadcrumb"), F.col("chunk_text"))
    else:
        made, embed = chunk_id(F.col(source_col), F.col("heading"), F.col("ord").cast("string")), F.col("chunk_text")
    return out.withColumn("id", made).withColumn("embed_text", embed)
