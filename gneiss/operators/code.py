"""Code chunks: symbols of Python, Go, JavaScript and Rust, keys of YAML, else line windows.

Python is read with the standard parser; the other languages by the scanners in
:mod:`gneiss.operators.scanner`. Finding spans needs a stack per text, so it runs as one Arrow
map; ids and embedding texts are column expressions on top of it."""

from __future__ import annotations

import ast
import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.functions import paths
from gneiss.functions.text import chunk_id, code_text
from gneiss.operators.arrow import explode_rows
from gneiss.operators.scanner import symbol_spans
from gneiss.operators.spans import MIN_MODULE_CHARS, Lines, Span

MAX_CHARS = 4000
WINDOW, OVERLAP = 60, 10
YAML_PACK, YAML_DEPTH = 800, 4


# ---------------------------------------------------------------- Python


def python_spans(source: str) -> list[Span]:
    """Functions, classes and methods of a module, and what they leave; raises on bad syntax."""
    text = Lines(source)

    def top(node) -> int:
        return min((d.lineno for d in getattr(node, "decorator_list", ())), default=node.lineno)

    def walk(body, owner: str):
        for node in body:
            name = getattr(node, "name", "")
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                yield Span(min(top(node), node.lineno), node.end_lineno, node.lineno, owner + name, "method" if owner else "function")
            elif isinstance(node, ast.ClassDef):
                yield from whole_class(node, owner + name)
            elif isinstance(node, ast.If | ast.Try | ast.With | ast.AsyncWith | ast.For | ast.AsyncFor | ast.While):
                for part in ("body", "orelse", "finalbody"):
                    yield from walk(getattr(node, part, ()), owner)
                for handler in getattr(node, "handlers", ()):
                    yield from walk(handler.body, owner)

    def whole_class(node, name: str):
        yield from container(text, min(top(node), node.lineno), node.end_lineno, node.lineno, name, name, list(walk(node.body, name + ".")))

    symbols = list(walk(ast.parse(source).body, ""))
    return sorted(symbols + text.modules(symbols), key=lambda s: (s.start, s.end))


def container(text: Lines, start: int, end: int, def_line: int, name: str, shown: str, members: list[Span], closers=None) -> list[Span]:
    """A class-like symbol: its header, its members, and what they leave."""
    if not members:
        return [Span(start, end, def_line, shown, "class")]
    first = min(m.start for m in members)
    head = [Span(start, first - 1, def_line, shown, "class")] if start < first else []
    rest = [Span(a, b, None, f"{name}.<resto>", "class_rest") for a, b in text.gaps(start, end, head + members)]
    return head + members + [r for r in rest if not (closers and closers.fullmatch(text.text(r.start, r.end)))]


# ---------------------------------------------------------------- YAML

#: Characters that cannot begin a plain key: YAML's indicators, and the dash of a list item.
_NOT_A_KEY = frozenset("#-[]{}&*!|>'\"%@`")


def yaml_key(line: str) -> tuple[int, str] | None:
    """Indent and name of a block mapping's key on a line, plain or quoted; else None."""
    bare = line.lstrip(" ")
    if not bare or bare[0].isspace():
        return None
    quote = bare[0] if bare[0] in "\"'" else ""
    if not quote and bare[0] in _NOT_A_KEY:
        return None
    end = bare.find(quote, 1) + 1 if quote else bare.find(":", 1)
    if end <= 0 or bare[end : end + 1] != ":" or (bare[end + 1 : end + 2] or " ").strip():
        return None
    return len(line) - len(bare), (bare[1 : end - 1] if quote else bare[:end]).strip().strip("\"'")


class _Yaml:
    """Mapping entries of a text, found range by range, and the chunks made of them."""

    def __init__(self, source: str, most: int):
        self.text, self.most, self.limit = Lines(source), most, min(YAML_PACK, most)
        self.keys: dict[int, tuple[int, str]] = {}
        self.breaks: set[int] = set()  # lines that begin another document
        self.notes: dict[int, int] = {}  # indents of comment lines
        self.out: list[Span] = []
        self.waiting: list[Span] = []  # small entries, to go into one chunk
        for n, line in enumerate(self.text.lines, 1):
            if line.startswith("---"):
                self.breaks.add(n)
            elif key := yaml_key(line):
                self.keys[n] = key
            if line.lstrip().startswith("#"):
                self.notes[n] = len(line) - len(line.lstrip(" "))

    def entries(self, lo: int, hi: int, indent: int):
        """(first line, key line, last line, name) of the keys at an indent. Comments at that
        indent right above a key are its own; blank lines at the end are nobody's."""
        edge, found = lo, []
        for n in range(lo, hi + 2):
            name = self.keys[n][1] if n in self.keys and self.keys[n][0] == indent else ""
            if n <= hi and n not in self.breaks and not name:
                continue
            top = n
            while name and top > edge and self.notes.get(top - 1) == indent:
                top -= 1
            if found:
                first, key, title = found.pop()
                last = top - 1
                while last > key and self.text.blank[last]:
                    last -= 1
                yield first, key, last, title
            if name:
                found.append((top, n, name))
            edge = n + 1

    def inner(self, key: int, last: int) -> int | None:
        """The indent of the mapping under a key, if that is what stands there."""
        body = next((n for n in range(key + 1, last + 1) if not self.text.blank[n] and n not in self.notes), None)
        found = yaml_key(self.text.lines[body - 1]) if body else None
        return found[0] if found and found[0] > self.keys[key][0] else None

    def flush(self) -> None:
        if self.waiting:
            a, z = self.waiting[0], self.waiting[-1]
            name = a.symbol if a is z else f"{a.symbol}..{z.symbol.rsplit('.', 1)[-1]}"
            self.out.append(Span(a.start, z.end, a.def_line, name, "yaml_key"))
            self.waiting = []

    def put(self, span: Span) -> None:
        """Adds a small entry to those that wait, unless it would be too much or another document."""
        if self.waiting:
            parted = any(self.waiting[-1].end < n < span.start for n in self.breaks)
            if parted or self.text.size(self.waiting[0].start, span.end) > self.limit:
                self.flush()
        self.waiting.append(span)

    def walk(self, lo: int, hi: int, indent: int, owner: str = "", depth: int = 0) -> None:
        for first, key, last, name in self.entries(lo, hi, indent):
            size, span = self.text.size(first, last), Span(first, last, key, owner + name, "yaml_key")
            below = self.inner(key, last) if size > self.most and depth < YAML_DEPTH else None
            if size <= self.limit:
                self.put(span)
                continue
            self.flush()
            if below is None:
                self.out.append(span)
                continue
            # The head ends where the first child, its comments included, begins.
            head = next((a for a, *_ in self.entries(key + 1, last, below)), last + 1) - 1
            while head > first and self.text.blank[head]:
                head -= 1
            self.out.append(Span(first, head, key, owner + name, "yaml_key"))
            self.walk(key + 1, last, below, f"{owner}{name}.", depth + 1)
        self.flush()


def yaml_spans(source: str, most: int) -> list[Span] | None:
    """Spans of the keys, or None for templates and for texts without a key."""
    if "{{" in source:
        return None
    y = _Yaml(source, most)
    n = len(y.text.lines)
    y.walk(1, n, 0)
    if not y.out:
        return None
    rest = [Span(a, b, None, "<resto>", "yaml_key") for a, b in y.text.gaps(1, n, y.out) if y.text.size(a, b) >= MIN_MODULE_CHARS and a not in y.breaks]
    return sorted(y.out + rest, key=lambda s: (s.start, s.end))


# ---------------------------------------------------------------- all


def chunks(source: str, path: str, most: int = MAX_CHARS, window: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[Span, str, int]]:
    """(span, text, turn) of a file's chunks: the turn counts windows by place in the file,
    other chunks among those of the same symbol and kind. Blank files have none."""
    text = Lines(source)
    if all(text.blank):
        return []
    spans = None
    if path.endswith(".py"):
        try:
            spans = python_spans(source)
        except (SyntaxError, ValueError):
            pass
    elif path.endswith((".yaml", ".yml")):
        spans = yaml_spans(source, most)
    else:
        spans = symbol_spans(source, posixpath.splitext(path)[1].lower())
    if spans is None:
        spans = text.windows(window, overlap)
    out, turns = [], {}
    for piece in (p for s in spans for p in text.fit(s, most)):
        key = (piece.symbol, piece.kind)
        turns[key] = turns.get(key, -1) + 1
        body = text.text(piece.start, piece.end) if piece.part is None else piece.part
        out.append((piece, body, len(out) if piece.kind == "window" else turns[key]))
    return out


def chunk_code(
    df: DataFrame, keep: list[str], text_col: str = "text", path_col: str = "file_path", repo_col: str = "repo_name",
    max_chars: int = MAX_CHARS, window: int = WINDOW, overlap: int = OVERLAP, templates: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` with start_line, end_line, def_line, symbol_name, kind, chunk_text, id and
    embed_text. ``keep`` must have the path and the repository."""
    fields = [
        T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("def_line", T.IntegerType()),
        T.StructField("symbol_name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("chunk_text", T.StringType()), T.StructField("turn", T.IntegerType()),
    ]

    def one(source, path):
        return [(s.start, s.end, s.def_line, s.symbol, s.kind, body, turn) for s, body, turn in chunks(source, path, max_chars, window, overlap)]

    out = explode_rows(df, [text_col, path_col], keep, fields, one)
    repo, path, turn = F.col(repo_col), F.col(path_col), F.col("turn").cast("string")
    symbol = chunk_id(repo, path, F.col("symbol_name"), turn)
    made = F.when(F.col("kind") == "window", chunk_id(repo, path, "window", F.col("start_line").cast("string"), turn)).otherwise(symbol)
    labels = F.transform(paths.path_labels(path, templates or []), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    embed = code_text(labels, path, F.col("start_line"), F.col("end_line"), F.col("symbol_name"), F.col("chunk_text"))
    return out.withColumn("id", made).withColumn("embed_text", embed)
