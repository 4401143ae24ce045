"""Path patterns compiled on the driver into one regular expression per rule set, and the
column expressions that apply them inside the scan."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default names left out of every scan, and patterns that are never read.
DEFAULT_EXCLUDE = [
    "node_modules", ".venv", ".git", "__pycache__", ".pytest_cache", ".mypy_cache", "dist", "build",
    ".tox", ".eggs", ".opencode", ".claude", ".obsidian", "graphify-out", "target", "vendor",
]
DEFAULT_DENY = [".env", ".env.*", "*.pem", "*.key", "id_*", "*credentials*", "*secret*"]


def braces(pattern: str) -> list[str]:
    """All patterns that the alternatives in braces stand for."""
    todo, done = [pattern], []
    while todo:
        p = todo.pop(0)
        m = re.search(r"\{([^{}]*)\}", p)
        if m is None:
            done.append(p)
        else:
            todo[:0] = [p[: m.start()] + option + p[m.end() :] for option in m[1].split(",")]
    return done


def glob_regex(pattern: str) -> str:
    """``**/`` is any number of folders, ``**`` anything, ``*`` and ``?`` stay in one name."""
    kinds = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(kinds.get(t) or re.escape(t) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern))


def name_regex(pattern: str) -> str:
    """Shell patterns on plain names: ``*`` also crosses folders; classes in brackets work."""
    out, i = [], 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "".join(out)


def any_of(regexes: list[str]) -> str:
    return "^(?:" + "|".join(regexes) + ")$" if regexes else "(?!)"


def matches_glob(path: Column, globs: list[str]) -> Column:
    return path.rlike("(?s)" + any_of([glob_regex(p) for g in globs for p in braces(g)]))


def denied(path: Column, deny: list[str]) -> Column:
    """Whether the whole path or its last name fits a pattern, in either case."""
    rule, low = "(?s)" + any_of([name_regex(p.lower()) for p in deny]), F.lower(path)
    return low.rlike(rule) | F.substring_index(low, "/", -1).rlike(rule)


def has_part(path: Column, names: list[str]) -> Column:
    """Whether any folder or file name of the path is one of the names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names))) if names else F.lit(False)


def suffix(path: Column) -> Column:
    """The lower-cased extension of the file's name, with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))


def path_labels(path: Column, templates: list[str]) -> Column:
    """Labels of the first template that fits, as an array of (key, value) in template order.

    A template has one segment for each of the path's: a name, ``*`` or ``{label}``."""
    clean = F.regexp_replace(path, "^/+|/+$", "")
    empty = F.array().cast("array<struct<key:string,value:string>>")
    out = empty
    for t in reversed(templates):
        rule, names = [], []
        for token in t.strip("/").split("/"):
            if token.startswith("{") and token.endswith("}"):
                names.append(token[1:-1])
                rule.append("([^/]*)")
            else:
                rule.append("[^/]*" if token == "*" else re.escape(token))
        rule = "(?s)^" + "/".join(rule) + "$"
        last = {n: i for i, n in enumerate(names, 1)}
        pairs = [F.struct(F.lit(n).alias("key"), F.regexp_extract(clean, rule, last[n]).alias("value")) for n in dict.fromkeys(names)]
        found = F.array(*pairs) if pairs else empty
        out = F.when(clean.rlike(rule), found).otherwise(out)
    return out
