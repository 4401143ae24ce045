"""Line spans inside one text: sizes by prefix sums, trimming, gaps, and the size budget."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

MIN_MODULE_CHARS = 60


@dataclass(frozen=True)
class Span:
    """Lines start to end (from 1, both included); ``part`` is set for a piece of one line."""

    start: int
    end: int
    def_line: int | None
    symbol: str
    kind: str
    part: str | None = None


class Lines:
    """The lines of a text; ``blank`` is indexed by line number."""

    def __init__(self, source: str | list[str]):
        self.lines = source.splitlines() if isinstance(source, str) else source
        self.blank = [True, *[not x.strip() for x in self.lines]]
        self.ends = [0]
        for x in self.lines:
            self.ends.append(self.ends[-1] + len(x) + 1)

    def size(self, start: int, end: int) -> int:
        """Characters of the lines joined by newlines."""
        return max(0, self.ends[end] - self.ends[start - 1] - 1) if end >= start else 0

    def text(self, start: int, end: int) -> str:
        return "\n".join(self.lines[start - 1 : end])

    def trim(self, start: int, end: int) -> tuple[int, int]:
        """The span without blank lines at its edges; end < start if nothing is left."""
        solid = [n for n in range(start, end + 1) if not self.blank[n]]
        return (solid[0], solid[-1]) if solid else (start, start - 1)

    def gaps(self, start: int, end: int, covered: Iterable[Span]) -> list[tuple[int, int]]:
        """Trimmed spans between start and end that no covered span touches."""
        busy = [False] * (end + 2)
        for s in covered:
            for n in range(max(start, s.start), min(end, s.end) + 1):
                busy[n] = True
        out, first = [], None
        for n in range(start, end + 2):
            free = n <= end and not busy[n]
            if free and first is None:
                first = n
            elif not free and first is not None:
                a, b = self.trim(first, n - 1)
                if a <= b:
                    out.append((a, b))
                first = None
        return out

    def modules(self, covered: Iterable[Span]) -> list[Span]:
        """What symbols leave of a file, unless it is tiny."""
        return [
            Span(a, b, None, "<module>", "module")
            for a, b in self.gaps(1, len(self.lines), covered)
            if len(self.text(a, b).strip()) >= MIN_MODULE_CHARS
        ]

    def windows(self, size: int, overlap: int) -> list[Span]:
        n, step = len(self.lines), max(size - overlap, 1)
        starts = [s for s in range(1, n + 1, step) if s == 1 or s - step + size - 1 < n]
        spans = [Span(s, min(s + size - 1, n), None, "", "window") for s in starts]
        return [s for s in spans if not all(self.blank[s.start : s.end + 1])]

    def fit(self, span: Span, most: int) -> list[Span]:
        """The span cut to pieces of at most ``most`` characters, each line counted with its
        break; a longer line becomes slices. Only the first piece keeps the definition line."""
        if most <= 0 or self.size(span.start, span.end) <= most:
            return [span]
        groups: list[list] = []  # [first, last, characters]
        for n in range(span.start, span.end + 1):
            width = len(self.lines[n - 1])
            if width > most:
                groups.append([n, n, -1])
            elif groups and groups[-1][2] >= 0 and (not groups[-1][2] or groups[-1][2] + width + 1 <= most):
                groups[-1][1:] = [n, groups[-1][2] + width + 1]
            else:
                groups.append([n, n, width + 1])
        pieces = []
        for a, b, size in groups:
            if size < 0:
                line = self.lines[a - 1]
                pieces += [replace(span, start=a, end=a, def_line=None, part=line[i : i + most]) for i in range(0, len(line), most)]
            else:
                pieces.append(replace(span, start=a, end=b, def_line=None))
        return [replace(pieces[0], def_line=span.def_line), *pieces[1:]] if pieces else []
