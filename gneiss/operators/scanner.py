"""Declarations of Go, JavaScript and Rust files by a bracket-aware token scan.

A file becomes a flat list of tokens (comments, strings and regular expressions are single
tokens), brackets are paired, and declarations are recognised at the start of statements of
one bracket level. Bodies are jumped over by their closing bracket, so the scan never needs a
grammar. A file that shows no declaration and whose brackets do not pair is given up (None),
and so is one with unusual line separators."""

from __future__ import annotations

import re
from dataclasses import dataclass

from gneiss.operators.spans import Lines, Span

LANGUAGES = {".go": "go", ".js": "js", ".mjs": "js", ".cjs": "js", ".jsx": "js", ".rs": "rust"}
_CLOSERS = re.compile(r"[\s})\];,]*")
_ODD = re.compile("[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
_STRING = r'"(?:[^"\\]|\\.)*"'
_TOKENS = {
    "go": re.compile(
        rf"(?P<note>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>{_STRING}|`[^`]*`|'(?:[^'\\\n]|\\.)+')|(?P<word>[^\W\d]\w*)|(?P<num>\d[\w.]*)|(?P<sign>:=|<-|\.\.\.|[^\s\w])", re.DOTALL
    ),
    "js": re.compile(
        rf"(?P<note>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>{_STRING}|'(?:[^'\\]|\\.)*')|(?P<word>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)|(?P<num>\d[\w.]*)|(?P<sign>=>|\?\.|\.\.\.|[^\s\w])", re.DOTALL
    ),
    "rust": re.compile(
        rf"(?P<note>//[^\n]*)|(?P<text>b?r(?P<h>#*)\".*?\"(?P=h)|b?{_STRING}|b?'(?:[^'\\]|\\(?:x..|u\{{[^}}]*\}}|.))')|(?P<life>'[^\W\d]\w*)|(?P<word>(?:r#)?[^\W\d]\w*)|(?P<num>\d[\w.]*)|(?P<sign>->|=>|::|[^\s\w])",
        re.DOTALL,
    ),
}
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_REGEX_BEFORE = frozenset("return typeof case in of delete void throw new else do".split())
_JS_GOES_ON = frozenset(". ?. , = + - * / % & | ^ < > ? : => && || ( [ `".split())


@dataclass
class Token:
    kind: str
    text: str
    line: int
    last: int
    first: bool  # nothing but white space stands before it on its line
    mate: int = -1  # for a bracket: the index of its partner


class Scan:
    def __init__(self, source: str, language: str):
        self.language, self.source = language, source
        self.tokens: list[Token] = []
        self.notes: list[Token] = []
        self.broken = False
        self._read()
        self._pair()

    def _read(self) -> None:
        source, pattern, at, line, begin = self.source, _TOKENS[self.language], 0, 1, 0
        n = len(source)
        while at < n:
            c = source[at]
            if c.isspace():
                if c == "\n":
                    line, begin = line + 1, at + 1
                at += 1
                continue
            end, kind = self._special(at)
            if end is None:
                m = pattern.match(source, at)
                if m is None:
                    at += 1
                    self.broken = True
                    continue
                end, kind = m.end(), m.lastgroup if m.lastgroup != "h" else "text"
                if kind == "h":
                    kind = "text"
            text = source[at:end]
            breaks = text.count("\n")
            token = Token(kind, text, line, line + breaks, not source[begin:at].strip())
            (self.notes if kind == "note" else self.tokens).append(token)
            if breaks:
                line, begin = line + breaks, at + text.rindex("\n") + 1
            at = end

    def _special(self, at: int) -> tuple[int | None, str]:
        """Ends of tokens that a regular expression cannot find."""
        s, lang = self.source, self.language
        if lang == "rust" and s.startswith("/*", at):
            depth, i = 0, at
            while i < len(s):
                if s.startswith("/*", i):
                    depth, i = depth + 1, i + 2
                elif s.startswith("*/", i):
                    depth, i = depth - 1, i + 2
                    if not depth:
                        break
                else:
                    i += 1
            return i, "note"
        if lang == "js" and s[at] == "`":
            return self._template(at), "text"
        if lang == "js" and s[at] == "/" and s[at + 1 : at + 2] not in "/*" and self._regex_may_start():
            i, inside = at + 1, False
            while i < len(s) and s[i] != "\n":
                if s[i] == "\\":
                    i += 1
                elif s[i] == "[":
                    inside = True
                elif s[i] == "]":
                    inside = False
                elif s[i] == "/" and not inside:
                    i += 1
                    while i < len(s) and s[i].isalpha():
                        i += 1
                    return i, "text"
                i += 1
        return None, ""

    def _regex_may_start(self) -> bool:
        if not self.tokens:
            return True
        t = self.tokens[-1]
        return t.text in _REGEX_BEFORE if t.kind == "word" else t.kind == "sign" and t.text not in ")]}"

    def _template(self, at: int) -> int:
        s, i = self.source, at + 1
        while i < len(s):
            if s[i] == "\\":
                i += 2
            elif s[i] == "`":
                return i + 1
            elif s.startswith("${", i):
                depth, i = 1, i + 2
                while i < len(s) and depth:
                    if s[i] == "`":
                        i = self._template(i)
                        continue
                    if s[i] in "\"'":
                        q, i = s[i], i + 1
                        while i < len(s) and s[i] != q:
                            i += 2 if s[i] == "\\" else 1
                    depth += {"{": 1, "}": -1}.get(s[i] if i < len(s) else "", 0)
                    i += 1
            else:
                i += 1
        self.broken = True
        return len(s)

    def _pair(self) -> None:
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "sign":
                continue
            if t.text in _PAIRS:
                stack.append(i)
            elif t.text in ")]}":
                while stack and _PAIRS[self.tokens[stack[-1]].text] != t.text:
                    stack.pop()
                    self.broken = True
                if stack:
                    t.mate, self.tokens[stack[-1]].mate = stack[-1], i
                    stack.pop()
                else:
                    self.broken = True
        self.broken |= bool(stack)

    # -------------------------------------------------------- helpers

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def skip(self, i: int) -> int:
        """The token after i, or after the bracket pair that starts at i."""
        return max(i, self.tokens[i].mate) + 1

    def angle(self, i: int) -> int:
        """After a list in angle brackets that starts at i."""
        depth = 0
        while i < len(self.tokens):
            t = self.at(i)
            depth += {"<": 1, ">": -1}.get(t, 0)
            i = self.skip(i) if t in _PAIRS else i + 1
            if not depth:
                break
        return i

    def group(self, i: int, end: int, stops: str = ";") -> int | None:
        """The first block at this level from i on, unless the statement ends before it."""
        while i < end:
            t = self.at(i)
            if t == "{":
                return i
            if t in stops:
                return None
            i = self.skip(i)
        return None

    def extent(self, first: int, low: int, attributes: list[tuple[int, int]] = ()) -> int:
        """The first line of a declaration with the notes and attributes right above it."""
        start = self.tokens[first].line
        floor = self.tokens[low - 1].last if low else 0
        above = [(t.line, t.last, t.first) for t in self.notes if floor <= t.line and t.last <= start]
        above += [(self.tokens[a].line, self.tokens[b].last, self.tokens[a].first) for a, b in attributes]
        for line, last, leads in sorted(above, reverse=True):
            if last > start:
                continue
            if last < start - 1 or not leads:
                break
            start = min(start, line)
        return start


@dataclass
class Found:
    first: int  # token that the declaration starts at
    last: int  # its last token
    def_token: int
    name: str
    kind: str
    body: tuple[int, int] | None = None  # tokens of a container's members
    shown: str = ""
    full: bool = False
    attributes: list[tuple[int, int]] | tuple = ()
    low: int = 0


def _go(s: Scan, lo: int, hi: int, owner: str, full: bool):
    i = lo
    while i < hi:
        t, start = s.at(i), i
        fresh = i == lo or s.tokens[i].line > s.tokens[i - 1].last or s.at(i - 1) == ";"
        if fresh and t == "func" and (s.word(i + 1) or s.at(i + 1) == "("):
            j, kind, name = i + 1, "function", ""
            if s.at(j) == "(":
                inner = [x.text for x in s.tokens[j + 1 : s.tokens[j].mate]]
                kind, j = "method", s.skip(j)
                if not s.word(j):
                    i = j
                    continue
                if "[" in inner:
                    inner = inner[: inner.index("[")]
                name = next((x for x in reversed(inner) if re.fullmatch(r"[^\W\d]\w*", x)), "") + "."
            name, j = name + s.at(j), j + 1
            while j < hi and s.at(j) != "{" and (s.at(j) in "([" or s.tokens[j].line == s.tokens[j - 1].last):
                j = s.skip(j)
            while j < hi and s.at(j) == "{" and s.at(j - 1) in ("interface", "struct"):
                j = s.skip(j)
                while j < hi and s.at(j) != "{" and s.tokens[j].line == s.tokens[j - 1].last:
                    j = s.skip(j)
            has_body = j < hi and s.at(j) == "{" and s.tokens[j].line == s.tokens[j - 1].last
            end = s.tokens[j].mate if has_body else j - 1
            end = end if end >= 0 else hi - 1
            yield Found(start, end, start, owner + name if kind == "function" else name, kind, low=start)
            i = end + 1
        elif fresh and t == "type" and (s.word(i + 1) or s.at(i + 1) == "("):
            j = i + 1
            if s.at(j) == "(":
                end = s.tokens[j].mate if s.tokens[j].mate > 0 else hi - 1
                spec = j + 1
                if not s.word(spec):
                    i = end + 1
                    continue
            else:
                spec, end = j, j
                k = s.skip(j)
                while k < hi and s.tokens[k].line == s.tokens[k - 1].last and s.at(k) != ";":
                    k = s.skip(k)
                end = k - 1
            yield Found(start, end, spec, owner + s.at(spec), "type", low=start)
            i = end + 1
        else:
            i = s.skip(i)


def _js_statement_end(s: Scan, i: int, hi: int) -> int:
    """The last token of the statement whose tokens start at i."""
    while i < hi:
        if s.at(i) == ";":
            return i
        i = s.skip(i)
        if i >= hi:
            break
        if s.tokens[i].line > s.tokens[i - 1].last and s.at(i) not in _JS_GOES_ON and s.at(i - 1) not in _JS_GOES_ON - {"]", ")"} | {"=", "=>"}:
            return i - 1
    return hi - 1


def _js_function_value(s: Scan, i: int) -> bool:
    if s.at(i) == "async" and s.tokens[i + 1 : i + 2] and (s.word(i + 1) or s.at(i + 1) == "("):
        i += 1
    if s.at(i) == "function":
        return True
    if s.word(i) and s.at(i + 1) == "=>":
        return True
    return s.at(i) == "(" and s.tokens[i].mate > 0 and s.at(s.tokens[i].mate + 1) == "=>"


def _js(s: Scan, lo: int, hi: int, owner: str, full: bool):
    if owner:
        yield from _js_members(s, lo, hi, owner)
        return
    i = lo
    while i < hi:
        start, j = i, i
        if s.at(j) == "export":
            j += 1
            j += s.at(j) == "default"
        inner = j
        j += s.at(j) == "async" and s.at(j + 1) == "function"
        word = s.at(j)
        before = s.at(i - 1) if i > lo else ";"
        fresh = before in (";", "}") or i == lo or s.tokens[i].line > s.tokens[i - 1].last
        if fresh and word == "function":
            j += 1
            j += s.at(j) == "*"
            name = s.at(j) if s.word(j) else "default"
            body = s.group(j, hi)
            if body is not None and s.tokens[body].mate > 0:
                yield Found(start, s.tokens[body].mate, inner, name, "function", low=start)
                i = s.tokens[body].mate + 1
                continue
        elif fresh and word == "class":
            name = s.at(j + 1) if s.word(j + 1) and s.at(j + 1) != "extends" else "default"
            body = s.group(j + 1, hi)
            if body is not None and s.tokens[body].mate > 0:
                end = s.tokens[body].mate
                yield Found(start, end, inner, name, "class", (body + 1, end), name, low=start)
                i = end + 1
                continue
        elif fresh and word in ("const", "let", "var"):
            end, k, name = _js_statement_end(s, j, hi), j + 1, None
            while k <= end and name is None:
                if s.word(k) and s.at(k + 1) == "=" and s.at(k - 1) in (word, ",") and _js_function_value(s, k + 2):
                    name = s.at(k)
                k = s.skip(k)
            if name:
                yield Found(start, end, inner, name, "function", low=start)
            i = end + 1
            continue
        i = s.skip(i) if j == i else j


def _js_members(s: Scan, lo: int, hi: int, owner: str):
    i = lo
    while i < hi:
        start, j = i, i
        while s.at(j) in ("static", "async", "get", "set", "*") and s.at(j + 1) not in ("(", "=", ";", "}"):
            j += 1
        name_at = j
        name = s.at(j)
        after = s.skip(j)
        if name == "[":
            name = "".join(t.text for t in s.tokens[j:after])
        if s.at(after) == "(" and s.tokens[after].mate > 0 and s.at(s.tokens[after].mate + 1) == "{" and name_at < hi:
            end = s.tokens[s.tokens[after].mate + 1].mate
            if end > 0:
                yield Found(start, end, start, owner + name, "method", low=start)
                i = end + 1
                continue
        i = _js_statement_end(s, i, hi) + 1 if s.at(i) != ";" else i + 1


_RUST_BEFORE = frozenset("pub const async unsafe extern default crate".split())


def _rust(s: Scan, lo: int, hi: int, owner: str, full: bool):
    i = lo
    attributes: list[tuple[int, int]] = []
    low = lo
    while i < hi:
        if s.at(i) == "#" and s.at(i + 1) == "[" and s.tokens[i + 1].mate > 0:
            attributes.append((i, s.tokens[i + 1].mate))
            i = s.tokens[i + 1].mate + 1
            continue
        if s.at(i) == "#" and s.at(i + 1) == "!" and s.at(i + 2) == "[":
            i = s.skip(i + 2)
            attributes, low = [], i
            continue
        start, j = i, i
        while s.at(j) in _RUST_BEFORE or (j > start and s.tokens[j].kind == "text") or (s.at(j) == "(" and s.at(j - 1) == "pub" and j > start):
            if s.at(j) == "const" and s.at(j + 1) not in ("fn", "async", "unsafe", "extern"):
                break
            j = s.skip(j)
        word, name = s.at(j), s.at(j + 1)
        body = s.group(j, hi)
        semi = j
        while semi < hi and s.at(semi) != ";" and not (body is not None and semi >= body):
            semi = s.skip(semi)
        ends_short = body is None
        end = (semi if semi < hi else hi - 1) if ends_short else s.tokens[body].mate
        if end < 0:
            end = hi - 1
        made = None
        inner = (body + 1, end) if body is not None else (end, end)
        if word == "fn" and s.word(j + 1):
            made = Found(start, end, start, owner + name, "method" if owner else "function") if body is not None else None
        elif full and s.word(j + 1) and (word in ("struct", "enum", "type") or word == "union" and s.at(j + 2) in ("{", "<")):
            if word == "type":
                k = j
                while k < hi and s.at(k) != ";":
                    k = s.skip(k)
                end = min(k, hi - 1)
            made = Found(start, end, start, owner + name, "type")
        elif (full or not owner) and word == "impl" and body is not None:
            k = s.angle(j + 1) if s.at(j + 1) == "<" else j + 1
            head = [(x, s.at(x)) for x in range(k, body)]
            cut = next((n for n, (_, t) in enumerate(head) if t == "where"), len(head))
            head, depth, split = head[:cut], 0, None
            for n, (_, t) in enumerate(head):
                depth += {"<": 1, ">": -1}.get(t, 0)
                if t == "for" and not depth:
                    split = n
            first = lambda part: next((t for x, t in part if s.word(x) or s.tokens[x].kind == "life"), "").lstrip("'")
            target = first(head[split + 1 :]) if split is not None else first(head)
            shown = f"{target} (impl {first(head[:split])})" if split is not None else target
            made = Found(start, end, start, owner + target, "class", inner, owner + shown)
        elif (full or not owner) and word == "trait" and body is not None:
            made = Found(start, end, start, owner + name, "class", inner, owner + name)
        elif (full or not owner) and word == "mod" and s.at(j + 2) == "{":
            made = Found(start, end, start, owner + name, "class", inner, owner + name, True)
        if made:
            made.attributes, made.low = attributes, low
            yield made
        i = max(end, i) + 1
        attributes, low = [], i


_RULES = {"go": _go, "js": _js, "rust": _rust}


def symbol_spans(source: str, suffix: str) -> list[Span] | None:
    """Spans of a file's declarations and of what they leave, or None for line windows."""
    from gneiss.operators.code import container

    language = LANGUAGES.get(suffix)
    plain = source.replace("\r\n", "\n")
    if language is None or _ODD.search(plain):
        return None
    scan = Scan(plain, language)
    lines = plain.split("\n")
    text = Lines(lines[:-1] if lines[-1] == "" else lines)

    def collect(lo: int, hi: int, owner: str, full: bool) -> list[Span]:
        out = []
        for f in _RULES[language](scan, lo, hi, owner, full):
            start = scan.extent(f.first, f.low, f.attributes)
            end, line = scan.tokens[f.last].last, scan.tokens[f.def_token].line
            if f.body is None:
                out.append(Span(start, end, line, f.name, f.kind))
            else:
                members = collect(*f.body, f.name + ".", f.full)
                out += container(text, start, end, line, f.name, f.shown, members, _CLOSERS)
        return out

    symbols = collect(0, len(scan.tokens), "", True)
    if not symbols and scan.broken:
        return None
    return sorted(symbols + text.modules(symbols), key=lambda s: (s.start, s.end))
