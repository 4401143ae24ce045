import pytest

from gneiss.operators import code, markdown
from gneiss.operators.spans import Lines, Span


def spans(source, most=0):
    return [(a, b) for a, b, _, _ in markdown.sections(source, most)]


def crumbs(source, most=0):
    return [c for _, _, c, _ in markdown.sections(source, most)]


GUIDE = """Read this first.
Twice.

# Setup
Install it.

## Keys

Make a key.
### Rotation
Every month.
## Ports
8080

"""


def test_markdown_line_spans():
    assert spans(GUIDE) == [(1, 2), (4, 5), (7, 11), (12, 13)]


def test_markdown_breadcrumbs():
    assert crumbs(GUIDE) == [(), ("Setup",), ("Setup", "Keys"), ("Setup", "Ports")]


@pytest.mark.parametrize("fence", ["```", "~~~~", "``````"])
def test_headings_in_fences_do_not_count(fence):
    source = f"intro\n{fence}sh\n# a comment\n``\n## another\n{fence}\n# Usage\nrun it\n"
    assert spans(source) == [(1, 6), (7, 8)] and crumbs(source)[1] == ("Usage",)


def test_unclosed_fence_takes_the_rest():
    assert spans("# Log\n~~~\none\n# two\n## three\n") == [(1, 5)]


def test_heading_without_body_is_left_out():
    assert crumbs("# Index\n## Terms\nsome\n## Gone\n\n# Also gone\n") == [("Index", "Terms")]


def test_oversize_is_cut_at_deeper_headings():
    source = "# Api\nstart\n### get\n" + "g" * 70 + "\n### put\n" + "p" * 70 + "\n#### body\nsmall\n"
    assert [c[-1] for c in crumbs(source, 100)] == ["Api", "get", "put"]


def test_paragraphs_lines_and_slices_fit_the_budget():
    source = "# Notes\n" + "\n\n".join(f"{i} " + "n" * 33 for i in range(9)) + "\n" + "w" * 205 + "\nend\n"
    lines = Lines(source)
    pieces = markdown.sections(source, 90)
    texts = [lines.text(a, b) if t is None else t for a, b, _, t in pieces]
    sliced = [(a, b, t) for a, b, _, t in pieces if t is not None]
    assert max(map(len, texts)) <= 90 and {(a, b) for a, b, _ in sliced} == {(19, 19)} and "".join(t for *_, t in sliced) == "w" * 205
    assert [n for a, b, _, _ in pieces for n in range(a, b + 1) if (n < 19 and not lines.blank[n])] == [n for n in range(1, 19) if not lines.blank[n]]


@pytest.mark.parametrize("source", ["", "\n\n  \n"])
def test_blank_markdown(source):
    assert markdown.sections(source) == []


def test_markdown_ids_survive_a_section_above(spark):
    rows = [("a.md", "r", "# A\n\nx\n\n## B\n\ny\n"), ("b.md", "r", None), ("c.md", "r", "")]
    more = [("a.md", "r", "# New\n\nz\n\n# A\n\nx\n\n## B\n\ny\n")]
    schema = "file_path string, repo_name string, text string"
    ids = lambda data: {r["embed_text"]: r["id"] for r in markdown.chunk_markdown(spark.createDataFrame(data, schema), ["file_path", "repo_name"]).collect()}
    before, after = ids(rows), ids(more)
    assert before.items() <= after.items() and len(after) == 3


def test_windows_terminate_at_the_end():
    at = lambda n, size, over: [(s.start, s.end) for s in Lines(["line"] * n).windows(size, over)]
    assert at(7, 4, 1) == [(1, 4), (4, 7)] and at(8, 4, 1) == [(1, 4), (4, 7), (7, 8)] and at(3, 4, 1) == [(1, 3)]


SOURCE = "import os\n\n\n@deco\ndef top(a):\n    def inner():\n        pass\n    return a\n\n\nclass Service:\n    attr = 1\n\n    def run(self):\n        return 1\n\n    other = 2\n\n    def stop(self):\n        return 2\n\n\ndef top(b):\n    return b\n\n\nif os:\n    def conditional():\n        return 1\nelse:\n    def conditional():\n        return 2\n"


def test_python_symbols():
    found = {}
    for s, _, _ in code.chunks(SOURCE, "m.py"):
        found.setdefault(s.symbol, []).append((s.start, s.end, s.def_line, s.kind))
    assert found["top"][0] == (4, 8, 5, "function") and len(found["top"]) == 2
    assert len(found["conditional"]) == 2
    assert found["Service"] == [(11, 13, 11, "class")]
    assert found["Service.run"][0][3] == "method"
    assert found["Service.<resto>"] == [(17, 17, None, "class_rest")]
    assert "inner" not in found and "<module>" not in found


def test_text_equals_lines():
    lines = SOURCE.splitlines()
    for s, body, _ in code.chunks(SOURCE, "m.py"):
        assert body == "\n".join(lines[s.start - 1 : s.end])


def test_bad_syntax_gives_windows():
    assert {s.kind for s, _, _ in code.chunks("def broken(:\n", "m.py")} == {"window"}


def test_budget_keeps_the_definition_line_once():
    source = "def f():\n" + "    x = 1\n" * 200
    made = [s for s, body, _ in code.chunks(source, "m.py", 300) if len(body) <= 300]
    assert len(made) > 5 and [s.def_line for s in made] == [1] + [None] * (len(made) - 1)


def test_long_line_becomes_slices():
    text = Lines(["ab", "c" * 25, "d"])
    assert [(p.start, p.end, p.part and len(p.part)) for p in text.fit(Span(1, 3, 1, "f", "function"), 10)] == [(1, 1, None), (2, 2, 10), (2, 2, 10), (2, 2, 5), (3, 3, None)]


def symbols(source, path):
    return {s.symbol: s for s, _, _ in code.chunks(source, path)}


def test_go_receivers_types_and_comments():
    source = 'package p\n\n// S does.\ntype S struct {\n\ta int\n}\n\nfunc (b *Box[T]) Get() T { return b.v }\n\nvar x = 1 // note\nfunc A() int {\n\treturn 1\n}\n\n// apart\n\nfunc B() interface{} {\n\treturn "}"\n}\n'
    by = symbols(source, "m.go")
    assert (by["S"].start, by["S"].def_line, by["S"].kind) == (3, 4, "type")
    assert by["Box.Get"].kind == "method" and by["A"].start == 11
    assert (by["B"].start, by["B"].end) == (17, 19)


def test_javascript_functions_and_classes():
    source = "/** adds */\nexport function add(a, b) {\n  return `${a} }` + /[}]/.test(b);\n}\n\nconst f = async (n) => {\n  return n;\n};\n\nconst plain = 42;\n\nexport default class C {\n  constructor() {}\n\n  /** go */\n  static run(x) {\n    return x;\n  }\n}\n"
    by = symbols(source, "m.jsx")
    assert {"add", "f", "C", "C.constructor", "C.run"} == set(by)
    assert (by["add"].start, by["add"].def_line) == (1, 2) and (by["C.run"].start, by["C.run"].def_line) == (15, 16)


def test_rust_names():
    source = "/// A.\n#[derive(Debug)]\npub struct Cache {\n    d: u8,\n}\n\npub trait Marker {\n    fn id(&self) -> u32;\n}\n\nimpl<T> Store for Cache<T> {\n    fn get(&self) -> char {\n        '}'\n    }\n}\n\nmod inner {\n    pub struct Deep;\n    pub fn deep() -> i32 { 1 }\n}\n"
    by = symbols(source, "m.rs")
    assert (by["Cache"].start, by["Cache"].def_line, by["Cache"].kind) == (1, 3, "type")
    assert by["Marker"].kind == "class" and {"Cache (impl Store)", "Cache.get", "inner.Deep", "inner.deep"} <= set(by)
    crlf = symbols(source.replace("\n", "\r\n"), "m.rs")
    assert {k: (v.start, v.end) for k, v in by.items()} == {k: (v.start, v.end) for k, v in crlf.items()}


@pytest.mark.parametrize("source", ["}{ not go ((( \n" * 8, "package p\x0c\n\nfunc A() int {\n\treturn 1\n}\n"])
def test_symbol_files_that_give_windows(source):
    assert {s.kind for s, _, _ in code.chunks(source, "m.go")} == {"window"}


def test_yaml_packing_separators_and_templates():
    assert [s.symbol for s in code.yaml_spans("host: h\nport: 1\n'tls on': yes\n", 4000)] == ["host..tls on"]
    assert [(s.symbol, s.start) for s in code.yaml_spans("one: 1\n--- # next\ntwo: 2\nthree: 3\n", 4000)] == [("one", 1), ("two..three", 3)]
    for source in ("name: {{ .Values.name }}\n", "- only\n- items\n", "# only a note\n", "http://host: x\n"):
        assert code.yaml_spans(source, 4000) is None


def test_yaml_oversize_is_cut_by_children_with_their_comments():
    source = "web:\n  image: nginx\n  # how much\n  limits:\n    memory: " + "9" * 90 + "\n  tail: t\nend: e\n"
    found = code.yaml_spans(source, 80)
    assert [(s.symbol, s.start, s.def_line) for s in found] == [("web", 1, 1), ("web.image", 2, 2), ("web.limits", 3, 4), ("web.limits.memory", 5, 5), ("web.tail", 6, 6), ("end", 7, 7)]


def test_code_ids_are_stable(spark):
    schema = "file_path string, repo_name string, text string"
    ids = lambda t: {r["symbol_name"]: r["id"] for r in code.chunk_code(spark.createDataFrame([("m.py", "r", t)], schema), ["file_path", "repo_name"]).collect()}
    a, b = ids("def f():\n    return 1\n"), ids("# new\n\n\ndef f():\n    return 1\n")
    assert a["f"] == b["f"]
