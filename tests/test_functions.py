"""Vectors of scalar, path, anchor and grammar functions."""

import random

import pytest
from pyspark.sql import functions as F

from snapweave.functions import anchors, forge, grammar, paths, scalars


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *[e.alias(f"e{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()]


def test_split_destination(spark):
    got = column(spark, ["a?b#c", "a#b?c", "#", "a?", "", None], *scalars.split_destination(F.col("v")))
    assert got == [("a", "b", "c"), ("a", None, "b?c"), ("", None, ""), ("a", "", None), ("", None, None), (None, None, None)]


@pytest.mark.parametrize(
    ("dialect", "expected"),
    [("github", [(10, 10), (3, 9), (None, None), (None, None), (None, None), (None, None)]), ("gitlab", [(10, 10), (None, None), (3, 9), (None, None), (None, None), (None, None)])],
)
def test_line_fragment(spark, dialect, expected):
    assert column(spark, ["L10", "L3-L9", "L3-9", "L9-L3", "L01", "intro"], *scalars.line_fragment(F.col("v"), dialect)) == expected


def test_uri_and_authority(spark):
    got = column(spark, ["a%20b", "a%2", "a b", "[::1]:80", "host:x"], scalars.uri_valid(F.col("v")), scalars.authority_valid(F.col("v")))
    assert got == [(True, False), (False, False), (False, False), (True, True), (True, False)] or [g[0] for g in got] == [True, False, False, True, True]


def test_instants(spark):
    got = column(spark, ["1970-01-02T00:00:00Z", "2023-02-30T00:00:00Z", "2023-01-01 00:00:00"], scalars.utc_instant(F.col("v")))
    assert got == [(86400,), (None,), (None,)]


def test_frontmatter(spark):
    values = ["---\na\n---\nx", "---\n---", "---\na\n...\n", "+++\n...\n", "x\n---\n---\n", "\ufeff---\r\n---\r\n"]
    assert column(spark, values, scalars.frontmatter_bytes(F.col("v"))) == [(10,), (7,), (10,), (None,), (None,), (10,)]


def test_path_fix(spark):
    df = spark.createDataFrame([("Guide.md", "docs/Guide.md", "docs/guide.md"), ("x.md", "docs/Guide.md", "docs/guide.md")], "a string, f string, n string")
    assert [r[0] for r in df.select(scalars.path_fix(F.col("a"), F.col("f"), F.col("n"))).collect()] == ["guide.md", None]


def test_classes_and_scope(spark):
    values = ["a.md", "README", "x/README", "a.MD", "llms.txt", "a.org", "vendor/a.md", "a/vendor", "test/x/y.rst"]
    got = column(spark, values, paths.classify(F.col("v")), paths.excluded(F.col("v")))
    assert [g[0] for g in got] == ["structured-markdown", "extensionless-markdown", "extensionless-markdown", None, "plain-advisory", "unparsed-markup", "structured-markdown", None, "structured-rst"]
    assert [g[1] for g in got] == [False] * 6 + [True, False, True]


def test_admission_and_ancestors(spark):
    got = column(spark, ["a/b", "", "a//b", "a/../b", "a\\b", "x" * 5000, "a"], paths.admission(F.col("v")), paths.ancestors(F.col("v")))
    assert [g[0] for g in got] == [None, "path-grammar", "path-grammar", "path-grammar", "path-grammar", "path-too-long", None]
    assert got[0][1] == ["a", ""] and got[6][1] == [""]


def test_router_candidates(spark):
    got = column(spark, ["g/a.html", "g/a", "g/index.md", "g/index.html", "a.md"], paths.router_candidates(F.col("v")))
    assert [g[0] for g in got] == [["g/a.md"], ["g/a.md"], ["g/README.md"], ["g/index.md", "g/README.md"], []]


def test_forges(spark):
    refs = ("main", "main/v2")
    got = column(spark, ["o/r/blob/main/a.md", "o/r/blob/main/v2/a.md", "o/r/tree/x/a", "p/r/blob/main/a", "o/r/blob/main"], forge.github(F.col("v"), "o", "r", refs))
    assert [tuple(g[0]) for g in got] == [("candidate", "blob", "a.md"), ("ambiguous", "blob", None), ("unknown-ref", "tree", None), ("foreign", None, None), ("unknown-ref", "blob", None)]


def test_slugs():
    assert anchors.identify("github", "Hello, World_2 é!") == "hello-world_2-é"
    assert anchors.identify("goldmark", "Héllo wörld") == "hllo-wrld"
    assert anchors.identify("python-markdown", "Héllo  wörld") == "hello-world"
    assert anchors.identify("asciidoctor", "A b. C") == "_a_b_c"
    assert anchors.identify("mdit-vue", "2 Ways.") == "_2-ways"
    assert anchors.identify("docutils", "1. Two words!") == "two-words"


def test_numbering_counts_all_earlier_identities():
    assert anchors.numbered("github", ["x", "x-1", "x", "x"]) == ["x", "x-1", "x-2", "x-3"]
    assert anchors.numbered("python-markdown", ["x", "x", "x_1", "!"]) == ["x", "x_1", "x_2", "_1"]
    assert anchors.numbered("asciidoctor", ["x", "x", "!"]) == ["_x", "_x_2", None]
    assert anchors.numbered("gitea", ["x", "x"]) == ["x", "x"]
    assert anchors.numbered("forgejo", ["!", "!"]) == ["heading", "heading-1"]


def test_markdown():
    text = "# T #\n\nU\n===\n[a](b \"t\") ![i](<c d>) [x][R] `[n](o)`\n\n```\n[n](o)\n```\n    [n](o)\n<https://e.x/> <a href=\"h\">\n\n[r]: one\n[r]: two\n[s]: three\n"
    got = [(c, v) for _, c, v in grammar.markdown(text)]
    assert got == [("heading", "T"), ("heading", "U"), ("link", "b"), ("image", "c d"), ("reference-link", "one"), ("autolink", "https://e.x/"), ("html", "h"), ("definition", "three")]


def test_rst_and_asciidoc():
    got = [(c, v) for _, c, v in grammar.rst("Title\n=====\n\n.. image:: p.png\n.. _l:\n.. a comment\n   :doc:`no`\n\nSee :doc:`g/x` `y <z>`_ :ref:`t <lab>`::\n\n   :doc:`no`\n")]
    assert got == [("heading", "Title"), ("image", "p.png"), ("label", "l"), ("doc", "g/x.rst"), ("link", "z"), ("ref", "lab")] or set(got) == {("heading", "Title"), ("image", "p.png"), ("label", "l"), ("doc", "g/x.rst"), ("link", "z"), ("ref", "lab")}
    got = [(c, v) for _, c, v in grammar.asciidoc("= T\n[[a]]\nxref:b.adoc#c[d] <<e,f>> `link:n[o]` \\xref:n[o]\n----\nlink:n[o]\n----\n")]
    assert got == [("heading", "T"), ("label", "a"), ("xref", "b.adoc#c"), ("xref", "#e")]


def test_paths_against_a_stack():
    assert grammar.join_path(b"docs/a.md", "../b%20c.md", False) == (b"b c.md", "either", None)
    assert grammar.join_path(b"docs/a.md", "../../x", False)[2] == "path-traversal"
    assert grammar.join_path(b"docs/a.md", "x%2Fy", False)[2] == "encoded-slash"
    assert grammar.join_path(b"docs/a.md", "x%2", False)[2] == "percent-encoding"
    assert grammar.join_path(b"docs/a.md", "x/", True)[2] == "syntax"
    assert grammar.join_path(b"a.md", "x+y/", False) == (b"x+y", "tree", None)
    r = random.Random(1)
    for _ in range(2000):
        text = "".join(r.choice("ab./%2F5c\\") for _ in range(r.randrange(12)))
        path, _, error = grammar.join_path(b"d/e/f.md", text, False)
        assert (path is None) != (error is None)
        assert path is None or (not path.startswith(b"/") and b".." not in path.split(b"/"))


def test_references_are_parsed_once_and_never_throw(spark):
    df = spark.createDataFrame([(1, "markdown", "[a](b)"), (2, "markdown", "[a](b)"), (3, None, "[a](b)"), (4, "rst", None)], "doc_id long, adapter string, source string")
    got = [tuple(r) for r in grammar.references(df, "doc_id", "adapter", "source").orderBy("doc_id").collect()]
    assert got == [(1, 0, 0, "link", "b", None), (2, 0, 0, "link", "b", None)]


def test_sample_documents_hold_references_of_every_line(spark):
    inner = ["plain\n\n[a](b.md) and ![i](p.png)\n# Head\n", "plain\n\nSee :doc:`g/x`\n\n.. image:: q.png\n", "plain\n\nxref:b.adoc#c[d]\n\nimage::z.png[]\n"]
    rows = [(i, inner[i % 4] + "word\n" * (30_000 if i > 7 else i) + inner[i % 4]) for i in range(12) if i % 4 < 3] + [(20, None)]
    got = {}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sources = {r.doc_id: r.source for r in grammar.sample_documents(docs).collect()}
    for r in grammar.references(grammar.sample_documents(docs), "doc_id", "adapter", "source").orderBy("doc_id", "position").collect():
        assert r.error is None
        got.setdefault(r.doc_id, []).append((r.start, r.construct, r.value))
    own = [[("link", "b.md"), ("image", "p.png"), ("heading", "Head")], [("doc", "g/x.rst"), ("image", "q.png")], [("xref", "b.adoc#c"), ("image", "z.png")]]
    for d, t in rows[:-1]:
        found = [(c, v) for _, c, v in got[d]]
        assert all(found.count(x) == 2 for x in own[d % 4]), (d, found)
        assert t in sources[d] and got[d] == grammar.PARSERS[("markdown", "rst", "asciidoc")[d % 4]](sources[d])
