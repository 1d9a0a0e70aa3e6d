"""The ordered chain on single destinations, declarations, and identities."""

import pytest
from pyspark.sql import functions as F

from snapweave.operators import chain, identity

ENTRIES = "path string, mode string, adapter string, is_document boolean, lines bigint, lfs boolean, transcludes boolean"


@pytest.fixture(scope="module")
def world(spark):
    rows = [
        ("docs/a.md", "100644", "markdown", True, 10, False, False),
        ("docs/index.md", "100644", "markdown", True, 3, False, True),
        ("src/x.py", "100644", None, False, 5, False, False),
        ("src/big.bin", "100644", None, False, 3, True, False),
        ("sub", "160000", None, False, None, False, False),
        ("docs/o.org", "100644", None, True, 5, False, False),
    ]
    anchors = spark.createDataFrame([("docs/a.md", "set-up"), ("docs/a.md", "end")], "target string, anchor string")
    rules = chain.declarations(spark.createDataFrame([("docs/.gitignore", "/out/ \r\n/one.txt\n!/no\n/*.log\n/a/./b\n/\nplain\n")], "path string, text string"))
    return spark.createDataFrame(rows, ENTRIES), anchors, rules


CASES = {
    "a.md#end": ("resolved", None, None),
    "#end": ("resolved", None, None),
    "": ("resolved", None, None),
    None: ("resolved", None, None),
    "a.md#Set_Up": ("missing", "heading-anchor-not-found", "set-up"),
    "A.md": ("missing", "path-not-found", "docs/a.md"),
    "a": ("resolved", None, None),
    "a.html": ("resolved", None, None),
    "../src/": ("resolved", None, None),
    "../src/#f": ("unsupported-semantics", "code-fragment", None),
    "../src/x.py/": ("type-mismatch", "tree", None),
    "../src/x.py#L2-L5": ("resolved", "lines", None),
    "../src/x.py#L2-L6": ("missing", "line-fragment-out-of-range", None),
    "../src/x.py#f": ("unsupported-semantics", "code-fragment", None),
    "../src/big.bin#L1": ("unsupported-semantics", "code-fragment", None),
    "../src/x.py?raw=1": ("unsupported-semantics", "query", None),
    "../sub": ("unsupported-target", "gitlink", None),
    "o.org#x": ("unsupported-semantics", "fragment", None),
    "index.md#x": ("unsupported-semantics", "fragment", None),
    "out/deep/x.md": ("declared-untracked", "docs/.gitignore", None),
    "one.txt": ("declared-untracked", "docs/.gitignore", None),
    "no": ("missing", "path-not-found", None),
    "../../x": ("invalid", "path-traversal", None),
    "a.md#%c3%28": ("invalid", "fragment-encoding", None),
    "a.md#%0a": ("invalid", "fragment-encoding", None),
    "//host/x": ("unsupported-semantics", "network-path", None),
    "/x": ("unsupported-semantics", "site-route", None),
    "https:x": ("invalid", "uri", None),
    "tel:1": ("external", "url", None),
}


def test_each_condition(spark, world):
    refs = spark.createDataFrame([(str(i), "docs/a.md", "markdown", d, False) for i, d in enumerate(CASES)], "id string, document string, adapter string, destination string, image boolean")
    got = {r.id: (r.resolution, r.reason, r.near) for r in chain.resolve(refs, *world).collect()}
    assert {d: got[str(i)] for i, d in enumerate(CASES)} == CASES
    assert len(got) == len(CASES)


def test_asciidoc_and_images(spark, world):
    refs = [("1", "asciidoc", "{page}.adoc", False), ("2", "asciidoc", "a.png", True), ("3", "asciidoc", "intro", False), ("4", "markdown", "out/", True)]
    refs = spark.createDataFrame([(i, "docs/a.md", a, d, m) for i, a, d, m in refs], "id string, document string, adapter string, destination string, image boolean")
    got = {r.id: r.reason for r in chain.resolve(refs, *world).collect()}
    assert got == {"1": "attribute-dependent", "2": "attribute-dependent", "3": "attribute-dependent", "4": "syntax"}


def test_empty(spark, world):
    refs = spark.createDataFrame([], "id string, document string, adapter string, destination string, image boolean")
    assert chain.resolve(refs, *world).count() == 0
    one = spark.createDataFrame([("1", "a.md", "markdown", "b.md", None)], refs.schema)
    assert [r.reason for r in chain.resolve(one, *[w.limit(0) for w in world]).collect()] == ["path-not-found"]


def test_identities(spark):
    row = {"fragment": "f", "query": None, "intent": "path", "destination": "a.md#f", "target": "a.md", "target_kind": "blob", "adapter": "markdown",
           "document": "d.md", "construct": "link", "block_digest": "b", "node_path": [1, 2]}
    schema = ", ".join(f"{k} {'array<int>' if k == 'node_path' else 'string'}" for k in row)
    rows = [row, row | {"node_path": [1, 3]}, row | {"target": "b.md"}, row | {"fragment": ""}, row | {"fragment": None}]
    got = spark.createDataFrame([tuple(r.values()) for r in rows], schema).select(identity.observation_id().alias("o"), identity.finding_key(F.lit("k")).alias("k")).collect()
    assert len({r.o for r in got}) == 5
    # a key has no position, but tells targets and an empty fragment from an absent one
    assert got[0].k == got[1].k and len({r.k for r in got}) == 4
