"""Paths of a document tree: classification, scope, ancestors and router spellings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and names of each class of document, in order of precedence.
SUFFIXES = (
    ("structured-markdown", (".md", ".markdown")),
    ("structured-mdx", (".mdx",)),
    ("structured-asciidoc", (".adoc", ".asciidoc")),
    ("structured-rst", (".rst",)),
    ("unparsed-markup", (".ipynb", ".org")),
)
EXTENSIONLESS = ("README", "CONTRIBUTING", "CHANGELOG", "SECURITY", "SUPPORT", "CODE_OF_CONDUCT")
ADVISORY = (".cursorrules", "llms.txt")
ADAPTERS = {
    "structured-markdown": "markdown",
    "extensionless-markdown": "markdown",
    "structured-mdx": "mdx",
    "structured-asciidoc": "asciidoc",
    "structured-rst": "rst",
    "plain-advisory": "plain-advisory",
}
EXCLUDED = ("node_modules", "vendor", "third_party", "dist", "build", ".next", "target", "test", "tests")

_any = lambda conditions: reduce(Column.__or__, conditions)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def classify(path: Column) -> Column:
    """The class of a document by its path, null for other files."""
    out = None
    for name, ends in SUFFIXES:
        fits = _any([path.endswith(e) for e in ends])
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.when(basename(path).isin(*EXTENSIONLESS), "extensionless-markdown").when(basename(path).isin(*ADVISORY), "plain-advisory")


def adapter(classification: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ADAPTERS.items() for x in kv])[classification]


def excluded(path: Column) -> Column:
    """A directory on the way, not the file itself, is one of EXCLUDED."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, EXCLUDED)))


def admission(path: Column) -> Column:
    """Why a path is refused: length, then grammar; null if it is admitted."""
    bad = (path == "") | path.contains("\\") | path.contains("\u0000") | path.rlike(r"(^|/)(\.\.?)?(/|$)")
    return F.when(F.octet_length(path) > 4096, "path-too-long").when(bad, "path-grammar")


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first, '' (the root) last."""
    parts = F.split(path, "/")
    up = F.transform(
        F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    return F.when(F.size(parts) > 1, F.concat(up, F.array(F.lit("")))).otherwise(F.array(F.lit("")))


def router_candidates(path: Column) -> Column:
    """Source paths that a documentation router would serve for a path, in the order they are tried."""
    stem = F.when(path.endswith(".html") & (F.length(path) > 5), path.substr(F.lit(1), F.length(path) - 5))
    output = F.concat(stem, F.lit(".md"))
    last = basename(path)
    bare = (last != "") & ~(last.endswith(".md") | last.endswith(".markdown") | last.endswith(".html"))
    readme = lambda c: F.when(c.endswith("/index.md"), F.concat(c.substr(F.lit(1), F.length(c) - 8), F.lit("README.md")))
    # rule by rule: output extension, index of a directory, the same for the output name, bare name
    tried = F.array(output, readme(path), readme(output), F.when(bare, F.concat(path, F.lit(".md"))))
    return F.array_distinct(F.filter(tried, lambda c: c.isNotNull() & (c != path)))
