"""Grammars that need Python: references of Markdown, MDX, reStructuredText and AsciiDoc, and paths.

A bounded subset, documented by its tests: inline and reference links and images, autolinks, HTML
attributes and ATX or setext headings of Markdown; directives, roles, targets and titles of
reStructuredText; macros, cross references, anchors and titles of AsciiDoc. Code blocks and spans are
skipped. Parsing never throws: a document that can't be read has no rows and its error in `error`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_CODE = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)", re.S)
_INLINE = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.|\[[^\]]*\])*)\]\(\s*(<[^<>\n]*>|[^\s()<>]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
_DEFINITION = re.compile(r"^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:\s*(<[^<>\n]*>|\S+)", re.M)
_REFERENCE = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.)+)\](?:\[((?:[^\[\]\\]|\\.)*)\])?(?![(:\[])")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*)>")
_HTML = re.compile(r"<(?:a\b[^>]*?\shref|img\b[^>]*?\ssrc)\s*=\s*[\"']([^\"']*)[\"']", re.I)
_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")


def _blank(text: str, spans: Iterator[re.Match]) -> str:
    """The text with spans as spaces, so that offsets stay."""
    out, at = [], 0
    for m in spans:
        out += [text[at : m.start()], re.sub(r"[^\n]", " ", m[0])]
        at = m.end()
    return "".join([*out, text[at:]])


def _without_blocks(text: str) -> str:
    """Fenced and indented code as blank lines."""
    out, fence, before = [], None, ""
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line[m.end() :].strip():
                fence = None
            line = " " * len(line)
        elif m:
            fence, line = m[1], " " * len(line)
        elif line.startswith(("    ", "\t")) and not before.strip():
            line = " " * len(line)
        out.append(line)
        before = line
    return "\n".join(out)


def _label(s: str) -> str:
    return " ".join(s.split()).casefold()


def markdown(text: str) -> list[tuple]:
    """(offset, construct, destination or heading)."""
    body = _without_blocks(text)
    rows, lines, at = [], body.split("\n"), 0
    for i, line in enumerate(lines):
        if m := _ATX.match(line):
            rows.append((at, "heading", m[2].strip()))
        elif i and _SETEXT.match(line) and lines[i - 1].strip() and not _ATX.match(lines[i - 1]):
            rows.append((at - len(lines[i - 1]) - 1, "heading", lines[i - 1].strip()))
        at += len(line) + 1
    body = _blank(body, _CODE.finditer(body))
    known: dict[str, tuple[int, str]] = {}
    for m in _DEFINITION.finditer(body):
        known.setdefault(_label(m[1]), (m.start(), m[2].strip("<>")))
    inline = list(_INLINE.finditer(body))
    rows += [(m.start(), "image" if m[1] else "link", m[3].strip("<>")) for m in inline]
    rest = _blank(_blank(body, iter(inline)), _DEFINITION.finditer(body))
    used = set()
    for m in _REFERENCE.finditer(rest):
        label = _label(m[3] or m[2])
        if label in known:
            used.add(label)
            rows.append((m.start(), "reference-image" if m[1] else "reference-link", known[label][1]))
    rows += [(at, "definition", d) for k, (at, d) in known.items() if k not in used]
    rows += [(m.start(), "autolink", m[1]) for m in _AUTO.finditer(rest)]
    rows += [(m.start(), "html", m[1]) for m in _HTML.finditer(rest)]
    return sorted(rows)


_DIRECTIVE = re.compile(r"^\s*\.\. (image|figure|include|literalinclude)::[ \t]+(\S+)[ \t]*$")
_ROLE = re.compile(r":(doc|ref|file|download):`(?:[^`<]*<([^`>]+)>|([^`]+))`")
_PHRASE = re.compile(r"`[^`<]+<([^`>]+)>`__?")
_TARGET = re.compile(r"^\s*\.\. _([^:]+):[ \t]*(\S*)[ \t]*$")


def rst(text: str) -> list[tuple]:
    lines, rows, at, quiet = text.split("\n"), [], 0, None
    for i, line in enumerate(lines):
        indent = len(line) - len(line.lstrip())
        if quiet is not None and line.strip() and indent <= quiet:
            quiet = None
        if quiet is None:
            if m := _DIRECTIVE.match(line):
                rows.append((at, m[1], m[2]))
            elif m := _TARGET.match(line):
                if not m[2].endswith("_"):
                    rows.append((at, "target" if m[2] else "label", m[2] or _label(m[1])))
            elif line.lstrip().startswith(".. ") and "::" not in line:
                quiet = indent
            elif i + 1 < len(lines) and line.strip() and len(set(lines[i + 1].strip())) == 1 and not lines[i + 1].strip()[0].isalnum() and len(lines[i + 1].rstrip()) >= len(line.rstrip()) > 0:
                rows.append((at, "heading", line.strip()))
            else:
                for m in _ROLE.finditer(line):
                    d = m[2] or m[3]
                    last = d.rpartition("/")[2]
                    rows.append((at + m.start(), m[1], d if m[1] != "doc" or d.startswith("/") or "." in last else d + ".rst"))
                for m in _PHRASE.finditer(line):
                    if not m[1].endswith("_"):
                        rows.append((at + m.start(), "link", m[1]))
            if line.rstrip().endswith("::") and not line.lstrip().startswith(".. "):
                quiet = indent
        at += len(line) + 1
    return sorted(rows)


_MACRO = re.compile(r"(?<![\w\\])(xref|link|image|include)(::?)([^\s\[\]]+)\[[^\]]*\]")
_CROSS = re.compile(r"(?<!\\)<<([^<>,]+)(?:,[^<>]*)?>>")
_ANCHOR = re.compile(r"^\[(?:\[([^\],]+)[^\]]*\]|#([^\].,]+)[^\]]*)\]")
_VERBATIM = re.compile(r"`[^`\n]*`|\+\+.*?\+\+")


def asciidoc(text: str) -> list[tuple]:
    rows, at, fence = [], 0, None
    for line in text.split("\n"):
        bare = line.rstrip()
        if fence:
            fence = None if bare == fence else fence
        elif re.fullmatch(r"(-{4,}|\.{4,}|/{4,}|\+{4,}|={4,}|\*{4,}|_{4,})", bare):
            fence = bare
        elif m := re.match(r"^={1,6} (.+)$", bare):
            rows.append((at, "heading", m[1].strip()))
        else:
            if m := _ANCHOR.match(line):
                rows.append((at, "label", m[1] or m[2]))
            clean = _blank(line, _VERBATIM.finditer(line))
            for m in _MACRO.finditer(clean):
                rows.append((at + m.start(), m[1], m[3]))
            for m in _CROSS.finditer(clean):
                d = m[1].strip()
                rows.append((at + m.start(), "xref", d if "#" in d or "." in d else f"#{d}"))
        at += len(line) + 1
    return sorted(rows)


PARSERS = {"markdown": markdown, "mdx": markdown, "rst": rst, "asciidoc": asciidoc, "plain-advisory": lambda _: []}


def references(documents: DataFrame, key: str, adapter: str, source: str) -> DataFrame:
    """(key, position, start, construct, value, error): each distinct (source, adapter) is parsed once.

    Documents without an adapter are left out before any text reaches Python.
    """
    docs = documents.filter(F.col(adapter).isNotNull()).withColumn("_hash", F.sha2(F.col(source).cast("binary"), 256))
    unique = docs.groupBy("_hash", adapter).agg(F.first(source).alias(source))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for h, a, s in zip(f["_hash"], f[adapter], f[source], strict=True):
                try:
                    found, error = PARSERS[a](s or ""), None
                except Exception as e:  # a document that can't be parsed is a row, not a failed job
                    found, error = [(None, None, None)], type(e).__name__
                out += [(h, a, i, at, c, v, error) for i, (at, c, v) in enumerate(found)]
            yield pd.DataFrame(out, columns=["_hash", adapter, "position", "start", "construct", "value", "error"])

    parsed = unique.mapInPandas(parse, f"_hash string, {adapter} string, position int, start int, construct string, value string, error string")
    return docs.select(key, "_hash", adapter).join(parsed, ["_hash", adapter]).drop("_hash", adapter)


def sample_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, adapter, source): whole texts with markup of each adapter around them, for the tables' texts have none."""
    n = F.col("doc_id").cast("string")
    body = F.coalesce("text", F.lit(""))
    md = F.concat(F.lit("# Title "), n, F.lit("\n\n"), body, F.lit(" [next](doc-"), n, F.lit(".md#top) ![i](<a b.png>) `[no](x)` [r][]\n\n```\n[no](code)\n```\n\n[r]: ref.md\n"))
    rs = F.concat(F.lit("Title "), n, F.lit("\n==========================\n\n.. image:: pic.png\n\n.. _label-"), n, F.lit(":\n\nSee :doc:`guide/x` and `y <z.rst>`_.\n\n"), body, F.lit("\n"))
    ad = F.concat(F.lit("= Title "), n, F.lit("\n\nxref:doc-"), n, F.lit(".adoc#a[x] <<sec>> `link:no[x]`\n\n----\nlink:no[x]\n----\n[[anchor]]\n"), body, F.lit("\n"))
    k = F.col("doc_id") % 4
    adapter = F.when(k == 0, "markdown").when(k == 1, "rst").when(k == 2, "asciidoc")
    return documents.select("doc_id", adapter.alias("adapter"), F.when(k == 0, md).when(k == 1, rs).when(k == 2, ad).otherwise(body).alias("source"))


def percent_decoded(text: str) -> tuple[bytes | None, str | None]:
    """(bytes, error): one decode; a bad escape outranks a byte that a path can't hold."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        return None, "percent-encoding"
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode())
    for pattern, error in ((rb"/", "encoded-slash"), (rb"\\", "backslash-separator"), (rb"[\x00-\x1f\x7f]", "decoded-path-control")):
        if re.search(pattern, raw):
            return None, error
    return raw, None


def join_path(document: bytes, path: str, image: bool) -> tuple[bytes | None, str | None, str | None]:
    """(path, kind, error) of a destination that is relative to a document of the tree."""
    if "\\" in path:
        return None, None, "backslash-separator"
    tree = len(path) > 1 and path.endswith("/")
    parts = path.removesuffix("/").split("/")
    if "" in parts or (tree and image):
        return None, None, "syntax"
    stack = document.split(b"/")[:-1]
    for part in parts:
        raw, error = percent_decoded(part)
        if error:
            return None, None, error
        if raw == b"..":
            if not stack:
                return None, None, "path-traversal"
            stack.pop()
        elif raw != b".":
            stack.append(raw)
    joined = b"/".join(stack)
    if not joined or len(joined) > 4096:
        return None, None, "syntax"
    return joined, "tree" if tree else "blob" if image else "either", None


def native_path(document: Column, path: Column, image: Column) -> Column:
    """join_path() as a struct (path_hex, kind, error); paths are bytes, so in hexadecimal."""

    @F.pandas_udf("path_hex string, kind string, error string")
    def joined(d: pd.Series, p: pd.Series, i: pd.Series) -> pd.DataFrame:
        rows = [join_path((a or "").encode(), b, bool(c)) if b is not None else (None, None, None) for a, b, c in zip(d, p, i, strict=True)]
        return pd.DataFrame([(r[0].hex() if r[0] is not None else None, r[1], r[2]) for r in rows], columns=["path_hex", "kind", "error"])

    return joined(document, path, image)
