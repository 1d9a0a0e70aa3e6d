"""Heading identities under the rules of the renderers that publish them.

A rule is a short chain of substitutions, kept as data. Numbering of repeated identities depends on
all earlier ones of the document, so it runs per document, in order; slugs of single headings that need
no Unicode tables are native.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """drop: what a heading loses; gap: what becomes the separator; see identify() for the order."""

    drop: str
    gap: str = r"\s"
    form: str | None = None
    ascii_only: bool = False
    strip: str = "before"
    lower: str = "before"
    head: bool = False
    squeeze: bool = False
    ends: str = ""
    separator: str = "-"
    prefix: str = ""
    digit_prefix: str = ""
    empty: str | None = ""
    repeats: str = "dash"
    marks: bool = True
    smart: bool = False


_WORD = r"[^\p{L}\p{N}_\s-]"
#: The closed set of renderer rules. empty None: no identity; repeats: how copies are numbered.
RULES = {
    "github": Rule(r"[^\p{L}\p{M}\p{N}\p{Pc} -]", " ", strip=""),
    "gitea": Rule(_WORD, lower="after", empty=None, repeats="collide"),
    "forgejo": Rule(_WORD, lower="after", empty="heading"),
    "mdbook": Rule(r"[^\p{Alphabetic}\p{N}_\s-]"),
    "mdbook-smart": Rule(r"[^\p{Alphabetic}\p{N}_\s-]", smart=True),
    "goldmark": Rule(r"[^A-Za-z0-9\s_-]", r"[\s_]", ascii_only=True, lower="after", empty="heading"),
    "python-markdown": Rule(_WORD, form="NFKD", ascii_only=True, strip="after", squeeze=True, repeats="underscore"),
    "pymdownx": Rule(r"[^\p{L}\p{N}_ -]", " ", form="NFC", repeats="underscore"),
    "mdit-vue": Rule(r"[\x00-\x1f]", r"[\s~`!@#$%^&*()\-_+=\[\]{}|\;:\"'“”‘’<>,.?/]", form="NFKD", strip="", squeeze=True, ends="both", digit_prefix="_", marks=False),
    "kramdown": Rule(r"[^A-Za-z0-9 -]", " ", strip="", head=True, empty="section"),
    "asciidoctor": Rule(r"[^\p{Alphabetic}\p{N}\p{M}\p{Pc} .\-]", r"[ .\-]", lower="after", squeeze=True, ends="end", separator="_", prefix="_", empty=None, repeats="two"),
    "docutils": Rule(r"(?!)", r"[^A-Za-z0-9]", form="NFKD", ascii_only=True, lower="after", head=True, squeeze=True, ends="both", empty=None),
}
_SMART = (("---", "—"), ("--", "–"), ("...", "…"))


def identify(name: str, heading: str) -> str:
    """The identity of one heading under a rule, before numbering."""
    r, s = RULES[name], heading
    if r.smart:
        for plain, typeset in _SMART:
            s = s.replace(plain, typeset)
    s = unicodedata.normalize(r.form, s) if r.form else s
    s = regex.sub(r"^[^A-Za-z]+", "", s) if r.head else s
    s = s.strip() if r.strip == "before" else s
    s = s.encode("ascii", "ignore").decode() if r.ascii_only else s
    s = s if r.marks else regex.sub(r"[̀-ͯ]", "", s)
    s = s.lower() if r.lower == "before" else s
    s = regex.sub(r.drop, "", s)
    s = s.lower() if r.lower == "after" else s
    s = s.strip() if r.strip == "after" else s
    gap = rf"(?:{r.gap}|{regex.escape(r.separator)})" + "+" * r.squeeze
    s = regex.sub(gap, r.separator, s)
    s = s.strip(r.separator) if r.ends == "both" else s.rstrip(r.separator) if r.ends == "end" else s
    s = r.digit_prefix + s if s[:1].isdigit() else s
    return r.prefix + s if s else s


def _free(base: str, style: str, taken: set[str]) -> str:
    """The first spelling of base that no earlier heading has taken."""
    if style == "underscore":
        # a counter at the end goes on counting; an empty identity always gets one
        m = regex.match(r"(.*)_(\d+)$", base, regex.S)
        stem, start = (m[1], int(m[2]) + 1) if m else (base, 1)
        names = ([base] if base else []), (f"{stem}_{n}" for n in count(start))
    else:
        mark, start = ("_", 2) if style == "two" else ("-", 1)
        names = [base], (f"{base}{mark}{n}" for n in count(start))
    return next(n for group in names for n in group if n not in taken)


def numbered(name: str, headings: list[str]) -> list[str | None]:
    """Identities of a document's headings in order."""
    rule, taken, out = RULES[name], set(), []
    for heading in headings:
        base = identify(name, heading) or rule.empty
        if base is None:
            out.append(None)
            continue
        own = base if rule.repeats == "collide" else _free(base, rule.repeats, taken)
        taken.add(own)
        out.append(own)
    return out


def slug(name: str, heading: Column) -> Column:
    """identify() as an expression, for rules that need neither normal forms nor a stripped head."""
    r = RULES[name]
    if r.form or r.head or r.ascii_only or r.smart or r.squeeze or r.prefix or not r.marks:
        raise ValueError(f"{name} has no native form")
    s = F.trim(heading) if r.strip else heading
    s = F.regexp_replace(F.lower(s), r.drop.replace(r"\p{Alphabetic}", r"\p{IsAlphabetic}"), "")
    return F.regexp_replace(s, r.gap, r.separator)


def identities(headings: DataFrame, key: str) -> DataFrame:
    """(key, rule, position, identity) under every rule, of headings (key, position, heading)."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, own in zip(f[key], f["own"], strict=True):
                texts = [h["heading"] or "" for h in own]
                for name in RULES:
                    rows += [(k, name, h["position"], i) for h, i in zip(own, numbered(name, texts), strict=True) if i is not None]
            yield pd.DataFrame(rows, columns=[key, "rule", "position", "identity"])

    kind = headings.schema[key].dataType.simpleString()
    per = headings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "heading"))).alias("own"))
    return per.mapInPandas(of, f"{key} {kind}, rule string, position int, identity string")
