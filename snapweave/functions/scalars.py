"""Scalar functions of references, destinations and digests, as Catalyst expressions.

Absent and empty differ: a missing part is null, an empty one is ''.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The largest integer that every reader of JSON holds exactly.
MAX_SAFE = 2**53 - 1


def ascii_lower(c: Column) -> Column:
    """A-Z folded, nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def _after(c: Column, at: Column) -> Column:
    return c.substr(at + 1, F.length(c))


def split_destination(c: Column) -> tuple[Column, Column, Column]:
    """(path, query, fragment): cut at the first '#', then at the first '?' before it."""
    at = F.locate("#", c)
    head = F.when(at > 0, c.substr(F.lit(1), at - 1)).otherwise(c)
    ask = F.locate("?", head)
    path = F.when(ask > 0, head.substr(F.lit(1), ask - 1)).otherwise(head)
    return path, F.when(ask > 0, _after(head, ask)), F.when(at > 0, _after(c, at))


def scheme_of(c: Column) -> Column:
    """The URI scheme, null without one."""
    return F.nullif(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), F.lit(""))


def uri_valid(c: Column) -> Column:
    """URI characters only, each percent sign before two hexadecimal digits."""
    return c.rlike(r"^(?:[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=]|%[0-9A-Fa-f]{2})*$")


def authority_valid(c: Column) -> Column:
    """ASCII host, or a bracketed address, and a port of digits."""
    return c.rlike(r"^(?:[^\s\[\]@/?#]*@)?(?:\[[0-9A-Fa-f:.]+\]|[\x21-\x22\x24-\x2E\x30-\x39\x3B-\x3E\x41-\x5A\x5E-\x7E]+)(?::[0-9]*)?$")


def same_host(c: Column, host: str) -> Column:
    """What follows https://host/, byte for byte; null for another host."""
    prefix = f"https://{host}/"
    return F.when(c.startswith(prefix), c.substr(F.lit(len(prefix) + 1), F.length(c)))


def awaits_attribute(c: Column) -> Column:
    """A {name} placeholder of letters, digits, '-' and '_'."""
    return c.rlike(r"\{[\p{L}\p{N}_\-]+\}")


def names_a_page(c: Column) -> Column:
    """The last segment is not empty and has no dot."""
    last = F.element_at(F.split(c, "/"), -1)
    return (last != "") & ~last.contains(".")


def oid_shaped(c: Column) -> Column:
    return c.rlike(r"^(?:[0-9a-f]{40}|[0-9a-f]{64})$")


def _line_number(c: Column) -> Column:
    """One to sixteen digits without a leading zero, within MAX_SAFE; else null."""
    n = F.when(c.rlike(r"^[1-9][0-9]{0,15}$"), c.try_cast("bigint"))
    return F.when(n <= MAX_SAFE, n)


def line_fragment(c: Column, dialect: str = "github") -> tuple[Column, Column]:
    """(first, last) of L<n> or a range: L<a>-L<b>, in gitlab's dialect L<a>-<b>; else nulls."""
    rest = F.when(c.startswith("L"), c.substr(F.lit(2), F.length(c)))
    mark = "-" if dialect == "gitlab" else "-L"
    at = F.locate(mark, rest)
    first = _line_number(F.when(at > 0, rest.substr(F.lit(1), at - 1)).otherwise(rest))
    last = F.when(at > 0, _line_number(rest.substr(at + len(mark), F.length(rest)))).otherwise(first)
    good = last >= first
    return F.when(good, first), F.when(good, last)


def typography_fold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("_"), F.lit("-"))


def normalized_label(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def domain_hash(domain: str, payload: Column) -> Column:
    """sha256 of the domain, a zero byte and the payload, in hexadecimal."""
    return F.sha2(F.concat(F.lit(domain).cast("binary"), F.unhex(F.lit("00")), payload.cast("binary")), 256)


def optional_digest(domain: str, c: Column) -> Column:
    """Null for an absent part; an empty one has a digest."""
    return F.when(c.isNotNull(), domain_hash(domain, c))


def doc_destination(c: Column) -> Column:
    """A :doc: target: .rst is appended unless it is absolute or its last segment has a dot."""
    last = F.element_at(F.split(c, "/"), -1)
    return F.when(c.startswith("/") | last.contains("."), c).otherwise(F.concat(c, F.lit(".rst")))


def decode_entities(c: Column) -> Column:
    """The named references amp, lt, gt, quot, apos and nbsp, amp last."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\u00a0"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def strip_markup(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def path_fix(authored: Column, found: Column, near: Column) -> Column:
    """The authored spelling with its tail replaced, if only that tail differs between found and near.

    found and near are the resolved path and its neighbour; null where the edit can't be proven.
    """
    ends = found.endswith(authored) & (F.length(found) == F.length(near))
    head = F.length(found) - F.length(authored)
    same = found.substr(F.lit(1), head) == near.substr(F.lit(1), head)
    return F.when(ends & same, near.substr(head + 1, F.length(near)))


def utc_instant(c: Column) -> Column:
    """Epoch seconds of YYYY-MM-DDTHH:MM:SSZ; null for any other spelling or date."""
    shaped = c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")
    return F.when(shaped, F.unix_timestamp(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))))


def instant_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def backoff(attempt: Column, least: int, most: int) -> Column:
    """least doubled with each attempt after the first, sixteen times at most, and no more than most."""
    steps = F.least(F.greatest(attempt, F.lit(1)) - 1, F.lit(16)).cast("int")
    return F.least(F.lit(most).cast("bigint"), F.lit(least).cast("bigint") * F.pow(F.lit(2.0), steps).cast("bigint"))


def rank(disposition: Column) -> Column:
    """record < warn < fail."""
    return F.when(disposition == "fail", 2).when(disposition == "warn", 1).when(disposition == "record", 0)


def disposition(of_rank: Column) -> Column:
    return F.when(of_rank == 2, "fail").when(of_rank == 1, "warn").when(of_rank == 0, "record")


def frontmatter_bytes(c: Column, most: int = 65_536) -> Column:
    """Bytes of a front matter region, closing line and its end included; null without one.

    The first line is --- (closed by --- or ...) or +++ (closed by +++), after an optional byte order
    mark that does not count.
    """
    body = F.regexp_replace(c, "^\ufeff", "")
    eol = r"(?:\r\n|\r|\n)"
    pattern = rf"(?s)^(---{eol}(?:.*?{eol})??(?:---|\.\.\.)(?:{eol}|$)|\+\+\+{eol}(?:.*?{eol})??\+\+\+(?:{eol}|$))"
    found = F.octet_length(F.regexp_extract(body, pattern, 1))
    return F.when((found > 0) & (found <= most), found)
