"""URLs of forges: is it a file or directory of this repository, at a ref that is trusted?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapweave.functions.scalars import ascii_lower, oid_shaped


def _literal(c: Column, own: str) -> Column:
    """Equal but for the case of A-Z; no escapes, ASCII only."""
    return F.coalesce((ascii_lower(c) == own.lower()) & c.rlike(r"^[\x00-\x24\x26-\x7F]+$"), F.lit(False))


def _at(parts: Column, i: Column | int) -> Column:
    return F.get(parts, F.lit(i) if isinstance(i, int) else i)


def _tail(parts: Column, start: Column | int) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    return F.when(F.size(parts) > start, F.array_join(F.slice(parts, start + 1, F.size(parts)), "/")).otherwise(F.lit(""))


def _route(same: Column, kind: Column, tail: Column, refs: tuple[str, str]) -> Column:
    """foreign, or the ref's role and the path behind it; refs are (candidate, default)."""
    hit = lambda ref: tail.startswith(f"{ref}/") & (F.length(tail) > len(ref) + 1)
    rest = lambda ref: tail.substr(F.lit(len(ref) + 2), F.length(tail))
    candidate, default = refs
    both = hit(candidate) & hit(default) & F.lit(candidate != default)
    return F.when(~same | kind.isNull(), F.struct(F.lit("foreign").alias("route"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("path"))).otherwise(
        F.struct(
            F.when(both, "ambiguous").when(hit(candidate), "candidate").when(hit(default), "default").otherwise("unknown-ref").alias("route"),
            kind.alias("kind"),
            F.when(both, None).when(hit(candidate), rest(candidate)).when(hit(default), rest(default)).alias("path"),
        )
    )


def github(suffix: Column, owner: str, name: str, refs: tuple[str, str]) -> Column:
    """owner/name/(blob|tree)/ref/path as a struct (route, kind, path)."""
    parts = F.split(suffix, "/")
    kind = F.when(_at(parts, 2) == "blob", "blob").when(_at(parts, 2) == "tree", "tree")
    return _route(_literal(_at(parts, 0), owner) & _literal(_at(parts, 1), name), kind, _tail(parts, 3), refs)


def gitlab(suffix: Column, owner: str, name: str, refs: tuple[str, str]) -> Column:
    """group/.../name/-/(blob|tree)/ref/path."""
    parts = F.split(suffix, "/")
    dash = F.array_position(parts, "-").cast("int")
    project = F.array_join(F.slice(parts, 1, F.greatest(dash - 1, F.lit(0))), "/")
    kind = F.when(_at(parts, dash) == "blob", "blob").when(_at(parts, dash) == "tree", "tree")
    return _route((dash > 2) & _literal(project, f"{owner}/{name}"), kind, _tail(parts, dash + 1), refs)


def gitea(suffix: Column, owner: str, name: str, refs: tuple[str, str], candidate_oid: str | None = None) -> Column:
    """owner/name/src/(branch/ref|commit/oid|tag/...)/path; a tag is never trusted."""
    parts = F.split(suffix, "/")
    same = _literal(_at(parts, 0), owner) & _literal(_at(parts, 1), name) & F.coalesce(_at(parts, 2) == "src", F.lit(False))
    kind = F.when((F.size(parts) > 6) & (F.element_at(parts, -1) == ""), "tree").otherwise("either")
    how = _at(parts, 3)
    branch = _route(same, kind, _tail(parts, 4), refs)
    none = F.lit(None).cast("string")
    pinned = F.struct(
        F.when(_at(parts, 4) == F.lit(candidate_oid), "candidate").otherwise("unknown-ref").alias("route"), kind.alias("kind"), _tail(parts, 5).alias("path")
    )
    foreign = F.struct(F.lit("foreign").alias("route"), none.alias("kind"), none.alias("path"))
    tag = F.struct(F.lit("unknown-ref").alias("route"), kind.alias("kind"), none.alias("path"))
    return (
        F.when(~same, foreign)
        .when(how == "branch", branch)
        .when((how == "commit") & oid_shaped(_at(parts, 4)), pinned)
        .when(how == "tag", tag)
        .otherwise(foreign)
    )


def repository_shape(url: Column, hosts: dict[str, str]) -> Column:
    """owner/name of an https URL on a known host (dialect by host); null for other shapes."""
    rest = F.when(url.startswith("https://"), url.substr(F.lit(9), F.length(url)))
    rest = F.regexp_extract(rest, r"^[^?#]*", 0)
    parts = F.split(rest, "/")
    host = _at(parts, 0)
    dash = F.array_position(parts, "-").cast("int")
    plain = F.when((F.size(parts) >= 3) & (_at(parts, 1) != "") & (_at(parts, 2) != ""), F.concat_ws("/", _at(parts, 1), _at(parts, 2)))
    nested = F.when(dash > 3, F.array_join(F.slice(parts, 2, dash - 2), "/")).when((dash == 0) & (F.size(parts) >= 3), F.array_join(F.slice(parts, 2, F.size(parts)), "/"))
    out = F.lit(None).cast("string")
    for name, dialect in hosts.items():
        out = F.when(host == name, nested if dialect == "gitlab" else plain).otherwise(out)
    return out
