"""The ordered resolution of references: every destination gets exactly one outcome.

All conditions are columns, so the chain is one CASE over equi-joins with the entries, their implied
directories, router spellings, ignore declarations and anchors. Only the join of a path with its
document decodes bytes, in an Arrow UDF. Forge URLs are routed before, by `functions.forge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapweave.functions import grammar, paths, scalars
from snapweave.operators import resolution

OUTCOME = "struct<resolution: string, reason: string>"


def declarations(files: DataFrame) -> DataFrame:
    """(by, path, is_directory) from ignore files (path, text): anchored literal lines only.

    A line counts if it starts with '/', holds no pattern character and each segment is a plain name;
    carriage returns and trailing blanks don't count. A trailing '/' declares a directory and all below.
    """
    line = F.regexp_replace(F.regexp_replace("line", r"\r$", ""), r"[ \t]+$", "")
    rows = files.select("path", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", line)
    spelled = F.regexp_replace(F.substring("line", 2, 1 << 20), "/$", "")
    rows = rows.filter(F.col("line").startswith("/") & ~F.col("line").rlike(r"[*?\[\]\\]")).withColumn("spelled", spelled)
    rows = rows.filter((F.col("spelled") != "") & ~F.col("spelled").rlike(r"(^|/)(\.{0,2})(/|$)"))
    at = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    return rows.select(
        F.col("path").alias("by"), F.concat(at, "spelled").alias("path"), F.col("line").endswith("/").alias("is_directory")
    ).distinct()


def _declared(missing: DataFrame, rules: DataFrame) -> DataFrame:
    """(target, declared_by): the deepest ignore file that declares a target or a directory above it."""
    listed = missing.select("target").distinct().select(
        "target", F.explode(F.concat(F.array("target"), paths.ancestors(F.col("target")))).alias("path")
    )
    hits = listed.join(rules, "path").filter(F.col("is_directory") | (F.col("path") == F.col("target")))
    depth = F.size(F.split("by", "/"))
    return hits.groupBy("target").agg(F.max_by("by", F.struct(depth, "by")).alias("declared_by"))


def _outcome(name: str, reason: str | Column | None = None) -> Column:
    reason = reason if isinstance(reason, Column) else F.lit(reason)
    return F.struct(F.lit(name).alias("resolution"), reason.cast("string").alias("reason"))


def _syntax() -> Column:
    """Outcomes that the destination alone decides, in their order; null where the tree decides."""
    adoc = F.col("adapter") == "asciidoc"
    unclear = _outcome("unsupported-semantics", "attribute-dependent")
    web = F.lower("scheme").isin("http", "https")
    authority = F.regexp_extract("destination", r"^[^:]*://([^/?#]*)", 1)
    bad_uri = ~scalars.uri_valid(F.col("destination")) | web & (~F.col("destination").rlike("^[^:]*://") | ~scalars.authority_valid(authority))
    return (
        F.when(adoc & (F.col("image") | scalars.awaits_attribute(F.col("destination"))), unclear)
        .when(F.col("fragment").isNotNull() & F.col("anchor").isNull(), _outcome("invalid", "fragment-encoding"))
        .when(F.col("asked").startswith("//"), _outcome("unsupported-semantics", "network-path"))
        .when(F.col("scheme").isNotNull() & bad_uri, _outcome("invalid", "uri"))
        .when(F.col("scheme").isNotNull(), _outcome("external", "url"))
        .when(F.col("asked").startswith("/"), _outcome("unsupported-semantics", "site-route"))
        .when(adoc & (F.col("asked") != "") & scalars.names_a_page(F.col("asked")), unclear)
        .when(F.col("joined.error").isNotNull(), _outcome("invalid", F.col("joined.error")))
    )


def _tree() -> Column:
    """Outcomes that the located entry decides."""
    found, tree = F.col("mode"), F.col("mode").isin("040000", "implied")
    code = _outcome("unsupported-semantics", "code-fragment")
    return (
        F.when(found.isNull() & F.col("declared_by").isNotNull(), _outcome("declared-untracked", F.col("declared_by")))
        .when(found.isNull(), _outcome("missing", "path-not-found"))
        .when(found.isin("120000", "160000"), _outcome("unsupported-target", F.when(found == "120000", "symlink").otherwise("gitlink")))
        .when(((F.col("kind") == "blob") & tree) | ((F.col("kind") == "tree") & ~tree), _outcome("type-mismatch", F.col("kind")))
        .when(F.col("query").isNotNull() & (tree | F.col("target_adapter").isNull()), _outcome("unsupported-semantics", "query"))
        .when(F.coalesce("anchor", F.lit("")) == "", _outcome("resolved"))
        .when(tree, code)
        .when(F.col("first").isNotNull() & F.col("lfs"), code)
        .when(F.col("first").isNotNull() & (F.col("last") > F.col("lines")), _outcome("missing", "line-fragment-out-of-range"))
        .when(F.col("first").isNotNull(), _outcome("resolved", "lines"))
        .when(~F.col("is_document"), code)
        .when(F.col("target_adapter").isNull(), _outcome("unsupported-semantics", "fragment"))
        .when(F.col("known"), _outcome("resolved"))
        .when(F.col("transcludes"), _outcome("unsupported-semantics", "fragment"))
        .otherwise(_outcome("missing", "heading-anchor-not-found"))
    )


def _settled(rows: DataFrame) -> DataFrame:
    """The same rows; filters above don't copy the expressions below, which would grow beyond one method."""
    return rows.select(F.explode_outer(F.array(F.struct("*"))).alias("row")).select("row.*")


def resolve(refs: DataFrame, entries: DataFrame, anchors: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per reference: id, resolution, reason, target, near.

    refs: id, document, adapter (of the document), destination, image. entries: path, mode, adapter (null:
    none), is_document, lines, lfs, transcludes. anchors: target, anchor. rules: as declarations() gives
    them. The first condition that holds decides; a null destination is like an empty one, which names
    its own document. near is the one entry that differs by case, or the one anchor that differs by
    typography, of what is missing. Each id is taken to occur once.
    """
    destination = F.coalesce("destination", F.lit(""))
    path, query, fragment = scalars.split_destination(F.col("destination"))
    rows = refs.select("id", "document", "adapter", destination.alias("destination"), F.coalesce("image", F.lit(False)).alias("image"))
    rows = _settled(rows).withColumns({"asked": path, "query": query, "fragment": fragment, "scheme": scalars.scheme_of(F.col("destination"))})
    rows = _settled(rows)
    # an escape that can't be decoded, bytes that aren't UTF-8 and controls are one error
    raw = F.try_url_decode(F.replace("fragment", F.lit("+"), F.lit("%2B")))
    whole = ~F.col("fragment").rlike("%(?![0-9A-Fa-f]{2})")
    anchor = F.when(whole & ~raw.rlike(r"[\x00-\x1f\x7f�]"), raw)
    joined = F.when(F.col("asked") != "", grammar.native_path(F.col("document"), F.col("asked"), F.col("image")))
    rows = _settled(_settled(rows.withColumns({"anchor": anchor, "joined": joined})).withColumn("early", _syntax()))
    rows = rows.withColumns(
        {"target": F.when(F.col("asked") == "", F.col("document")).otherwise(F.decode(F.unhex("joined.path_hex"), "utf-8")),
         "kind": F.coalesce("joined.kind", F.lit("blob"))}
    )
    first, last = scalars.line_fragment(F.col("anchor"))
    ours = rows.filter("early is null").withColumns({"first": first, "last": last})
    # where nothing has the path, the router's spelling goes on in its place
    exact = resolution.locate(ours.select("id", "target", "kind"), entries.withColumn("oid", F.lit(None).cast("string")))
    absent = exact.filter("mode is null")
    served = resolution.first_candidate(absent.filter("kind <> 'tree'"), entries)
    ours = ours.join(served, "id", "left").withColumn("target", F.coalesce("served", "target")).drop("served")
    facts = entries.withColumnsRenamed({"path": "target", "adapter": "target_adapter"})
    implied = resolution.directories(entries).select(F.col("path").alias("target"), F.lit("implied").alias("implied"))
    ours = ours.join(facts, "target", "left").join(implied, "target", "left").withColumn("mode", F.coalesce("mode", "implied"))
    gone = ours.filter("mode is null").select("target").distinct()
    ours = ours.join(_declared(gone, rules), "target", "left")
    ours = ours.join(resolution.case_neighbour(gone, entries).withColumnRenamed("near", "near_path"), "target", "left")
    wanted = ours.filter("mode is not null and anchor <> ''").select("id", "target", F.col("anchor").alias("fragment"))
    looked = resolution.anchor_lookup(wanted, anchors).select("id", (F.col("resolution") == "resolved").alias("known"), F.col("near").alias("near_anchor"))
    ours = ours.join(looked, "id", "left").withColumn("late", _tree())
    near = F.when(F.col("late.reason") == "path-not-found", F.col("near_path")).when(F.col("late.reason") == "heading-anchor-not-found", F.col("near_anchor"))
    out = ours.select("id", "late.*", "target", near.alias("near"))
    none = F.lit(None).cast("string")
    return out.unionByName(rows.filter("early is not null").select("id", "early.*", none.alias("target"), none.alias("near")))
