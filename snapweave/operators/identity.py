"""Identities: digests over canonical objects, and the orders that follow from them.

A digest is SHA-256 of a domain, a zero byte and the canonical JSON of an object: members in the
order of their names, absent ones null. Domains begin with a prefix that the caller may choose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapweave.functions.scalars import domain_hash, optional_digest

PREFIX = "snapweave"


def object_json(members: dict[str, Column]) -> Column:
    """Canonical JSON of named columns, nulls included."""
    return F.to_json(F.struct(*[members[k].alias(k) for k in sorted(members)]), {"ignoreNullFields": "false"})


def digest(domain: str, members: dict[str, Column], prefix: str = PREFIX) -> Column:
    return domain_hash(f"{prefix}/{domain}", object_json(members))


def _intent() -> dict[str, Column]:
    return {
        "fragment_digest": optional_digest(f"{PREFIX}/link-fragment", F.col("fragment")),
        "kind": F.col("intent"),
        "query_digest": optional_digest(f"{PREFIX}/link-query", F.col("query")),
        "raw_destination_digest": domain_hash(f"{PREFIX}/raw-destination", F.col("destination")),
        "repository_path": F.col("target"),
        "target_kind": F.col("target_kind"),
    }


def observation_id() -> Column:
    """Identity of an observation: document, construct, intent, block and node path, but no line or column."""
    intent = _intent()
    return digest("observation-id", {
        "adapter": F.col("adapter"),
        "document": F.col("document"),
        "extracted_intent": F.struct(*[intent[k].alias(k) for k in sorted(intent)]),
        "node_path": F.col("node_path"),
        "source_construct": F.col("construct"),
        "source_projection_digest": F.col("block_digest"),
    })


def finding_key(kind: Column) -> Column:
    """Key of a structural finding: what it says of which reference, without any position."""
    scope = {k: v for k, v in _intent().items() if k not in ("kind", "raw_destination_digest")} | {
        "document": F.col("document"), "source_construct": F.col("construct"), "source_projection_digest": F.col("block_digest"),
    }
    return digest("finding-key", {"finding_kind": kind, "scope": F.struct(*[scope[k].alias(k) for k in sorted(scope)])})


def fact_digest(key: Column, resolution: Column, multiplicity: Column) -> Column:
    return digest("fact", {"key": key, "multiplicity": multiplicity, "resolution": resolution})


def target_projection(mode: Column, raw: Column, lines: bool = False) -> Column:
    """Digest of what a reference names: an entry, or the lines of one, which has a domain of its own."""
    return digest("target-line-projection" if lines else "target-projection", {"git_mode": mode, "raw_digest": raw})


def structural_facts(side: DataFrame, kind: Column) -> DataFrame:
    """(finding_key, multiplicity, fact): equal keys are counted, and the count is in the fact."""
    keyed = side.select(finding_key(kind).alias("finding_key"), "resolution")
    counted = keyed.groupBy("finding_key").agg(F.min("resolution").alias("resolution"), F.count("*").alias("multiplicity"))
    return counted.select("finding_key", "multiplicity", fact_digest(F.col("finding_key"), F.col("resolution"), F.col("multiplicity")).alias("fact"))


def fact_attribution(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(finding_key, attribution): introduced, resolved, pre-existing for equal facts, else unknown."""
    one = lambda d, n: d.select("finding_key", F.col("fact").alias(n))
    return one(base, "before").join(one(candidate, "after"), "finding_key", "full").select(
        "finding_key",
        F.when(F.col("before").isNull(), "introduced").when(F.col("after").isNull(), "resolved")
        .when(F.col("before") == F.col("after"), "pre-existing").otherwise("unknown").alias("attribution"),
    )
