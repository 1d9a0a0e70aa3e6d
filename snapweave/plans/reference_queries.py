"""Queries over W3: references of two snapshots, correlated, judged and reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.operators import correlation, feedback, findings, policy, resolution
from snapweave.plans import workloads as W

BASE, CANDIDATE = W.duck(W.observations(0)), W.duck(W.observations(1))
_WITH = f"WITH base AS ({BASE}), candidate AS ({CANDIDATE})"


def observed(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """References of a side, resolved against its own entries."""
    refs = W.frame(spark, sf_dir, W.side_refs(side))
    entries = W.frame(spark, sf_dir, W.targets(side))
    own = resolution.locate(refs.filter("intent = 'path'"), entries)
    own = own.withColumn("resolution", resolution.resolution(F.col("mode"), F.lit("blob")))
    own = own.withColumn("projection", F.when(F.col("resolution") == "resolved", F.col("oid"))).drop("mode", "oid")
    other = refs.filter("intent <> 'path'").withColumns(
        {"resolution": F.when(F.col("intent") == "external", "external").otherwise("unsupported-semantics"), "projection": F.lit(None).cast("string")}
    )
    return own.unionByName(other)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return observed(spark, sf_dir, 0), observed(spark, sf_dir, 1)


def structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings.structural(*sides(spark, sf_dir), ["document", "target"])
    return found.withColumn("effective", findings.configured(F.col("kind"), "enforce")).withColumn(
        "finding_key", F.concat_ws("|", F.col("document").cast("string"), "target", "kind")
    )


STRUCTURAL = f"""{_WITH}, members AS (
  SELECT document, target, resolution, id, 0 AS side FROM base WHERE resolution IN ('missing', 'type-mismatch')
  UNION ALL SELECT document, target, resolution, id, 1 FROM candidate WHERE resolution IN ('missing', 'type-mismatch')),
grouped AS (
  SELECT document, target, CASE resolution WHEN 'missing' THEN 'explicit-target-missing' ELSE 'explicit-target-type-mismatch' END AS kind,
    count(*) FILTER (side = 0) AS base_count, count(*) FILTER (side = 1) AS candidate_count, min(id) FILTER (side = 1) AS representative
  FROM members GROUP BY ALL),
found AS (
  SELECT *, CASE WHEN base_count = 0 THEN 'introduced' WHEN candidate_count = 0 THEN 'resolved'
                 WHEN base_count = candidate_count THEN 'pre-existing' ELSE 'unknown' END AS attribution,
    'fail' AS effective, CAST(document AS VARCHAR) || '|' || target || '|' || kind AS finding_key
  FROM grouped)
"""


def broken_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural(spark, sf_dir).groupBy("attribution", F.col("effective").alias("disposition")).agg(F.count("*").alias("findings"), F.sum("candidate_count").alias("members"))


def entry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir, 1).select("id", "resolution", "projection")


def reference_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.reference_counters(observed(spark, sf_dir, 1))


def finding_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.finding_counters(structural(spark, sf_dir))


def structural_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural(spark, sf_dir).select("document", "target", "kind", "base_count", "candidate_count", "representative", "attribution")


def boundary_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.boundary(observed(spark, sf_dir, 1)).select("id", "kind")


def exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.exact_pairs(*sides(spark, sf_dir), ["block", "resolution"])


def impact_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = correlation.exact_pairs(*sides(spark, sf_dir), ["block", "resolution", "projection"])
    change = correlation.target_change(F.col("b_resolution"), F.col("c_resolution"), F.col("b_projection"), F.col("c_projection"))
    p = p.withColumn("target_change", change).withColumn("impact", correlation.impact(F.col("target_change"), F.col("b_block") != F.col("c_block")))
    return p.groupBy("target_change", "impact").agg(F.count("*").alias("n"))


def component_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = sides(spark, sf_dir)
    key = lambda df: df.withColumn("construct", F.col("construct") % 2).withColumn("intent", F.col("target"))
    g = correlation.components(key(b), key(c))
    return g.groupBy("outcome").agg(F.count("*").alias("groups"), F.sum("n_base").alias("n_base"), F.sum("n_candidate").alias("n_candidate"))


def removed_new_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = sides(spark, sf_dir)
    gone = b.join(c.select("id"), "id", "left_anti").select("id", F.lit("removed").alias("change"))
    return gone.unionAll(c.join(b.select("id"), "id", "left_anti").select("id", F.lit("new")))


_LAYERS = {"repository": [("explicit-target-missing", "warn"), ("explicit-target-type-mismatch", "fail")], "floor": [("explicit-target-missing", "fail"), ("explicit-target-type-mismatch", "warn")]}


def raise_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = structural(spark, sf_dir).withColumn("disposition", findings.configured(F.col("kind"), "observe")).drop("effective")
    layers = [spark.createDataFrame(rows, "kind string, least string") for rows in _LAYERS.values()]
    out = findings.raised(f, *layers)
    return out.groupBy("kind", F.array_join("steps", ",").alias("steps"), "effective").agg(F.count("*").alias("n"))


def introduced_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = structural(spark, sf_dir).withColumn("demoted", findings.demoted(F.col("effective"), F.col("attribution")))
    return f.groupBy("attribution", "demoted").agg(F.count("*").alias("n"))


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = structural(spark, sf_dir).select(
        "kind", "attribution", "effective", F.concat(F.lit("doc-"), F.col("document").cast("string")).alias("subject"),
        F.greatest("candidate_count", "base_count").alias("members"), F.col("representative").alias("note"),
    )
    return feedback.items(f)


FEEDBACK = STRUCTURAL + """, acted AS (
  SELECT *, 'doc-' || CAST(document AS VARCHAR) AS subject, greatest(candidate_count, base_count) AS member_count,
    CASE attribution WHEN 'pre-existing' THEN 'existing' WHEN 'introduced' THEN 'fix' ELSE 'check' END AS action
  FROM found WHERE attribution <> 'resolved'),
items AS (
  SELECT action, subject, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, CAST(sum(member_count) AS BIGINT) AS members,
    'fail' AS disposition, min(representative) FILTER (action = 'fix') AS note FROM acted GROUP BY action, subject)
"""


def feedback_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feedback(spark, sf_dir)


def feedback_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.windows(_feedback(spark, sf_dir))


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural(spark, sf_dir).select(
        "finding_key", "kind", "effective", F.concat(F.lit("docs/o "), F.col("document").cast("string"), F.lit("*~.md")).alias("subject"),
        (F.col("document") % 3).alias("line"), F.when(F.col("document") % 7 > 0, F.sha2("finding_key", 256)).alias("fact"), "attribution",
    )


_REPORTED = STRUCTURAL + """, reported AS (
  SELECT finding_key, kind, effective, 'docs/o ' || CAST(document AS VARCHAR) || '*~.md' AS subject, document % 3 AS line,
    CASE WHEN document % 7 > 0 THEN sha256(finding_key) END AS fact, attribution, document FROM found)
"""


def sarif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.sarif(_reported(spark, sf_dir))


def codequality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.code_quality(_reported(spark, sf_dir))


def debt_mint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.minted(_reported(spark, sf_dir), ["explicit-target-missing"])[0]


def debt_mint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.minted(_reported(spark, sf_dir), ["explicit-target-missing"])[1]


NOW = 1000


def _debts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = _reported(spark, sf_dir).withColumn("document", F.split("finding_key", r"\|")[0].cast("bigint"))
    items = f.filter("document % 5 = 0").select(
        F.concat(F.lit("debt-"), "finding_key").alias("debt_id"), F.concat("finding_key", F.when(F.col("document") % 20 == 0, "?").otherwise("")).alias("finding_key"),
        F.when(F.col("document") % 15 == 0, F.lit("other")).otherwise(F.col("fact")).alias("accepted_fact"), (F.col("document") % 2000).alias("expires_at"),
    )
    return f, items


def debt_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, items = _debts(spark, sf_dir)
    return policy.debt(f, items, NOW)


_DEBTS = _REPORTED + """, items AS (
  SELECT 'debt-' || finding_key AS debt_id, finding_key || CASE WHEN document % 20 = 0 THEN '?' ELSE '' END AS finding_key,
    CASE WHEN document % 15 = 0 THEN 'other' ELSE fact END AS accepted_fact, document % 2000 AS expires_at FROM reported WHERE document % 5 = 0),
matched AS (
  SELECT i.*, r.fact, r.finding_key IS NOT NULL AS found FROM items i LEFT JOIN reported r ON r.finding_key = i.finding_key)
"""


def _waivers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = _reported(spark, sf_dir).withColumn("document", F.split("finding_key", r"\|")[0].cast("bigint"))
    d = F.col("document")
    items = f.filter("document % 6 = 0").select(
        F.concat(F.lit("waiver-"), "finding_key").alias("waiver_id"), F.concat("finding_key", F.when(d % 18 == 0, "?").otherwise("")).alias("finding_key"),
        F.when(d % 30 == 0, F.lit("other")).otherwise(F.col("fact")).alias("authorized_fact"), F.when(d % 42 == 0, "old").otherwise("tree").alias("candidate_tree"),
        F.concat(F.lit("p"), (d % 5).cast("string")).alias("owner"), F.concat(F.lit("p"), (d % 7).cast("string")).alias("issuer"),
        (d % 1500).alias("not_before"), (d % 1500 + 600).alias("expires_at"),
    )
    return f, items


def waiver_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, items = _waivers(spark, sf_dir)
    issuers = spark.createDataFrame([("p0",), ("p1",), ("p2",), ("p3",)], "issuer string")
    kinds = spark.createDataFrame([("explicit-target-missing",)], "kind string")
    out = policy.waiver_defects(items, f, issuers, kinds, "tree", NOW)
    return out.withColumn("position", F.col("position").cast("int"))


def exception_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _reported(spark, sf_dir).withColumn("document", F.split("finding_key", r"\|")[0].cast("bigint"))
    out = policy.with_exceptions(f, f.filter("document % 5 = 0").select("finding_key"), f.filter("document % 4 = 0").select("finding_key"))
    return out.groupBy("exception", "final").agg(F.count("*").alias("n"))


def run_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.verdict(structural(spark, sf_dir).filter("attribution <> 'resolved'"), spark.createDataFrame([], "path string, code string"))


def debt_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each debt item against the facts of a fresh scan: exactly one, with an equal digest."""
    f, items = _debts(spark, sf_dir)
    facts = f.groupBy("finding_key").agg(F.count("*").alias("facts"), F.min("fact").alias("fact"))
    state = F.when(F.col("facts").isNull(), "absent").when((F.col("facts") == 1) & F.col("fact").eqNullSafe(F.col("accepted_fact")), "reproduced").otherwise("different")
    return items.join(facts, "finding_key", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


QUERIES = [
    broken_references, entry_lookup, reference_counters, finding_counters, structural_findings, boundary_findings, exact_pairs, impact_quadrant,
    component_classes, removed_new_refs, raise_steps, introduced_demotion, feedback_items, feedback_top10, sarif_rows, codequality_rows,
    debt_mint, debt_mint_counts, debt_pass, waiver_defects, exception_overlap, run_result, debt_reproduction,
]

ORACLE_SQL = {
    "broken_references": STRUCTURAL + "SELECT attribution, effective AS disposition, count(*) AS findings, CAST(sum(candidate_count) AS BIGINT) AS members FROM found GROUP BY ALL",
    "entry_lookup": f"SELECT id, resolution, projection FROM ({CANDIDATE})",
    "reference_counters": f"""SELECT intent, count(*) AS total, count(*) FILTER (resolution = 'resolved') AS resolved, count(*) FILTER (resolution = 'missing') AS missing,
      count(*) FILTER (resolution = 'type-mismatch') AS type_mismatch, count(*) FILTER (resolution = 'unsupported-target') AS unsupported_target,
      count(*) FILTER (resolution = 'unsupported-semantics') AS unsupported_semantics, count(*) FILTER (resolution = 'external') AS "external"
      FROM ({CANDIDATE}) GROUP BY intent""",
    "finding_counters": STRUCTURAL + """SELECT 'disposition' AS axis, effective AS value, count(*) AS n FROM found GROUP BY effective
      UNION ALL SELECT 'attribution', attribution, count(*) FROM found GROUP BY attribution UNION ALL SELECT 'all', '', count(*) FROM found""",
    "structural_findings": STRUCTURAL + "SELECT document, target, kind, base_count, candidate_count, representative, attribution FROM found",
    "boundary_findings": f"""SELECT id, CASE resolution WHEN 'unsupported-semantics' THEN 'unsupported-reference-semantics' ELSE 'unsupported-target-kind' END AS kind
      FROM ({CANDIDATE}) WHERE resolution IN ('unsupported-semantics', 'unsupported-target')""",
    "exact_pairs": f"{_WITH} SELECT b.id, b.block AS b_block, b.resolution AS b_resolution, c.block AS c_block, c.resolution AS c_resolution FROM base b JOIN candidate c ON b.id = c.id",
    "impact_quadrant": f"""{_WITH}, p AS (
      SELECT b.resolution AS br, c.resolution AS cr, b.projection AS bp, c.projection AS cp, b.block <> c.block AS moved FROM base b JOIN candidate c ON b.id = c.id),
    t AS (SELECT moved, CASE WHEN br = 'resolved' AND cr = 'resolved' THEN CASE WHEN bp = cp THEN 'equal' ELSE 'changed' END
      WHEN br = cr AND br IN ('missing', 'type-mismatch') THEN 'equal' WHEN br IN ('missing', 'type-mismatch') AND cr = 'resolved' THEN 'newly-resolved'
      WHEN br = 'resolved' AND cr IN ('missing', 'type-mismatch') THEN 'became-missing' ELSE 'not-comparable' END AS target_change FROM p)
    SELECT target_change, CASE target_change WHEN 'equal' THEN CASE WHEN moved THEN 'subject-changed' ELSE 'none' END
      WHEN 'changed' THEN CASE WHEN moved THEN 'dependency-and-subject-cochanged' ELSE 'dependency-changed-subject-unchanged' END
      WHEN 'newly-resolved' THEN 'reference-resolved' ELSE 'not-applicable' END AS impact, count(*) AS n FROM t GROUP BY ALL""",
    "component_classes": f"""{_WITH}, l AS (SELECT construct % 2 AS k, target, document, 1 AS b, 0 AS c FROM base WHERE id NOT IN (SELECT id FROM candidate)
      UNION ALL SELECT construct % 2, target, document, 0, 1 FROM candidate WHERE id NOT IN (SELECT id FROM base)),
    g AS (SELECT sum(b) AS b, sum(c) AS c FROM l GROUP BY k, target, document)
    SELECT CASE WHEN c = 0 THEN 'removed' WHEN b = 0 THEN 'new' WHEN b = 1 AND c = 1 THEN 'candidate' ELSE 'ambiguous' END AS outcome,
      count(*) AS groups, CAST(sum(b) AS BIGINT) AS n_base, CAST(sum(c) AS BIGINT) AS n_candidate FROM g GROUP BY 1""",
    "removed_new_refs": f"""{_WITH} SELECT id, 'removed' AS change FROM base WHERE id NOT IN (SELECT id FROM candidate)
      UNION ALL SELECT id, 'new' FROM candidate WHERE id NOT IN (SELECT id FROM base)""",
    "raise_steps": STRUCTURAL + """SELECT kind, CASE kind WHEN 'explicit-target-missing' THEN '1:warn>fail' ELSE '0:warn>fail' END AS steps, 'fail' AS effective, count(*) AS n FROM found GROUP BY kind""",
    "introduced_demotion": STRUCTURAL + "SELECT attribution, CASE attribution WHEN 'pre-existing' THEN 'warn' ELSE 'fail' END AS demoted, count(*) AS n FROM found GROUP BY ALL",
    "feedback_items": FEEDBACK + "SELECT action, subject, kinds, members, disposition, note FROM items",
    "feedback_top10": FEEDBACK + """, w AS (SELECT *, CASE action WHEN 'existing' THEN 'existing' ELSE 'new' END AS "window" FROM items),
      p AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY CASE action WHEN 'fix' THEN 0 WHEN 'check' THEN 1 ELSE 2 END, subject, kinds) AS place,
        greatest(count(*) OVER (PARTITION BY "window") - 10, 0) AS overflow FROM w)
      SELECT "window", place, action, subject, kinds, members, overflow FROM p WHERE place <= 10""",
    "sarif_rows": _REPORTED + """SELECT finding_key, kind AS rule_id, dense_rank() OVER (ORDER BY kind) - 1 AS rule_index, 'error' AS level,
      replace(replace(subject, ' ', '%20'), '*', '%2A') AS uri, greatest(line, 1) AS start_line FROM reported""",
    "codequality_rows": _REPORTED + "SELECT finding_key AS fingerprint, kind AS check_name, 'major' AS severity, subject AS path, greatest(line, 1) AS line FROM reported",
    "debt_mint": _REPORTED + "SELECT finding_key, kind, fact AS accepted_fact FROM reported WHERE kind = 'explicit-target-missing' AND fact IS NOT NULL",
    "debt_mint_counts": _REPORTED + """SELECT count(*) FILTER (kind = 'explicit-target-missing' AND fact IS NOT NULL) AS minted, count(*) FILTER (kind <> 'explicit-target-missing') AS ineligible,
      count(*) FILTER (kind = 'explicit-target-missing' AND fact IS NULL) AS factless FROM reported""",
    "debt_pass": _DEBTS + f"""SELECT debt_id, finding_key, 'unused' AS outcome FROM matched WHERE NOT found
      UNION ALL SELECT debt_id, finding_key, 'debt-expired' FROM matched WHERE found AND expires_at <= {NOW}
      UNION ALL SELECT debt_id, finding_key, 'debt-worsened' FROM matched WHERE found AND fact IS DISTINCT FROM accepted_fact
      UNION ALL SELECT debt_id, finding_key, 'applies' FROM matched WHERE found AND expires_at > {NOW} AND fact IS NOT DISTINCT FROM accepted_fact""",
    "debt_reproduction": _DEBTS + """SELECT CASE WHEN NOT found THEN 'absent' WHEN fact IS NOT DISTINCT FROM accepted_fact THEN 'reproduced' ELSE 'different' END AS state, count(*) AS n
      FROM matched GROUP BY 1""",
    "waiver_defects": _REPORTED + f""", items AS (
      SELECT 'waiver-' || finding_key AS waiver_id, finding_key || CASE WHEN document % 18 = 0 THEN '?' ELSE '' END AS finding_key,
        CASE WHEN document % 30 = 0 THEN 'other' ELSE fact END AS authorized_fact, CASE WHEN document % 42 = 0 THEN 'old' ELSE 'tree' END AS candidate_tree,
        document % 5 AS owner, document % 7 AS issuer, document % 1500 AS not_before, document % 1500 + 600 AS expires_at FROM reported WHERE document % 6 = 0),
      m AS (SELECT i.*, r.kind, r.fact FROM items i LEFT JOIN reported r ON r.finding_key = i.finding_key),
      d AS (SELECT waiver_id, unnest(list_filter([
        CASE WHEN kind IS NULL THEN 'finding-absent' END, CASE WHEN kind IS NOT NULL AND fact IS DISTINCT FROM authorized_fact THEN 'fact-mismatch' END,
        CASE WHEN candidate_tree <> 'tree' THEN 'tree-mismatch' END, CASE WHEN not_before > {NOW} THEN 'not-yet-valid' END, CASE WHEN expires_at <= {NOW} THEN 'expired' END,
        CASE WHEN issuer > 3 THEN 'issuer-unauthorized' END, CASE WHEN owner = issuer THEN 'self-issued' END,
        CASE WHEN kind <> 'explicit-target-missing' THEN 'kind-not-waivable' END], lambda x: x IS NOT NULL)) AS defect,
        generate_subscripts(list_filter([
        CASE WHEN kind IS NULL THEN 'finding-absent' END, CASE WHEN kind IS NOT NULL AND fact IS DISTINCT FROM authorized_fact THEN 'fact-mismatch' END,
        CASE WHEN candidate_tree <> 'tree' THEN 'tree-mismatch' END, CASE WHEN not_before > {NOW} THEN 'not-yet-valid' END, CASE WHEN expires_at <= {NOW} THEN 'expired' END,
        CASE WHEN issuer > 3 THEN 'issuer-unauthorized' END, CASE WHEN owner = issuer THEN 'self-issued' END,
        CASE WHEN kind <> 'explicit-target-missing' THEN 'kind-not-waivable' END], lambda x: x IS NOT NULL), 1) - 1 AS position FROM m)
      SELECT waiver_id, CAST(position AS INTEGER) AS position, defect FROM d""",
    "exception_overlap": _REPORTED + """, e AS (SELECT CASE WHEN document % 20 = 0 THEN 'overlap' WHEN document % 5 = 0 THEN 'debt' WHEN document % 4 = 0 THEN 'waiver' ELSE 'none' END AS exception FROM reported)
      SELECT exception, CASE WHEN exception IN ('debt', 'waiver') THEN 'warn' ELSE 'fail' END AS final, count(*) AS n FROM e GROUP BY ALL""",
    "run_result": STRUCTURAL + "SELECT CASE WHEN bool_or(attribution <> 'resolved') THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN bool_or(attribution <> 'resolved') THEN 1 ELSE 0 END AS exit_code FROM found",
}
