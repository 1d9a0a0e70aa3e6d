"""Queries over W1 that resolve destinations by the whole chain, and identities of what they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.operators import chain, findings, identity
from snapweave.plans import workloads as W
from snapweave.plans.reference_queries import BASE, CANDIDATE, observed

#: Entries of the candidate side with what the chain asks of them, from names and whole texts.
FACTS = f"""
SELECT e.doc_id, e.path, e.mode, e.oid,
  CASE WHEN e.path LIKE '%.md' THEN 'markdown' WHEN e.path LIKE '%.mdx' THEN 'mdx' WHEN e.path LIKE '%.rst' THEN 'rst'
       WHEN e.path LIKE '%.adoc' THEN 'asciidoc' END AS adapter,
  e.path NOT LIKE '%.txt' AS is_document, contains(coalesce(d.text, ''), 'https://') AS transcludes, e.doc_id % 31 = 0 AS lfs,
  CAST(length(coalesce(d.text, '')) - length(replace(coalesce(d.text, ''), chr(10), '')) + 1 AS BIGINT) AS lines
FROM (SELECT * FROM ({W.ENTRIES}) AS both_sides WHERE side = 1) AS e JOIN {{documents}} AS d ON d.doc_id = e.doc_id
"""
#: Anchors of a document: its language and its number, as a renderer would name them.
ANCHORS = f"SELECT path AS target, 'part-' || CAST(doc_id % 7 AS STRING) AS anchor FROM ({FACTS}) AS f"
#: Each document with the path that the next one had in the base, which may have gone or moved since.
PAIRS = f"""
SELECT f.doc_id, f.path AS document, f.adapter, repeat('../', length(f.path) - length(replace(f.path, '/', ''))) AS up, n.path AS next
FROM ({FACTS}) AS f JOIN (SELECT doc_id, path FROM ({W.ENTRIES}) AS both_sides WHERE side = 0) AS n ON n.doc_id = f.doc_id + 1
"""
_SPELLINGS = [
    "up || next", "up || next || '#part-3'", "up || next || '#Part_3'", "up || upper(next)", "up || next || '?x=1'",
    "up || next || '#L2-L9'", "up || next || '#L' || CAST(doc_id AS STRING) || '00000'", "'//cdn.example/x.js'", "'/guide/start'",
    "'https://example.org/a b'", "'https://example.org/a'", "'#part-' || CAST(doc_id % 5 AS STRING)", "'#%ff'", "up || next || '#%zz'",
    "'a//b'", "up || '../' || next", "up || regexp_replace(next, '[^/]*$', '')", "up || regexp_replace(next, '[^/]*$', '') || '#x'",
    "up || 'build-out/gen.md'", "'{' || 'name' || '}/x.md'", "'intro'", "up || regexp_replace(next, '[.]md$', '')", "up || next || '/'",
    "'mailto:someone@example.org'", "'http:rest'", "up || 'a%2Fb.md'", "up || next || '#part%2D2'", "''",
]
_DESTINATION = "CASE k " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SPELLINGS)) + " END"
REFS = f"""
SELECT CAST(doc_id AS STRING) || ':' || CAST(k AS STRING) AS id, document, adapter, {_DESTINATION} AS destination
FROM (SELECT *, {{unnest}} AS k FROM ({PAIRS}) AS p) AS numbered
"""
_LAST = len(_SPELLINGS) - 1
IGNORED = "# generated\n/build-out/\n/cache/*.md\n/a/../b\n"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = W.frame(spark, sf_dir, PAIRS).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(_LAST))))
    return pairs.select(F.expr("doc_id || ':' || k").alias("id"), "document", "adapter", F.expr(_DESTINATION).alias("destination"), F.lit(False).alias("image"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = W.frame(spark, sf_dir, FACTS).drop("doc_id", "oid")
    rules = chain.declarations(spark.createDataFrame([(".gitignore", IGNORED)], "path string, text string"))
    return chain.resolve(_refs(spark, sf_dir), entries, W.frame(spark, sf_dir, ANCHORS), rules)


def resolution_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every destination of every document with its outcome."""
    return _resolved(spark, sf_dir)


def _pop(c: str, times: int = 8) -> str:
    for _ in range(times):
        c = rf"regexp_replace({c}, '(^|/)[^/.][^/]*/\.\./', '\1')"
    return c


_CHAIN = rf"""WITH facts AS ({W.duck(FACTS)}), anchors AS (SELECT DISTINCT * FROM ({W.duck(ANCHORS)})),
refs AS ({W.duck(REFS.replace("{unnest}", f"unnest(generate_series(0, {_LAST}))").replace("{{", "{").replace("}}", "}").replace("{name}", "<name>")).replace("<name>", "{name}")}),
cut AS (SELECT *, split_part(destination, '#', 1) AS head, CASE WHEN contains(destination, '#') THEN substr(destination, instr(destination, '#') + 1) END AS fragment FROM refs),
parts AS (SELECT *, split_part(head, '?', 1) AS asked, contains(head, '?') AS has_query, regexp_matches(destination, '^[A-Za-z][A-Za-z0-9+.-]*:') AS has_scheme,
  contains(regexp_replace(fragment, '%[0-9A-Fa-f][0-9A-Fa-f]', '', 'g'), '%') OR regexp_matches(lower(fragment), '%(f[5-9a-f]|c[01]|[01][0-9a-f]|7f)') AS bad FROM cut),
early AS (SELECT *, CASE WHEN bad THEN NULL ELSE url_decode(fragment) END AS anchor,
  regexp_replace({_pop("regexp_replace(document, '[^/]*$', '') || rtrim(asked, '/')")}, '/$', '') AS joined,
  CASE WHEN adapter = 'asciidoc' AND regexp_matches(destination, '\{{[A-Za-z0-9_-]+\}}') THEN 'unsupported-semantics|attribute-dependent'
    WHEN bad THEN 'invalid|fragment-encoding' WHEN starts_with(asked, '//') THEN 'unsupported-semantics|network-path'
    WHEN has_scheme AND (contains(destination, ' ') OR starts_with(destination, 'http') AND NOT contains(destination, '://')) THEN 'invalid|uri'
    WHEN has_scheme THEN 'external|url' WHEN starts_with(asked, '/') THEN 'unsupported-semantics|site-route'
    WHEN adapter = 'asciidoc' AND asked <> '' AND NOT ends_with(asked, '/') AND NOT contains(split_part(asked, '/', -1), '.') THEN 'unsupported-semantics|attribute-dependent'
    WHEN asked = '' THEN NULL WHEN contains(asked, '//') THEN 'invalid|syntax' WHEN contains(lower(asked), '%2f') THEN 'invalid|encoded-slash'
    WHEN starts_with({_pop("regexp_replace(document, '[^/]*$', '') || asked")}, '../') THEN 'invalid|path-traversal' END AS early FROM parts),
dirs AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS dir FROM (SELECT path, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS n FROM facts)),
ours AS (SELECT *, CASE WHEN asked = '' THEN document ELSE joined END AS named, ends_with(asked, '/') AS tree FROM early WHERE early IS NULL),
routed AS (SELECT ours.*, CASE WHEN f.path IS NULL AND d.dir IS NULL AND NOT tree AND r.path IS NOT NULL THEN r.path ELSE named END AS target
  FROM ours LEFT JOIN facts f ON f.path = named LEFT JOIN dirs d ON d.dir = named LEFT JOIN facts r ON r.path = named || '.md' AND r.mode = '100644'
    AND NOT regexp_matches(named, '[.](md|markdown|html)$')),
folded AS (SELECT lower(path) AS low, min(path) AS near FROM facts GROUP BY 1 HAVING count(*) = 1),
typed AS (SELECT target, replace(lower(anchor), '_', '-') AS low, min(anchor) AS near FROM anchors GROUP BY ALL HAVING count(*) = 1),
found AS (SELECT routed.*, coalesce(f.mode, CASE WHEN d.dir IS NOT NULL THEN 'dir' END) AS mode, f.adapter AS has, f.is_document, f.lines, f.lfs, f.transcludes,
    a.anchor IS NOT NULL AS known, w.near AS near_path, y.near AS near_anchor, regexp_matches(routed.anchor, '^L[1-9][0-9]*(-L[1-9][0-9]*)?$') AS ranged,
    try_cast(regexp_extract(routed.anchor, '([0-9]+)$', 1) AS BIGINT) AS last
  FROM routed LEFT JOIN facts f ON f.path = routed.target LEFT JOIN dirs d ON d.dir = routed.target LEFT JOIN folded w ON w.low = lower(routed.target)
    LEFT JOIN anchors a ON a.target = routed.target AND a.anchor = routed.anchor
    LEFT JOIN typed y ON y.target = routed.target AND y.low = replace(lower(routed.anchor), '_', '-')),
late AS (SELECT *, CASE WHEN mode IS NULL AND starts_with(target, 'build-out/') THEN 'declared-untracked|.gitignore' WHEN mode IS NULL THEN 'missing|path-not-found'
    WHEN mode = '120000' THEN 'unsupported-target|symlink' WHEN tree AND mode <> 'dir' THEN 'type-mismatch|tree'
    WHEN has_query AND (mode = 'dir' OR has IS NULL) THEN 'unsupported-semantics|query' WHEN coalesce(anchor, '') = '' THEN 'resolved|'
    WHEN mode = 'dir' OR ranged AND lfs THEN 'unsupported-semantics|code-fragment' WHEN ranged AND last > lines THEN 'missing|line-fragment-out-of-range'
    WHEN ranged THEN 'resolved|lines' WHEN NOT is_document THEN 'unsupported-semantics|code-fragment' WHEN has IS NULL THEN 'unsupported-semantics|fragment'
    WHEN known THEN 'resolved|' WHEN transcludes THEN 'unsupported-semantics|fragment' ELSE 'missing|heading-anchor-not-found' END AS late FROM found),
outcomes AS (SELECT id, early AS o, NULL AS target, NULL AS near FROM early WHERE early IS NOT NULL
  UNION ALL SELECT id, late, target, CASE late WHEN 'missing|path-not-found' THEN near_path WHEN 'missing|heading-anchor-not-found' THEN near_anchor END FROM late)
"""


def chain_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each condition of the chain decides."""
    return _resolved(spark, sf_dir).groupBy("resolution", "reason").agg(F.count("*").alias("n"))


def target_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every entry, as a whole and by its lines, in an own domain each."""
    entries = W.frame(spark, sf_dir, FACTS)
    return entries.select(
        "path", identity.target_projection(F.col("mode"), F.col("oid")).alias("whole"),
        identity.target_projection(F.col("mode"), F.col("oid"), lines=True).alias("lines"),
    )


def _broken(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = observed(spark, sf_dir, side).filter(F.col("resolution").isin(*findings.STRUCTURAL))
    return rows.withColumns({
        "document": F.col("document").cast("string"), "construct": F.col("construct").cast("string"), "block_digest": F.col("block").cast("string"),
        "fragment": none, "query": none, "target_kind": F.lit("blob"), "destination": F.col("target"),
    })


def fact_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each structural finding by its key digest, attributed by whether its fact is the same on both sides."""
    kind = findings.lookup(F.col("resolution"), findings.STRUCTURAL)
    return identity.fact_attribution(*[identity.structural_facts(_broken(spark, sf_dir, side), kind) for side in (0, 1)])


def _fact_sql(name: str) -> str:
    scope = """'"scope":{"document":"' || document || '","fragment_digest":null,"query_digest":null,"repository_path":"' || target
      || '","source_construct":"' || construct || '","source_projection_digest":"' || block || '","target_kind":"blob"}'"""
    kind = "CASE resolution WHEN 'missing' THEN 'explicit-target-missing' ELSE 'explicit-target-type-mismatch' END"
    key = f"""{_sha('finding-key')} || ('{{"finding_kind":"' || {kind} || '",' || {scope} || '}}')::BLOB)"""
    fact = f"""{_sha('fact')} || ('{{"key":"' || k || '","multiplicity":' || n || ',"resolution":"' || resolution || '"}}')::BLOB)"""
    return f"""SELECT k, {fact} AS fact FROM (
      SELECT {key} AS k, resolution, count(*) AS n FROM {name} WHERE resolution IN ('missing', 'type-mismatch') GROUP BY ALL)"""


def _sha(domain: str) -> str:
    return f"sha256('snapweave/{domain}'::BLOB || '\\x00'::BLOB"


_P = """sha256('snapweave/{}'::BLOB || '\\x00'::BLOB || ('{{"git_mode":"' || mode || '","raw_digest":"' || oid || '"}}')::BLOB)"""
_SPLIT = "split_part(o, '|', 1) AS resolution, nullif(split_part(o, '|', 2), '') AS reason"
QUERIES = (resolution_chain, chain_outcomes, target_projections, fact_attributions)
ORACLE_SQL = {
    "resolution_chain": f"{_CHAIN} SELECT id, {_SPLIT}, target, near FROM outcomes",
    "chain_outcomes": f"{_CHAIN} SELECT {_SPLIT}, count(*) AS n FROM outcomes GROUP BY ALL",
    "target_projections": f"WITH facts AS ({W.duck(FACTS)}) SELECT path, {_P.format('target-projection')} AS whole, {_P.format('target-line-projection')} AS lines FROM facts",
    "fact_attributions": f"""WITH base AS ({BASE}), candidate AS ({CANDIDATE}), b AS ({_fact_sql("base")}), c AS ({_fact_sql("candidate")})
SELECT coalesce(b.k, c.k) AS finding_key, CASE WHEN b.k IS NULL THEN 'introduced' WHEN c.k IS NULL THEN 'resolved'
  WHEN b.fact = c.fact THEN 'pre-existing' ELSE 'unknown' END AS attribution FROM b FULL JOIN c ON b.k = c.k""",
}
