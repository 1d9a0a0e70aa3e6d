"""Queries over documents, pages, deliveries and external destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.functions import anchors, forge, grammar, paths, scalars
from snapweave.operators import correlation, deliveries, external, feedback, findings, policy, resolution, text
from snapweave.plans import workloads as W
from snapweave.sources import strict_json

ENTRIES = W.duck(W.ENTRIES)
QUERIES = []
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES.append(f)
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return keep


def entries(spark: SparkSession, sf_dir: str, side: int | None = None) -> DataFrame:
    e = W.frame(spark, sf_dir, W.ENTRIES)
    return e if side is None else e.filter(F.col("side") == side)


_CLASS = """CASE WHEN path LIKE '%.md' THEN 'structured-markdown' WHEN path LIKE '%.mdx' THEN 'structured-mdx' WHEN path LIKE '%.adoc' THEN 'structured-asciidoc'
  WHEN path LIKE '%.rst' THEN 'structured-rst' WHEN path LIKE '%.org' THEN 'unparsed-markup' WHEN path LIKE '%/README' THEN 'extensionless-markdown' END"""
_ADAPTER = """CASE WHEN path LIKE '%.md' OR path LIKE '%/README' THEN 'markdown' WHEN path LIKE '%.mdx' THEN 'mdx' WHEN path LIKE '%.adoc' THEN 'asciidoc' WHEN path LIKE '%.rst' THEN 'rst' END"""


@query(f"SELECT side, path, {_CLASS} AS classification, {_ADAPTER} AS adapter FROM ({ENTRIES})")
def classify_paths(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("classification", paths.classify(F.col("path")))
    return e.select("side", "path", "classification", paths.adapter(F.col("classification")).alias("adapter"))


@query(f"SELECT side, contains('/' || path, '/vendor/') AS excluded, count(*) AS n FROM ({ENTRIES}) GROUP BY ALL")
def excluded_components(spark, sf_dir):
    return entries(spark, sf_dir).groupBy("side", paths.excluded(F.col("path")).alias("excluded")).agg(F.count("*").alias("n"))


_ODD = "CASE doc_id % 6 WHEN 0 THEN path WHEN 1 THEN '/' || path WHEN 2 THEN replace(path, '/', '//') WHEN 3 THEN './' || path WHEN 4 THEN replace(path, '/', '\\\\') ELSE path || '/..' END"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'path-grammar' END AS refused FROM ({ENTRIES}) WHERE side = 0""")
def path_admission(spark, sf_dir):
    e = entries(spark, sf_dir, 0).withColumn("odd", F.expr(_ODD))
    return e.select("doc_id", paths.admission(F.col("odd")).alias("refused"))


_UP = f"""SELECT doc_id, len(p) - k AS depth, array_to_string(p[1:k], '/') AS ancestor
  FROM (SELECT doc_id, string_split(path, '/') AS p FROM ({ENTRIES}) WHERE side = 1), unnest(range(0, len(p))) AS x(k)"""


@query(f"SELECT doc_id, CAST(depth AS INTEGER) AS depth, ancestor FROM ({_UP})")
def ancestor_rows(spark, sf_dir):
    e = entries(spark, sf_dir, 1).select("doc_id", F.posexplode(paths.ancestors(F.col("path"))).alias("depth", "ancestor"))
    return e.select("doc_id", (F.col("depth") + 1).alias("depth"), "ancestor")


@query(f"SELECT DISTINCT ancestor AS path FROM ({_UP})")
def implied_directories(spark, sf_dir):
    return resolution.directories(entries(spark, sf_dir, 1))


@query(f"""SELECT doc_id, min(arg) AS served FROM (
  SELECT doc_id, replace(path, '.md', '.md') AS arg FROM ({ENTRIES}) WHERE side = 1 AND mode = '100644' AND path LIKE '%.md') GROUP BY doc_id""")
def router_fallback(spark, sf_dir):
    e = entries(spark, sf_dir, 1)
    asked = F.when(F.col("doc_id") % 2 == 0, F.replace("path", F.lit(".md"), F.lit(".html"))).otherwise(F.replace("path", F.lit(".md"), F.lit("")))
    refs = e.filter(F.col("path").endswith(".md")).select(F.col("doc_id").alias("id"), asked.alias("target"))
    return resolution.first_candidate(refs, e).withColumnRenamed("id", "doc_id")


@query(f"""WITH e AS (SELECT doc_id, path, source, lang FROM ({ENTRIES}) JOIN documents USING (doc_id) WHERE side = 1)
  SELECT doc_id, CASE WHEN path LIKE 'moved/%' THEN 'moved' WHEN path LIKE 'vendor/%' THEN 'root' WHEN path LIKE 'src1/en/%' THEN 'deep' WHEN path LIKE 'src1/%' THEN 'top' ELSE 'root' END AS rule FROM e""")
def nearest_policy(spark, sf_dir):
    rules = spark.createDataFrame([("", "root"), ("src1", "top"), ("src1/en", "deep"), ("moved", "moved")], "at string, rule string")
    return resolution.nearest_rule(entries(spark, sf_dir, 1), rules).select("doc_id", "rule")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""WITH e AS (SELECT path FROM ({ENTRIES}) WHERE side = 1 UNION ALL SELECT upper(path) FROM ({ENTRIES}) WHERE side = 1 AND doc_id % 4 = 0),
  n AS (SELECT {_LOWER.format("path")} AS k, min(path) AS near FROM e GROUP BY 1 HAVING count(*) = 1)
  SELECT doc_id, near FROM (SELECT doc_id, 'D' || substring(path, 2) AS target FROM ({ENTRIES}) WHERE side = 1) LEFT JOIN n ON k = {_LOWER.format("target")}""")
def case_neighbour(spark, sf_dir):
    e = entries(spark, sf_dir, 1)
    all_ = e.select("path").unionAll(e.filter("doc_id % 4 = 0").select(F.upper("path").alias("path")))
    asked = e.select("doc_id", F.concat(F.lit("D"), F.col("path").substr(F.lit(2), F.length("path"))).alias("target"))
    return resolution.case_neighbour(asked, all_).select("doc_id", "near")


@query(f"""WITH l AS (SELECT lower(left(oid, 3)) AS label, path FROM ({ENTRIES}) WHERE side = 1),
  g AS (SELECT label, count(*) AS found, CASE WHEN count(*) = 1 THEN min(path) END AS path FROM l GROUP BY label),
  k AS (SELECT DISTINCT lower(left(oid, 3)) AS label FROM ({ENTRIES}) WHERE side = 0)
  SELECT label, coalesce(found, 0) AS found, path FROM k LEFT JOIN g USING (label)""")
def label_table(spark, sf_dir):
    label = lambda side: entries(spark, sf_dir, side).select(scalars.normalized_label(F.substring("oid", 1, 3)).alias("label"), "path")
    return resolution.unique_or_null(label(0).select("label").distinct(), label(1), ["label"], "path")


_PAIRED = f"""WITH b AS (SELECT * FROM ({ENTRIES}) WHERE side = 0), c AS (SELECT * FROM ({ENTRIES}) WHERE side = 1),
  paired AS (SELECT coalesce(b.path, c.path) AS path, b.path IS NOT NULL AS in_b, c.path IS NOT NULL AS in_c, b.bytes AS b_bytes, c.bytes AS c_bytes,
    CASE WHEN b.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN b.mode = c.mode AND b.oid = c.oid THEN 'unchanged' ELSE 'changed' END AS change
    FROM b FULL JOIN c ON b.path = c.path)"""


def _paired(spark, sf_dir):
    p = correlation.pair_documents(entries(spark, sf_dir, 0), entries(spark, sf_dir, 1))
    return p.withColumns({"adapter": paths.adapter(paths.classify(F.col("path"))), "excluded": paths.excluded(F.col("path"))})


@query(f"{_PAIRED} SELECT path, change FROM paired")
def document_pairing(spark, sf_dir):
    return _paired(spark, sf_dir).select("path", "change")


@query(f"""{_PAIRED} SELECT count(*) AS documents, count(*) FILTER (in_b) AS base, count(*) FILTER (in_c) AS candidate,
  count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'unchanged') AS unchanged,
  count(*) FILTER (in_c AND {_ADAPTER} IS NOT NULL AND NOT contains('/' || path, '/vendor/')) AS scanned, count(*) FILTER (in_c AND contains('/' || path, '/vendor/')) AS excluded,
  count(*) FILTER (in_c AND {_ADAPTER} IS NULL AND NOT contains('/' || path, '/vendor/')) AS unsupported,
  CAST(coalesce(sum(b_bytes), 0) AS BIGINT) AS base_bytes, CAST(coalesce(sum(c_bytes), 0) AS BIGINT) AS candidate_bytes FROM paired""")
def document_counters(spark, sf_dir):
    return feedback.document_counters(_paired(spark, sf_dir))


@query(f"""{_PAIRED} SELECT path, 'document-removed' AS kind FROM paired WHERE NOT in_c
  UNION ALL SELECT path, 'unsupported-document-format' FROM paired WHERE in_c AND {_ADAPTER} IS NULL
  UNION ALL SELECT path, 'opaque-mdx-region' FROM paired WHERE in_c AND {_ADAPTER} = 'mdx'
  UNION ALL SELECT path, 'unlinked-document' FROM paired WHERE in_c AND {_ADAPTER} IS NOT NULL""")
def document_findings(spark, sf_dir):
    p = _paired(spark, sf_dir).withColumns({"references": F.lit(0), "mdx_bytes": F.when(F.col("adapter") == "mdx", 1).otherwise(0), "html_bytes": F.lit(0)})
    return findings.document_findings(p)


@query(f"""WITH b AS (SELECT * FROM ({ENTRIES}) WHERE side = 0), c AS (SELECT * FROM ({ENTRIES}) WHERE side = 1),
  g AS (SELECT mode, oid, min(path) AS removed FROM b WHERE path NOT IN (SELECT path FROM c) GROUP BY mode, oid HAVING count(*) = 1),
  n AS (SELECT mode, oid, min(path) AS added FROM c WHERE path NOT IN (SELECT path FROM b) GROUP BY mode, oid HAVING count(*) = 1)
  SELECT removed, added FROM g JOIN n USING (mode, oid)""")
def exact_renames(spark, sf_dir):
    return correlation.renames(entries(spark, sf_dir, 0), entries(spark, sf_dir, 1))


_POLICY = f"""SELECT 'include' AS section, path AS key, CASE WHEN side = 1 AND doc_id % 5 = 0 THEN 'rst' ELSE 'markdown' END AS value, side FROM ({ENTRIES})"""


@query(f"""WITH p AS ({_POLICY}), b AS (SELECT * FROM p WHERE side = 0), c AS (SELECT * FROM p WHERE side = 1)
  SELECT 'include' AS section, b.key, CASE WHEN c.key IS NULL THEN 'removed' ELSE 'rebound' END AS reason FROM b LEFT JOIN c ON b.key = c.key WHERE c.key IS NULL OR b.value <> c.value
  UNION ALL VALUES ('disposition', 'claim-broken', 'weakened'), ('disposition', 'invalid-reference', 'removed')""")
def policy_weakening(spark, sf_dir):
    e = entries(spark, sf_dir).select("side", F.lit("include").alias("section"), F.col("path").alias("key"), F.when((F.col("side") == 1) & (F.col("doc_id") % 5 == 0), "rst").otherwise("markdown").alias("value"))
    fixed = spark.createDataFrame(
        [(0, "disposition", "claim-broken", "fail"), (1, "disposition", "claim-broken", "warn"), (0, "disposition", "invalid-reference", "warn"), (0, "disposition", "subject-changed", "record"), (1, "disposition", "subject-changed", "fail")],
        "side int, section string, key string, value string",
    )
    p = e.unionByName(fixed)
    return policy.weakened(p.filter("side = 0"), p.filter("side = 1"))


@query(f"""WITH i AS (SELECT DISTINCT path FROM ({ENTRIES}) WHERE doc_id % 3 = 0), c AS (SELECT path, doc_id FROM ({ENTRIES}) WHERE side = 1)
  SELECT i.path, CASE WHEN c.path IS NULL THEN 'missing' WHEN c.doc_id % 4 = 0 THEN 'outside' WHEN {_ADAPTER.replace("path", "i.path")} IS NULL THEN 'unsupported' ELSE 'scanned' END AS state FROM i LEFT JOIN c ON i.path = c.path""")
def coverage_state(spark, sf_dir):
    c = entries(spark, sf_dir, 1)
    docs = c.filter("doc_id % 4 <> 0").withColumn("adapter", paths.adapter(paths.classify(F.col("path"))))
    return policy.coverage(entries(spark, sf_dir).filter("doc_id % 3 = 0"), docs, c)


@query(f"""WITH i AS (SELECT DISTINCT path FROM ({ENTRIES}) WHERE doc_id % 7 = 0),
  s AS (SELECT side, path, CASE WHEN mode = '100644' THEN mode || ':' || oid ELSE 'unsupported' END AS state FROM ({ENTRIES})),
  j AS (SELECT i.path, coalesce(b.state, 'absent') AS base_state, coalesce(c.state, 'absent') AS candidate_state FROM i LEFT JOIN s b ON b.path = i.path AND b.side = 0 LEFT JOIN s c ON c.path = i.path AND c.side = 1)
  SELECT * FROM j WHERE base_state <> candidate_state OR base_state IN ('absent', 'unsupported')""")
def control_plane_changes(spark, sf_dir):
    return policy.control_changes(entries(spark, sf_dir).filter("doc_id % 7 = 0"), entries(spark, sf_dir, 0), entries(spark, sf_dir, 1))


@query(f"""SELECT path, 'document' AS kind, CASE WHEN max(side) = 1 THEN CASE WHEN max(doc_id) FILTER (side = 1) % 5 = 0 THEN 'rst' ELSE 'markdown' END ELSE 'base' END AS adapter FROM ({ENTRIES}) GROUP BY path""")
def include_union(spark, sf_dir):
    kind = F.lit("document").alias("kind")
    c = entries(spark, sf_dir, 1).select("path", kind, F.when(F.col("doc_id") % 5 == 0, "rst").otherwise("markdown").alias("adapter"))
    return policy.include_union(entries(spark, sf_dir, 0).select("path", kind, F.lit("base").alias("adapter")), c)


@query(f"""WITH e AS (SELECT DISTINCT path, CASE WHEN doc_id % 2 = 0 THEN 'too-large' ELSE 'unreadable' END AS code FROM ({ENTRIES}) WHERE doc_id % 3 = 0),
  r AS (SELECT *, row_number() OVER (ORDER BY path, code) AS n, count(*) OVER () AS total FROM e)
  SELECT path, code FROM r WHERE n <= CASE WHEN total > 20 THEN 19 ELSE 20 END UNION ALL SELECT NULL, 'too-many-errors' FROM (SELECT max(total) AS t FROM r) WHERE t > 20""")
def error_cap(spark, sf_dir):
    e = entries(spark, sf_dir).filter("doc_id % 3 = 0").select("path", F.when(F.col("doc_id") % 2 == 0, "too-large").otherwise("unreadable").alias("code"))
    return findings.capped_errors(e, 20)


_LIMIT = 200_000


@query(f"""WITH r AS (SELECT side, path, bytes, CAST(sum(bytes) OVER (PARTITION BY side ORDER BY path) AS BIGINT) AS total FROM ({ENTRIES}))
  SELECT side, path, CAST(total - bytes AS BIGINT) AS before, bytes AS crossing FROM r WHERE total > {_LIMIT} AND total - bytes <= {_LIMIT}""")
def budget_crossing(spark, sf_dir):
    return deliveries.budget_crossing(entries(spark, sf_dir), "side", "path", "bytes", _LIMIT)


@query("SELECT resource, CASE resource WHEN 'documents' THEN 500 WHEN 'bytes' THEN 1000 ELSE 64 END AS \"limit\" FROM (VALUES ('documents'), ('bytes'), ('depth')) AS v(resource)")
def limit_tightening(spark, sf_dir):
    d = spark.createDataFrame([("documents", 1000), ("bytes", 1000), ("depth", 64)], "resource string, limit int")
    return policy.tightened(d, spark.createDataFrame([("documents", 500), ("documents", 700), ("bytes", 5000)], "resource string, maximum int"))


# destinations and scalars


@query(r"""SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS path, CASE WHEN contains(split_part(url, '#', 1), '?') THEN regexp_extract(url, '^[^?#]*\?([^#]*)', 1) END AS query,
  CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS fragment FROM pages""")
def split_destination(spark, sf_dir):
    p, q, f = scalars.split_destination(F.col("url"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", p.alias("path"), q.alias("query"), f.alias("fragment"))


@query("SELECT split_part(url, ':', 1) AS scheme, count(*) AS n, count(*) FILTER (regexp_matches(url, '^[A-Za-z0-9._~:/?#@!$&''()*+,;=%-]*$')) AS valid FROM pages WHERE url IS NOT NULL GROUP BY 1")
def scheme_of(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("url is not null")
    return p.groupBy(scalars.scheme_of(F.col("url")).alias("scheme")).agg(F.count("*").alias("n"), F.count_if(scalars.uri_valid(F.col("url"))).alias("valid"))


_FRAGMENT = "CASE doc_id % 5 WHEN 0 THEN 'L' || CAST(doc_id AS STRING) WHEN 1 THEN 'L' || CAST(doc_id AS STRING) || '-L' || CAST(doc_id + 3 AS STRING) WHEN 2 THEN 'L0' WHEN 3 THEN 'L9-L3' ELSE 'intro' END"


@query("SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) AND doc_id > 0 THEN doc_id END AS first_line, CASE WHEN doc_id % 5 = 0 AND doc_id > 0 THEN doc_id WHEN doc_id % 5 = 1 THEN doc_id + 3 END AS last_line FROM documents")
def line_fragment(spark, sf_dir):
    a, b = scalars.line_fragment(F.col("f"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(_FRAGMENT).alias("f"))
    return d.select("doc_id", a.alias("first_line"), b.alias("last_line"))


_FORGE = {
    "github": ("CASE doc_id % 5 WHEN 0 THEN 'Acme/docs/blob/main/' WHEN 1 THEN 'acme/Docs/tree/release/v1/' WHEN 2 THEN 'acme/docs/blob/other/' WHEN 3 THEN 'acme/docs/raw/main/' ELSE 'acme/x/blob/main/' END", ("blob", "tree", "blob")),
    "gitlab": ("CASE doc_id % 5 WHEN 0 THEN 'Acme/docs/-/blob/main/' WHEN 1 THEN 'acme/Docs/-/tree/release/v1/' WHEN 2 THEN 'acme/docs/-/blob/other/' WHEN 3 THEN 'acme/docs/-/raw/main/' ELSE 'acme/docs/blob/main/' END", ("blob", "tree", "blob")),
    "gitea": ("CASE doc_id % 5 WHEN 0 THEN 'Acme/docs/src/branch/main/' WHEN 1 THEN 'acme/Docs/src/branch/release/v1/' WHEN 2 THEN 'acme/docs/src/tag/v1/' WHEN 3 THEN 'acme/docs/src/main/' ELSE 'acme/x/src/branch/main/' END", ("either", "either", "either")),
}


def _forge_oracle(name: str) -> str:
    k = _FORGE[name][1]
    return f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'default' WHEN 2 THEN 'unknown-ref' ELSE 'foreign' END AS route,
      CASE doc_id % 5 WHEN 0 THEN '{k[0]}' WHEN 1 THEN '{k[1]}' WHEN 2 THEN '{k[2]}' END AS kind, CASE WHEN doc_id % 5 < 2 THEN 'd/' || CAST(doc_id AS STRING) || '.md' END AS path FROM documents"""


def _forge(spark, sf_dir, name):
    suffix = F.concat(F.expr(_FORGE[name][0]), F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", suffix.alias("suffix"))
    return d.select("doc_id", getattr(forge, name)(F.col("suffix"), "acme", "docs", ("main", "release/v1")).alias("r")).select("doc_id", "r.*")


@query(_forge_oracle("github"))
def forge_github(spark, sf_dir):
    return _forge(spark, sf_dir, "github")


@query(_forge_oracle("gitlab"))
def forge_gitlab(spark, sf_dir):
    return _forge(spark, sf_dir, "gitlab")


@query(_forge_oracle("gitea"))
def forge_gitea(spark, sf_dir):
    return _forge(spark, sf_dir, "gitea")


@query(r"""SELECT page_id, CASE WHEN url LIKE 'https://%' THEN regexp_extract(regexp_extract(url, '^https://[^/]*/([^?#]*)', 1), '^([^/]+/[^/]+)', 1) END AS shape FROM pages
  WHERE regexp_matches(url, '^https://[^/?#]+/[^/?#]+/[^/?#]+') OR url NOT LIKE 'https://%'""")
def repository_shape(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").filter(r"url rlike '^https://[^/?#]+/[^/?#]+/[^/?#]+' or url not like 'https://%'")
    known = F.regexp_replace("url", r"^https://[^/?#]*", "https://forge.example")
    return p.select("page_id", forge.repository_shape(known, {"forge.example": "github"}).alias("shape"))


@query(r"""SELECT page_id, CASE WHEN contains(split_part(url, '#', 1), '?') THEN sha256('query' || chr(0) || regexp_extract(url, '^[^?#]*\?([^#]*)', 1)) END AS query_digest,
  CASE WHEN contains(url, '#') THEN sha256('fragment' || chr(0) || regexp_extract(url, '#(.*)$', 1)) END AS fragment_digest FROM pages""")
def query_fragment_digest(spark, sf_dir):
    _, q, f = scalars.split_destination(F.col("url"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", scalars.optional_digest("query", q).alias("query_digest"), scalars.optional_digest("fragment", f).alias("fragment_digest"))


@query("SELECT doc_id, sha256('snapweave/text' || chr(0) || text) AS digest FROM documents")
def domain_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", scalars.domain_hash("snapweave/text", F.col("text")).alias("digest"))


@query("""SELECT event_id, strftime(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS instant, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events""")
def utc_instants(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", scalars.instant_text(F.unix_timestamp("ts")).alias("instant"))
    return e.withColumn("seconds", scalars.utc_instant(F.col("instant")))


@query("SELECT event_id, least(3600, 5 * CAST(pow(2, least(event_id % 30, 16)) AS BIGINT)) AS delay FROM events")
def backoff(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", scalars.backoff(F.col("event_id") % 30 + 1, 5, 3600).alias("delay"))


# text


_LINES = "SELECT doc_id, unnest(generate_series(1, len(l))) AS number, unnest(l) AS line FROM (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[1:-2] ELSE p END AS l FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)) AS p FROM documents))"


@query(f"SELECT doc_id, CAST(number AS INTEGER) AS number, md5(line) AS digest FROM ({_LINES})")
def line_table(spark, sf_dir):
    return text.lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").select("doc_id", "number", F.md5(F.col("line").cast("binary")).alias("digest"))


@query(f"""WITH l AS (SELECT doc_id, number, regexp_matches(line, '^[ \t]*$') AS blank FROM ({_LINES})),
  s AS (SELECT doc_id, NOT blank AND coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY number), true) AS starts FROM l) SELECT doc_id, count(*) FILTER (starts) AS runs FROM s GROUP BY doc_id""")
def nonblank_runs(spark, sf_dir):
    return text.nonblank_runs(text.lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"), "doc_id")


_CLEAN = r"regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<textarea\b[^>]*>.*?</textarea\s*>|<title\b[^>]*>.*?</title\s*>', '', 'g')"
_HREF = "(?is)<(?:a\\b[^>]*?\\shref|img\\b[^>]*?\\ssrc)\\s*=\\s*\"([^\"]*)\""
_TEXT = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"


@query(f"""SELECT page_id, CAST(p - 1 AS INTEGER) AS position, {_TEXT.format("raw")} AS destination FROM (
  SELECT page_id, unnest(r) AS raw, generate_subscripts(r, 1) AS p FROM (SELECT page_id, regexp_extract_all({_CLEAN}, '{_HREF}', 1) AS r FROM pages))""")
def html_hrefs(spark, sf_dir):
    return text.hrefs(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")


@query(f"""SELECT target, count(*) AS n FROM (SELECT regexp_extract(d, '^([^?#]*)', 1) AS target FROM (SELECT {_TEXT.format("unnest(regexp_extract_all(" + _CLEAN + ", '" + _HREF + "', 1))")} AS d FROM pages)) WHERE target LIKE '/%' GROUP BY target""")
def site_links(spark, sf_dir):
    h = text.hrefs(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")
    return h.select(scalars.split_destination(F.col("destination"))[0].alias("target")).filter(F.col("target").startswith("/")).groupBy("target").agg(F.count("*").alias("n"))


_H = r"regexp_extract_all(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]\s*>)', 1)"


@query(f"""SELECT page_id, CAST(p - 1 AS INTEGER) AS position, CAST(regexp_extract(raw, '^<[hH]([1-6])', 1) AS INTEGER) AS level, trim({_TEXT.format("regexp_replace(raw, '<[^>]*>', '', 'g')")}) AS heading FROM (
  SELECT page_id, unnest(r) AS raw, generate_subscripts(r, 1) AS p FROM (SELECT page_id, {_H} AS r FROM pages))""")
def html_headings(spark, sf_dir):
    return text.headings(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")


_SPANS = "SELECT l_orderkey AS document, CAST(l_quantity AS BIGINT) * 3 AS start, CAST(l_quantity AS BIGINT) * 3 + l_linenumber * 2 AS \"end\" FROM lineitem"


def _spans(spark, sf_dir):
    # DuckDB's cast rounds halves to even
    same = _SPANS.replace('"end"', "`end`").replace("lineitem", "{lineitem}").replace("CAST(l_quantity", "CAST(rint(l_quantity)")
    return spark.sql(same, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@query(f"""WITH s AS ({_SPANS}), m AS (SELECT *, max("end") OVER (PARTITION BY document ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY document ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
  SELECT document, min(start) AS start, max("end") AS "end" FROM i GROUP BY document, island""")
def interval_union(spark, sf_dir):
    return text.merged_spans(_spans(spark, sf_dir), "document")


@query(f"""WITH s AS ({_SPANS}) SELECT DISTINCT document FROM (SELECT document, start, lag("end") OVER (PARTITION BY document ORDER BY start, "end") AS last FROM s) WHERE last > start""")
def span_overlap(spark, sf_dir):
    return text.overlapping(_spans(spark, sf_dir), "document")


@query("""SELECT document, label, "order" FROM (SELECT *, row_number() OVER (PARTITION BY document, label ORDER BY price, "order") AS n FROM (
  SELECT o_custkey AS document, o_orderpriority AS label, o_totalprice AS price, o_orderkey AS "order" FROM orders)) WHERE n = 1""")
def definition_first_wins(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("document"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("order"))
    return resolution.first_definition(o, ["document", "label"], ["price", "order"]).select("document", "label", "order")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text ELSE 'X' || substring(text, 4) END AS text, doc_id % 7 <> 0 AS applied FROM documents WHERE length(text) > 10")
def apply_fixes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) > 10")
    one = d.select("doc_id", F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("X").alias("replacement"))
    two = d.filter("doc_id % 7 = 0").select("doc_id", F.lit(2), F.lit(4), F.lit("Y"))
    return text.spliced(d, one.unionAll(two), "doc_id")


_FRONT = "CASE doc_id % 4 WHEN 0 THEN '---' || chr(10) || 'a: 1' || chr(10) || '---' || chr(10) WHEN 1 THEN '+++' || chr(10) || '+++' || chr(10) WHEN 2 THEN '---' || chr(10) || 'open' ELSE '' END"


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 13 WHEN 1 THEN 8 END AS bytes FROM documents")
def frontmatter(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(_FRONT.replace("chr(10)", "char(10)")).alias("t"))
    return d.select("doc_id", scalars.frontmatter_bytes(F.concat("t", F.lit("end"))).alias("bytes"))


# anchors


@query(r"""SELECT page_id, position, regexp_replace(replace(lower(heading), ' ', '-'), '[^a-z0-9_-]', '', 'g') AS slug FROM (
  SELECT page_id, CAST(p - 1 AS INTEGER) AS position, trim(""" + _TEXT.format("regexp_replace(raw, '<[^>]*>', '', 'g')") + f""") AS heading FROM (
  SELECT page_id, unnest(r) AS raw, generate_subscripts(r, 1) AS p FROM (SELECT page_id, {_H} AS r FROM pages))) WHERE regexp_matches(heading, '^[ -~]*$')""")
def slug_github_subset(spark, sf_dir):
    h = text.headings(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").filter(F.col("heading").rlike("^[ -~]*$"))
    return h.select("page_id", "position", anchors.slug("github", F.col("heading")).alias("slug"))


@query()
def anchor_identities(spark, sf_dir):
    return anchors.identities(text.headings(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id"), "page_id")


def _anchor_inputs(spark, sf_dir):
    e = entries(spark, sf_dir, 1).select("doc_id", F.substring("oid", 1, 2).alias("target"), F.substring("oid", 3, 2).alias("a"))
    known = e.filter("doc_id % 2 = 0").select("target", F.when(F.col("doc_id") % 4 == 0, F.concat("a", F.lit("_x"))).otherwise(F.col("a")).alias("anchor"))
    refs = e.select(F.col("doc_id").alias("id"), "target", F.when(F.col("doc_id") % 3 == 0, F.concat("a", F.lit("-x"))).otherwise(F.col("a")).alias("fragment"))
    return refs, known


@query(f"""WITH e AS (SELECT doc_id, left(oid, 2) AS target, substring(oid, 3, 2) AS a FROM ({ENTRIES}) WHERE side = 1),
  k AS (SELECT DISTINCT target, CASE WHEN doc_id % 4 = 0 THEN a || '_x' ELSE a END AS anchor FROM e WHERE doc_id % 2 = 0),
  f AS (SELECT target, replace(lower(anchor), '_', '-') AS folded, min(anchor) AS near FROM k GROUP BY ALL HAVING count(*) = 1),
  r AS (SELECT doc_id AS id, target, CASE WHEN doc_id % 3 = 0 THEN a || '-x' ELSE a END AS fragment FROM e)
  SELECT r.id, r.target, r.fragment, CASE WHEN k.anchor IS NULL THEN 'missing' ELSE 'resolved' END AS resolution, CASE WHEN k.anchor IS NULL THEN f.near END AS near
  FROM r LEFT JOIN k ON k.target = r.target AND k.anchor = r.fragment LEFT JOIN f ON f.target = r.target AND f.folded = replace(lower(r.fragment), '_', '-')""")
def anchor_lookup(spark, sf_dir):
    return resolution.anchor_lookup(*_anchor_inputs(spark, sf_dir))


@query()
def markdown_references(spark, sf_dir):
    return grammar.references(grammar.sample_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), "doc_id", "adapter", "source")


@query()
def native_paths(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", scalars.split_destination(F.col("url"))[0].alias("p"))
    return p.select("page_id", grammar.native_path(F.lit("docs/guide/index.md"), F.regexp_replace("p", "^https?://", "../"), F.lit(False)).alias("r")).select("page_id", "r.*")


@query("SELECT doc_id, sha256('{\"id\":' || CAST(doc_id AS VARCHAR) || ',\"lang\":' || coalesce('\"' || lang || '\"', 'null') || ',\"source\":' || coalesce('\"' || source || '\"', 'null') || '}') AS digest FROM documents")
def canonical_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.to_json(F.struct("source", "lang", F.col("doc_id").alias("id")), {"ignoreNullFields": "false"})
    return d.select("doc_id", F.sha2(strict_json.canonical(body).cast("binary"), 256).alias("digest"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'duplicate-key' WHEN 2 THEN 'number' WHEN 3 THEN 'syntax' ELSE 'range' END AS error FROM documents")
def strict_json_errors(spark, sf_dir):
    k = F.col("doc_id") % 5
    body = F.when(k == 0, '{"a":[1,{"b":null}]}').when(k == 1, '{"a":1,"a":2}').when(k == 2, '{"a":1.5}').when(k == 3, '{"a":}').otherwise('{"a":9007199254740993}')
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", strict_json.error(body).alias("error"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS n FROM documents)
  SELECT DISTINCT doc_id % 50 AS claim_document, 'claim-broken' AS kind, count(*) OVER (PARTITION BY doc_id % 50) AS members, min(doc_id) OVER (PARTITION BY doc_id % 50) AS first_id
  FROM d WHERE doc_id % 3 <> 0""")
def claim_groups(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("state", F.when(F.col("doc_id") % 3 == 0, "attested").otherwise("broken"))
    return findings.claims(d.select((F.col("doc_id") % 50).alias("claim_document"), F.lit("n").alias("name"), "state", "doc_id"), ["claim_document", "name"], "doc_id").drop("name")


# external destinations

_DEST = W.duck(W.DESTINATIONS)
_DELTA = f"""WITH s AS ({_DEST}), d AS (SELECT destination, CASE WHEN max(side) = 0 THEN 'removed' WHEN min(side) = 1 THEN 'introduced' ELSE 'retained' END AS change,
  list_sort(list_distinct(list(document))) AS documents FROM s GROUP BY destination)"""


def _delta(spark, sf_dir):
    s = W.frame(spark, sf_dir, W.DESTINATIONS)
    return external.delta(s.filter("side = 0"), s.filter("side = 1"))


@query(f"{_DELTA} SELECT change, count(*) AS destinations FROM d GROUP BY change")
def external_delta(spark, sf_dir):
    return _delta(spark, sf_dir).groupBy("change").agg(F.count("*").alias("destinations"))


@query(f"{_DELTA} SELECT destination, change, array_to_string(documents, ',') AS documents FROM d")
def external_documents(spark, sf_dir):
    return _delta(spark, sf_dir).withColumn("documents", F.array_join("documents", ","))


_EVIDENCE = """SELECT url AS destination, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'HEAD' END AS method,
  CASE page_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 403 WHEN 4 THEN 500 WHEN 5 THEN 410 ELSE 200 END AS status,
  CASE WHEN page_id % 13 = 0 THEN 'timeout' END AS failure FROM {pages} WHERE page_id % 5 <> 0 AND url IS NOT NULL"""


@query(f"""{_DELTA}, e AS ({W.duck(_EVIDENCE)}), p AS (SELECT destination FROM d WHERE change = 'introduced')
  SELECT DISTINCT destination, 'stray' AS defect FROM e WHERE destination NOT IN (SELECT destination FROM p)
  UNION ALL SELECT destination, 'duplicate' FROM e GROUP BY destination HAVING count(*) > 1""")
def evidence_binding(spark, sf_dir):
    plan = _delta(spark, sf_dir).filter("change = 'introduced'")
    return external.binding_defects(plan, W.frame(spark, sf_dir, _EVIDENCE))


@query(f"""{_DELTA}, e AS (SELECT destination, min(method) AS method, min(status) AS status, min(failure) AS failure FROM ({W.duck(_EVIDENCE)}) GROUP BY destination)
  SELECT CASE WHEN method IS NULL THEN 'unexamined' WHEN failure IS NOT NULL THEN 'unproven/failed' WHEN status BETWEEN 200 AND 399 THEN 'reachable'
    WHEN status IN (404, 410) THEN CASE WHEN method = 'GET' THEN 'refuted' ELSE 'unproven/unconfirmed' END WHEN status IN (401, 403, 999) THEN 'unproven/denied'
    WHEN status = 429 THEN 'unproven/rate-limited' ELSE 'unproven/status' END AS verdict, count(*) AS n FROM d LEFT JOIN e USING (destination) WHERE change = 'introduced' GROUP BY 1""")
def assessment_verdicts(spark, sf_dir):
    e = W.frame(spark, sf_dir, _EVIDENCE).groupBy("destination").agg(F.min("method").alias("method"), F.min("status").alias("status"), F.min("failure").alias("failure"))
    return external.assessed(_delta(spark, sf_dir).filter("change = 'introduced'"), e).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""{_DELTA}, f AS (SELECT destination FROM d WHERE change <> 'removed' AND destination LIKE 'https:%')
  SELECT destination, greatest((SELECT count(*) FROM f) - 16, 0) AS skipped FROM f ORDER BY destination LIMIT 16""")
def probe_targets(spark, sf_dir):
    plan = _delta(spark, sf_dir).filter("change <> 'removed'").withColumns({"scheme": scalars.scheme_of(F.col("destination")), "repository": F.lit(None).cast("string")})
    return external.probe_targets(plan, 16)


@query("""WITH r AS (SELECT user_id, event_id, coalesce(sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM events)
  SELECT user_id, event_id FROM r WHERE stops = 0""")
def take_until_stop(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    return external.until_stop(e, ["user_id"], "event_id", F.col("event_id") % 4 == 0)


# deliveries

_DELIVERIES = W.duck(W.DELIVERIES)
_NOW = f"(SELECT max(received) FROM ({_DELIVERIES}))"


def _delivered(spark, sf_dir):
    d = W.frame(spark, sf_dir, W.DELIVERIES)
    return d, d.agg(F.max("received")).first()[0] or 0


@query(f"""SELECT refused, count(*) AS n FROM (SELECT CASE WHEN received < {_NOW} - 600000 THEN 'received-late' WHEN received > {_NOW} + 60 THEN 'received-early' WHEN issued > {_NOW} + 60 THEN 'issued-early'
  WHEN issued < received - 600000 THEN 'issued-late' WHEN issued > received + 60 THEN 'issued-after-receipt' END AS refused FROM ({_DELIVERIES})) GROUP BY refused""")
def admission_window(spark, sf_dir):
    d, now = _delivered(spark, sf_dir)
    return d.groupBy(deliveries.admission(F.col("received"), F.col("issued"), now, 600000, 60).alias("refused")).agg(F.count("*").alias("n"))


@query(f"""WITH d AS ({_DELIVERIES}), f AS (SELECT key, arg_min(digest, (received, event_id)) AS first, arg_min(event_id, (received, event_id)) AS first_id FROM d GROUP BY key)
  SELECT event_id, CASE WHEN event_id = first_id THEN 'first' WHEN digest = first THEN 'duplicate' ELSE 'conflict' END AS outcome FROM d JOIN f USING (key)""")
def delivery_dedup(spark, sf_dir):
    d, _ = _delivered(spark, sf_dir)
    return deliveries.deduplicated(d, ["key"], ["received", "event_id"], "digest").select("event_id", "outcome")


@query(f"SELECT event_id, CASE WHEN event_type <> 'click' THEN issued + 4200 END AS keep_through FROM ({_DELIVERIES})")
def replay_horizon(spark, sf_dir):
    d, _ = _delivered(spark, sf_dir)
    return d.select("event_id", deliveries.keep_through(F.col("issued"), 3600, 600, F.col("event_type") == "click").alias("keep_through"))


@query(f"SELECT min(key) FILTER (received <= {_NOW} - 86400) AS claimed, CAST(NULL AS BIGINT) AS wake_at FROM ({_DELIVERIES})")
def claim_ready(spark, sf_dir):
    d, now = _delivered(spark, sf_dir)
    return deliveries.claimable(d.withColumn("ready_at", F.col("received")), now - 86400)


@query(f"""WITH d AS (SELECT user_id AS key, CAST(received AS BIGINT) AS at_, event_id, event_type AS kind FROM ({_DELIVERIES})) SELECT key, count(*) AS events, count(DISTINCT kind) AS kinds FROM d GROUP BY key""")
def lease_log(spark, sf_dir):
    d, _ = _delivered(spark, sf_dir)
    return d.groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("events"), F.countDistinct("event_type").alias("kinds"))


@query(f"""WITH RECURSIVE d AS (SELECT user_id AS key, received AS t, event_id % 3 AS owner, CASE WHEN event_id % 5 = 0 THEN 'complete' ELSE 'claim' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY received, event_id) AS n FROM ({_DELIVERIES})),
  s AS (SELECT key, CAST(0 AS BIGINT) AS n, 'new' AS state, CAST(NULL AS BIGINT) AS owner, CAST(0 AS BIGINT) AS fence, CAST(0 AS BIGINT) AS until, CAST(0 AS BIGINT) AS busy, CAST(0 AS BIGINT) AS duplicates FROM (SELECT DISTINCT key FROM d)
    UNION ALL SELECT s.key, d.n, CASE WHEN s.state = 'done' THEN 'done' WHEN take THEN 'running' WHEN done THEN 'done' ELSE s.state END,
      CASE WHEN take THEN d.owner ELSE s.owner END, s.fence + CASE WHEN take THEN 1 ELSE 0 END, CASE WHEN take THEN d.t + 3600 ELSE s.until END,
      s.busy + CASE WHEN s.state = 'done' OR take OR done THEN 0 ELSE 1 END, s.duplicates + CASE WHEN s.state = 'done' THEN 1 ELSE 0 END
    FROM s JOIN d ON d.key = s.key AND d.n = s.n + 1, LATERAL (SELECT s.state <> 'done' AND d.kind = 'claim' AND (s.state = 'new' OR d.t >= s.until) AS take) a,
      LATERAL (SELECT s.state = 'running' AND d.kind = 'complete' AND d.owner = s.owner AND d.t < s.until AS done) b)
  SELECT key, state, fence, busy, duplicates FROM s JOIN (SELECT key, max(n) AS m FROM d GROUP BY key) USING (key) WHERE n = m""")
def lease_fold(spark, sf_dir):
    d, _ = _delivered(spark, sf_dir)
    log = d.select(F.col("user_id").alias("key"), F.col("received").alias("at"), "event_id", F.when(F.col("event_id") % 5 == 0, "complete").otherwise("claim").alias("kind"), (F.col("event_id") % 3).cast("string").alias("owner"))
    return deliveries.lease_states(log, "key", 3600)


@query(f"""SELECT conclusion, count(*) AS n FROM (SELECT CASE WHEN user_id % 11 = 0 THEN 'revoked' WHEN user_id % 7 = 0 THEN 'closed' WHEN event_id % 5 = 0 THEN 'superseded' WHEN event_id % 2 = 0 THEN 'pass' ELSE 'fail' END AS conclusion FROM ({_DELIVERIES})) GROUP BY conclusion""")
def publication(spark, sf_dir):
    d, _ = _delivered(spark, sf_dir)
    runner = F.when(F.col("event_id") % 2 == 0, "pass").otherwise("fail")
    return d.groupBy(deliveries.publication(runner, F.col("user_id") % 11 == 0, F.col("user_id") % 7 == 0, F.col("event_id") % 5 == 0).alias("conclusion")).agg(F.count("*").alias("n"))


@query(f"""SELECT event_type, CASE event_type WHEN 'click' THEN 'bound' WHEN 'view' THEN 'ambiguous' ELSE 'unplanned' END AS binding, CASE WHEN event_type = 'click' THEN 'plan-a' END AS plan, count(*) AS n FROM ({_DELIVERIES}) GROUP BY ALL""")
def plan_binding(spark, sf_dir):
    d, _ = _delivered(spark, sf_dir)
    plans = spark.createDataFrame([("click", "plan-a"), ("view", "plan-b"), ("view", "plan-c")], "event_type string, plan string")
    return deliveries.plan_binding(d, plans, ["event_type"]).groupBy("event_type", "binding", "plan").agg(F.count("*").alias("n"))
