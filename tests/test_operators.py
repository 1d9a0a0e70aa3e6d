"""Operators on small tables: joins, correlation, policy, text, external and deliveries."""

import itertools
import random

from pyspark.sql import functions as F

from snapweave.operators import correlation, deliveries, external, feedback, findings, policy, resolution, text


def got(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_locate_implied_directories(spark):
    e = spark.createDataFrame([("a/b/c.md", "100644", "1"), ("l", "120000", "2")], "path string, mode string, oid string")
    r = spark.createDataFrame([(1, "a/b"), (2, "a/b/c.md"), (3, "x"), (4, "l")], "id int, target string")
    out = resolution.locate(r, e).withColumn("k", resolution.resolution(F.col("mode"), F.lit("blob"))).select("id", "k")
    assert got(out, "id") == [(1, "type-mismatch"), (2, "resolved"), (3, "missing"), (4, "unsupported-target")]


def test_nearest_rule_prefers_the_deepest(spark):
    rules = spark.createDataFrame([("", "root"), ("a", "a"), ("a/b/c", "exact")], "at string, rule string")
    rows = spark.createDataFrame([("a/b/c",), ("a/x",), ("y",)], "path string")
    assert got(resolution.nearest_rule(rows, rules).select("path", "rule"), "path") == [("a/b/c", "exact"), ("a/x", "a"), ("y", "root")]


def test_case_neighbour_is_unique_or_null(spark):
    e = spark.createDataFrame([("A.md",), ("b.md",), ("B.md",), ("É.md",)], "path string")
    m = spark.createDataFrame([("a.md",), ("b.MD",), ("é.md",)], "target string")
    assert got(resolution.case_neighbour(m, e).select("target", "near"), "target") == [("a.md", "A.md"), ("b.MD", None), ("é.md", None)]


def brute_components(base, cand, renames):
    """Union-find over explicit edges."""
    ids_b, ids_c = {o[0] for o in base}, {o[0] for o in cand}
    b, c = [o for o in base if o[0] not in ids_c], [o for o in cand if o[0] not in ids_b]
    parent = {("b", o[0]): ("b", o[0]) for o in b} | {("c", o[0]): ("c", o[0]) for o in c}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    to = dict(renames)
    for x, y in itertools.product(b, c):
        same = x[1] == y[1]
        moved = to.get(x[1]) == y[1] and x[4] == y[4]
        if x[2:4] == y[2:4] and (same or moved):
            parent[find(("b", x[0]))] = find(("c", y[0]))
    groups = {}
    for k in parent:
        groups.setdefault(find(k), [0, 0])[k[0] == "c"] += 1
    out = {"removed": 0, "new": 0, "candidate": 0, "ambiguous": 0}
    for nb, nc in groups.values():
        out["removed" if nc == 0 else "new" if nb == 0 else "candidate" if nb == nc == 1 else "ambiguous"] += 1
    return out


def test_components_closed_form(spark):
    r = random.Random(3)
    schema = "id string, document string, construct string, intent string, block string"
    for round_ in range(4):
        docs_b, docs_c = ["d0", "d1", "d2", "old1", "old2"], ["d0", "d1", "d2", "new1", "new2"]
        side = lambda docs, n: [(f"{r.randrange(80)}" if r.random() < 0.3 else f"{round_}{n}{i}", r.choice(docs), r.choice("lx"), r.choice("pq"), r.choice("12")) for i in range(40)]  # noqa: E731, B023
        base = list({o[0]: o for o in side(docs_b, "b")}.values())
        cand = list({o[0]: o for o in side(docs_c, "c")}.values())
        renames = [("old1", "new1"), ("old2", "new2")]
        g = correlation.components(spark.createDataFrame(base, schema), spark.createDataFrame(cand, schema), spark.createDataFrame(renames, "removed string, added string"))
        rows = g.collect()
        ours = {"removed": 0, "new": 0, "candidate": 0, "ambiguous": 0}
        for x in rows:
            ours[x.outcome] += x.n_base + x.n_candidate if x.outcome in ("removed", "new") else 1
        assert ours == brute_components(base, cand, renames)


def test_renames_need_one_on_each_side(spark):
    s = "path string, mode string, oid string"
    b = spark.createDataFrame([("a", "m", "1"), ("b", "m", "2"), ("c", "m", "2"), ("s", "m", "9")], s)
    c = spark.createDataFrame([("x", "m", "1"), ("y", "m", "2"), ("s", "m", "9")], s)
    assert got(correlation.renames(b, c)) == [("a", "x")]


def test_raise_only(spark):
    f = spark.createDataFrame([("k", "warn"), ("l", "fail")], "kind string, disposition string")
    one = spark.createDataFrame([("k", "record"), ("l", "record")], "kind string, least string")
    two = spark.createDataFrame([("k", "fail")], "kind string, least string")
    assert got(findings.raised(f, one, two).select("kind", "effective", "steps"), "kind") == [("k", "fail", ["1:warn>fail"]), ("l", "fail", [])]


def test_exceptions(spark):
    f = spark.createDataFrame([("a", "fail"), ("b", "fail"), ("c", "fail"), ("d", "warn")], "finding_key string, effective string")
    k = lambda *x: spark.createDataFrame([(i,) for i in x], "finding_key string")
    out = policy.with_exceptions(f, k("a", "b"), k("b", "c", "d")).select("finding_key", "exception", "final")
    assert got(out, "finding_key") == [("a", "debt", "warn"), ("b", "overlap", "fail"), ("c", "waiver", "warn"), ("d", "waiver", "warn")]


def test_debt_expired_and_worsened(spark):
    f = spark.createDataFrame([("a", "1"), ("b", "2")], "finding_key string, fact string")
    i = spark.createDataFrame([("x", "a", "0", 5), ("y", "b", "2", 50), ("z", "c", "1", 50)], "debt_id string, finding_key string, accepted_fact string, expires_at int")
    assert got(policy.debt(f, i, 10).select("debt_id", "outcome"), "debt_id", "outcome") == [("x", "debt-expired"), ("x", "debt-worsened"), ("y", "applies"), ("z", "unused")]


def test_errors_are_capped_with_a_sentinel(spark):
    e = spark.createDataFrame([(f"p{i % 7}", "c") for i in range(30)], "path string, code string")
    assert got(findings.capped_errors(e, 7)) and findings.capped_errors(e, 7).count() == 7
    assert [r[0] for r in findings.capped_errors(e, 3).orderBy(F.col("path").asc_nulls_last()).collect()] == ["p0", "p1", None]


def test_percent_encoding(spark):
    df = spark.createDataFrame([("a b/é~*+.md",)], "p string")
    assert df.select(feedback.percent_encoded(F.col("p"))).first()[0] == "a%20b/%C3%A9~%2A%2B.md"


def test_lines_and_fixes(spark):
    d = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, None), (4, "x")], "k int, text string")
    assert got(text.lines(d, "k"), "k", "number") == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (4, 1, "x")]
    docs = spark.createDataFrame([(1, "abcdef"), (2, "abcdef"), (3, "ab")], "k int, text string")
    fixes = spark.createDataFrame([(1, 0, 1, "X"), (1, 3, 5, ""), (2, 0, 3, "Y"), (2, 2, 4, "Z"), (3, 0, 9, "W")], "k int, start int, end int, replacement string")
    assert got(text.spliced(docs, fixes, "k"), "k") == [(1, "Xbcf", True), (2, "abcdef", False), (3, "ab", False)]


def test_html(spark):
    h = '<a href="/x?a&amp;b">t</a><!-- <a href="no"> --><script>"<a href=\'no\'>"</script><IMG src="i.png"><h2 id="k">A <b>b</b></h2><h3>open'
    p = spark.createDataFrame([(1, h), (2, None)], "page_id int, html string")
    assert got(text.hrefs(p, "page_id")) == [(1, 0, "/x?a&b"), (1, 1, "i.png")]
    assert got(text.headings(p, "page_id")) == [(1, 0, 2, "A b")]
    assert got(text.anchors(p, "page_id")) == [(1, "k")]


def test_spans(spark):
    s = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 1, 2), (2, 3, 4)], "k int, start int, end int")
    assert got(text.merged_spans(s, "k"), "k", "start") == [(1, 0, 7), (1, 9, 10), (2, 3, 4)]
    assert got(text.overlapping(s, "k")) == [(1,)]


def test_equal_spans_open_one_group(spark):
    """Copies of the span that opens a group stay in it, and spans without a start join the last group."""
    s = spark.createDataFrame([(1, 30, 34), (1, 45, 49), (1, 66, 78), (1, 66, 78), (1, None, 90), (2, None, None)], "k int, start int, end int")
    for n in (1, 3, 7):
        assert got(text.merged_spans(s.repartition(n), "k"), "k", "start") == [(1, 30, 34), (1, 45, 49), (1, 66, 90), (2, None, None)]


def test_external(spark):
    s = "destination string, document string"
    d = external.delta(spark.createDataFrame([("x", "1"), ("y", "1")], s), spark.createDataFrame([("y", "2"), ("z", "3"), ("z", "2")], s))
    assert got(d.select("destination", "change", F.array_join("documents", ",")), "destination") == [("x", "removed", "1"), ("y", "retained", "1,2"), ("z", "introduced", "2,3")]
    v = spark.createDataFrame([("GET", 404, None), ("HEAD", 404, None), (None, None, None), ("GET", 999, None), ("GET", 200, "timeout"), ("HEAD", 301, None)], "m string, s int, f string")
    assert [r[0] for r in v.select(external.verdict(F.col("m"), F.col("s"), F.col("f"))).collect()] == ["refuted", "unproven/unconfirmed", "unexamined", "unproven/denied", "unproven/failed", "reachable"]


def test_budget_crossing_is_the_running_sum(spark):
    r = random.Random(2)
    rows = [(s, f"{r.randrange(40):02d}/{'x' * r.randrange(30)}/{i:03d}", r.randrange(50)) for s in (0, 1) for i in range(200)]
    out = got(deliveries.budget_crossing(spark.createDataFrame(rows, "side int, path string, bytes long"), "side", "path", "bytes", 2000), "side")
    want = []
    for s in (0, 1):
        total = 0
        for _, p, b in sorted(x for x in rows if x[0] == s):
            if total + b > 2000:
                want.append((s, p, total, b))
                break
            total += b
    assert out == want


def test_dedup(spark):
    d = spark.createDataFrame([("k", 1, 1, "a"), ("k", 2, 2, "a"), ("k", 3, 3, "b")], "key string, at int, event_id int, digest string")
    assert got(deliveries.deduplicated(d, ["key"], ["at", "event_id"], "digest").select("event_id", "outcome"), "event_id") == [(1, "first"), (2, "duplicate"), (3, "conflict")]
