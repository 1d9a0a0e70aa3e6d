"""Git snapshots, strict JSON, and streams against their batch forms."""

import hashlib
import random
import struct
import zlib

import pytest

from snapweave.operators import deliveries as batch
from snapweave.sources import git, strict_json
from snapweave.streaming import deliveries


def store(root, kind, body):
    data = f"{kind} {len(body)}".encode() + b"\0" + body
    oid = hashlib.sha1(data).hexdigest()
    path = root / ".git" / "objects" / oid[:2] / oid[2:]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(zlib.compress(data))
    return oid


@pytest.fixture
def repository(tmp_path):
    readme, doc = store(tmp_path, "blob", b"# hi\n"), store(tmp_path, "blob", b"x")
    docs = store(tmp_path, "tree", b"100644 a.md\0" + bytes.fromhex(doc))
    top = store(tmp_path, "tree", b"100644 README.md\0" + bytes.fromhex(readme) + b"40000 docs\0" + bytes.fromhex(docs))
    head = store(tmp_path, "commit", f"tree {top}\nauthor x\n\nm".encode())
    entry = lambda mode, oid, name: (struct.pack(">24xI12x20sH", mode, bytes.fromhex(oid), len(name)) + name).ljust((62 + len(name)) // 8 * 8 + 8, b"\0")
    data = struct.pack(">4sII", b"DIRC", 2, 2) + entry(0o100644, readme, b"README.md") + entry(0o100644, doc, b"docs/a.md")
    (tmp_path / ".git" / "index").write_bytes(data + hashlib.sha1(data).digest())
    return tmp_path, head, doc


def test_commit_and_index(spark, repository):
    root, head, _ = repository
    git.register(spark)
    read = spark.read.format("git_snapshot").option("repository", str(root))
    want = [(b"README.md", "100644", 5), (b"docs/a.md", "100644", 1)]
    for df in (read.option("revision", head).load(), read.option("index", "true").load()):
        assert [(bytes(r.path), r.mode, r["size"]) for r in df.orderBy("path").collect()] == want


def test_objects_are_verified(repository):
    root, _, doc = repository
    raw = (root / ".git" / "objects" / doc[:2] / doc[2:]).read_bytes()
    assert git.loose(raw, doc) == ("blob", b"x")
    with pytest.raises(ValueError, match="another id"):
        git.loose(zlib.compress(b"blob 1\0y"), doc)
    with pytest.raises(ValueError, match="order"):
        git.tree(b"100644 b\0" + b"0" * 20 + b"100644 a\0" + b"0" * 20)


@pytest.mark.parametrize(
    ("text", "why"),
    [("\ufeff1", "byte-order-mark"), ('{"a":1,"a":1}', "duplicate-key"), ("1.0", "number"), ("-0", "number"), ("9007199254740992", "range"), ("[1", "syntax"), ("1 2", "syntax"), ("NaN", "number"), ("[" * 600 + "]" * 600, "depth")],
)
def test_strict_json_refuses(text, why):
    with pytest.raises(strict_json.Refused, match=why):
        strict_json.parse(text)


def test_canonical_order_is_utf16():
    value = strict_json.parse('{"\U0001f600": 1, "\uffff": 2, "a": [true, null, "\\u00e9"]}')
    assert strict_json.dumps(value) == '{"a":[true,null,"é"],"\U0001f600":1,"\uffff":2}'
    assert strict_json.dumps(strict_json.parse(strict_json.dumps(value))) == strict_json.dumps(value)


def events(n=120):
    r = random.Random(4)
    return [(f"k{r.randrange(6)}", i, i, r.choice(["claim", "claim", "complete"]), f"o{r.randrange(2)}", r.choice("ab")) for i in range(n)]


def stream(spark, tmp_path, build):
    rows = events()
    for part in range(4):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], "key string, at long, event_id long, kind string, owner string, digest string").coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"{part}"))
    out = []
    src = spark.readStream.schema("key string, at long, event_id long, kind string, owner string, digest string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    df, mode = build(src)
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, i: out.extend((i, *r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows, out


def test_lease_stream_ends_as_the_fold(spark, tmp_path):
    rows, out = stream(spark, tmp_path, lambda s: (deliveries.leases(s, "key", 5), "update"))
    last = {}
    for _, key, *state in sorted(out, key=lambda x: x[0]):
        last[key] = tuple(state)
    log = spark.createDataFrame(rows, "key string, at long, event_id long, kind string, owner string, digest string")
    assert last == {r[0]: tuple(r)[1:] for r in batch.lease_states(log, "key", 5).collect()}


def test_outcome_stream_is_the_batch_outcome(spark, tmp_path):
    rows, out = stream(spark, tmp_path, lambda s: (deliveries.outcomes(s, "key"), "append"))
    log = spark.createDataFrame(rows, "key string, at long, event_id long, kind string, owner string, digest string")
    want = {r.event_id: r.outcome for r in batch.deduplicated(log, ["key"], ["at", "event_id"], "digest").collect()}
    assert {e: o for _, _, e, o in out} == want
