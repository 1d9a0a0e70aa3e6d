"""Snapshots from Git: a commit's tree or a staged index, as rows (path, mode, oid, size, content).

`register(spark)` adds the data source "git_snapshot" with options `repository`, `revision` (a commit
id) or `index`. It reads loose objects, each verified against its id; packed repositories are unpacked
by Git itself before. The driver lists the tree; the executors read and verify the contents.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path binary, mode string, oid string, size bigint, content binary"
#: Objects read by one task.
BATCH = 500


def loose(raw: bytes, oid: str) -> tuple[str, bytes]:
    """(kind, content) of a loose object, after its header and its id."""
    data = zlib.decompress(raw)
    head, _, body = data.partition(b"\0")
    kind, _, size = head.partition(b" ")
    if not size.isdigit() or int(size) != len(body):
        raise ValueError(f"{oid}: the header's size is wrong")
    digest = hashlib.sha1(data) if len(oid) == 40 else hashlib.sha256(data)
    if digest.hexdigest() != oid:
        raise ValueError(f"{oid}: the content has another id")
    return kind.decode(), body


def tree(body: bytes, width: int = 20) -> list[tuple[str, bytes, str]]:
    """(mode, name, oid) rows; names must be in tree order, each once."""
    rows, at = [], 0
    while at < len(body):
        space, zero = body.index(b" ", at), body.index(b"\0", at)
        mode, name = body[at:space].decode().rjust(6, "0"), body[space + 1 : zero]
        if not name or b"/" in name or name in (b".", b".."):
            raise ValueError("a tree has a name that no path can hold")
        rows.append((mode, name, body[zero + 1 : zero + 1 + width].hex()))
        at = zero + 1 + width
    order = [n + b"/" * (m == "040000") for m, n, _ in rows]
    if any(a >= b for a, b in zip(order, order[1:], strict=False)):
        raise ValueError("a tree is out of order")
    return rows


def commit(body: bytes) -> dict[str, list[str]]:
    """Header fields of a commit."""
    out: dict[str, list[str]] = {}
    for line in body.partition(b"\n\n")[0].decode("utf-8", "replace").split("\n"):
        name, _, value = line.partition(" ")
        if name:
            out.setdefault(name, []).append(value)
    if len(out.get("tree", [])) != 1:
        raise ValueError("a commit has no single tree")
    return out


def index(data: bytes) -> list[tuple[str, bytes, str]]:
    """(mode, path, oid) rows of an index of version 2 or 3: stage 0 only, ordered, checksummed."""
    magic, version, count = struct.unpack(">4sII", data[:12])
    if magic != b"DIRC" or version not in (2, 3):
        raise ValueError("not an index of version 2 or 3")
    if hashlib.sha1(data[:-20]).digest() != data[-20:]:
        raise ValueError("the index's checksum is wrong")
    rows, at = [], 12
    for _ in range(count):
        mode, oid, flags = struct.unpack(">24x I 12x 20s H".replace(" ", ""), data[at : at + 62])
        extended = bool(flags & 0x4000)
        start = at + 62 + 2 * extended
        end = data.index(b"\0", start)
        if flags >> 12 & 3:
            raise ValueError("the index has unmerged entries")
        if extended and struct.unpack(">H", data[at + 62 : at + 64])[0] & 0x2000:
            raise ValueError("the index has entries that were only announced")
        rows.append((f"{mode:06o}", data[start:end], oid.hex()))
        at += (end - at) // 8 * 8 + 8
    if any(a[1] >= b[1] for a, b in zip(rows, rows[1:], strict=False)):
        raise ValueError("the index is out of order")
    return rows


class Store:
    def __init__(self, repository: str):
        root = Path(repository)
        self.root = root / ".git" if (root / ".git").is_dir() else root

    def read(self, oid: str) -> tuple[str, bytes]:
        return loose((self.root / "objects" / oid[:2] / oid[2:]).read_bytes(), oid)

    def entries(self, revision: str) -> list[tuple[str, bytes, str]]:
        """Entries below a commit's tree, by path; directories are implied."""
        rows, todo = [], [(b"", commit(self.read(revision)[1])["tree"][0], ())]
        while todo:
            prefix, oid, above = todo.pop()
            if oid in above:
                raise ValueError("a tree holds itself")
            kind, body = self.read(oid)
            if kind != "tree":
                raise ValueError(f"{oid} is a {kind}, not a tree")
            for mode, name, child in tree(body, len(oid) // 2):
                if mode == "040000":
                    todo.append((prefix + name + b"/", child, (*above, oid)))
                else:
                    rows.append((mode, prefix + name, child))
        return sorted(rows, key=lambda r: r[1])


class _Some(InputPartition):
    def __init__(self, rows: list[tuple[str, bytes, str]]):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        store = Store(self.options["repository"])
        if self.options.get("index", "false").lower() == "true":
            rows = index((store.root / "index").read_bytes())
        else:
            rows = store.entries(self.options["revision"])
        return [_Some(rows[i : i + BATCH]) for i in range(0, len(rows), BATCH)] or [_Some([])]

    def read(self, partition: _Some) -> Iterator[tuple]:
        store, most = Store(self.options["repository"]), int(self.options.get("maxbytes", 1 << 24))
        for mode, path, oid in partition.rows:
            if mode == "160000":  # another repository's commit has no object here
                yield path, mode, oid, None, None
                continue
            body = store.read(oid)[1]
            yield path, mode, oid, len(body), body if len(body) <= most else None


class GitSnapshot(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_snapshot"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSnapshot)
