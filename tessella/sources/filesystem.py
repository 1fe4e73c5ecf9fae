"""File trees and tar archives as evidence."""

from __future__ import annotations

import base64
import os
import stat
import tarfile
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TREE_SCHEMA = "path string, file_type string, link_target string, length long, mode long, uid long, gid long, mtime long, dev long, inode long, nlink long, status string, content binary, atime long, ctime long, rdev long, xattrs map<string,binary>"
BLOCK_SCHEMA = "path string, ordinal long, n_bytes long, status string, data binary"
#: Fixed value: how often an interrupted read is tried again before its block counts as zeros.
RETRIES = 11
TAR_SCHEMA = "archive string, ordinal long, path string, file_type string, link_target string, data_offset long, length long, mode long, uid long, gid long, mtime long, pax map<string,string>, content binary"


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Files by Spark's own reader, whole, with the depth of their path; ``numbered`` gives them numbers."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.size(F.split("path", "/")).alias("depth"), "length", "modificationTime", "content")


def kind_of(mode: int) -> str:
    for test, name in ((stat.S_ISDIR, "directory"), (stat.S_ISLNK, "symlink"), (stat.S_ISREG, "file"), (stat.S_ISFIFO, "fifo"), (stat.S_ISCHR, "char"), (stat.S_ISBLK, "block")):
        if test(mode):
            return name
    return "socket"


class TreeSource(DataSource):
    """Format ``evidence_tree``: the tree below each of the comma-separated ``path``s. An unreadable entry is kept, empty, with status ``ua``."""

    @classmethod
    def name(cls) -> str:
        return "evidence_tree"

    def schema(self) -> str:
        return TREE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["path"].split(","))


class _TreeReader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self.roots]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        todo = [partition.value]
        for path in todo:
            kind, status, content, target, own, xattrs = "file", "ok", None, None, None, {}
            try:
                own = os.lstat(path)
                kind, xattrs = kind_of(own.st_mode), attributes(path)
                if kind == "directory":
                    todo += [os.path.join(path, x) for x in sorted(os.listdir(path))]
                elif kind == "symlink":
                    target = os.readlink(path)
                elif kind == "file":
                    with open(path, "rb") as f:
                        content = f.read()
            except OSError:
                status, content = "ua", b""
            if own is None:  # gone meanwhile, or in a folder that can't be searched
                yield path, kind, None, *[None] * 8, status, content, None, None, None, {}
            else:
                yield path, kind, target, own.st_size, own.st_mode & 0o7777, own.st_uid, own.st_gid, int(own.st_mtime), own.st_dev, own.st_ino, own.st_nlink, status, content, int(own.st_atime), int(own.st_ctime), own.st_rdev, xattrs


def attributes(path: str) -> dict[str, bytes]:
    """Extended attributes; POSIX ACLs are among them, as the system stores them. What can't be read is left out."""
    found = {}
    try:
        for name in os.listxattr(path, follow_symlinks=False):
            found[name] = os.getxattr(path, name, follow_symlinks=False)
    except (OSError, AttributeError):
        pass
    return found


class BlockSource(DataSource):
    """Format ``evidence_blocks``: each of the comma-separated files, of any size, in blocks of ``size`` bytes. Runs of blocks are read by tasks of their own, of
    ``task_bytes`` at most, so neither a row nor a task has to hold a file. A block that stays unreadable is zeros, with status ``zero``."""

    @classmethod
    def name(cls) -> str:
        return "evidence_blocks"

    def schema(self) -> str:
        return BLOCK_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options["path"].split(","), int(self.options.get("size", 32768)), int(self.options.get("task_bytes", 64 << 20)), float(self.options.get("pause", 6)))


class _BlockReader(DataSourceReader):
    def __init__(self, paths: list[str], size: int, task_bytes: int, pause: float):
        self.paths, self.size, self.run, self.pause = paths, size, max(1, task_bytes // size), pause

    def partitions(self) -> list[InputPartition]:
        sizes = [(p, -(-os.stat(p).st_size // self.size)) for p in self.paths]
        return [InputPartition((p, first, min(n, first + self.run))) for p, n in sizes for first in range(0, max(1, n), self.run)]

    def block(self, f, ordinal: int) -> tuple[bytes, str]:
        """One block; short reads go on, interrupted ones are tried again."""
        wanted, held, tries = self.size, b"", 0
        f.seek(ordinal * self.size)
        while len(held) < wanted:
            try:
                got = f.read(wanted - len(held))
            except InterruptedError:
                tries += 1
                if tries > RETRIES:
                    return bytes(wanted), "zero"
                time.sleep(self.pause)
                continue
            if not got:
                break
            held += got
        return held, "ok"

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, first, last = partition.value
        with open(path, "rb", buffering=0) as f:
            for ordinal in range(first, max(last, first + 1)):
                data, status = self.block(f, ordinal)
                yield path, ordinal, len(data), status, data


class TarSource(DataSource):
    """Format ``evidence_tar``: entries of each of the comma-separated archives, plain or compressed. Option ``payload`` false leaves content null: an
    index of extents."""

    @classmethod
    def name(cls) -> str:
        return "evidence_tar"

    def schema(self) -> str:
        return TAR_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TarReader(self.options["path"].split(","), self.options.get("payload", "true").lower() == "true")


def _text_key(key: str) -> str:
    """PAX keys that aren't valid text become base64."""
    try:
        key.encode("utf-8")
        return key
    except UnicodeEncodeError:
        return base64.b64encode(key.encode("utf-8", "surrogateescape")).decode()


class _TarReader(DataSourceReader):
    def __init__(self, archives: list[str], payload: bool):
        self.archives, self.payload = archives, payload

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(a) for a in self.archives]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        kinds = {tarfile.DIRTYPE: "directory", tarfile.SYMTYPE: "symlink", tarfile.LNKTYPE: "hardlink", tarfile.FIFOTYPE: "fifo", tarfile.CHRTYPE: "char", tarfile.BLKTYPE: "block"}
        with tarfile.open(partition.value, "r:*") as archive:
            for i, m in enumerate(archive):
                content = archive.extractfile(m).read() if self.payload and m.isreg() else None
                pax = {_text_key(k): v for k, v in m.pax_headers.items()}
                yield partition.value, i, m.name.rstrip("/"), kinds.get(m.type, "file"), m.linkname or None, m.offset_data, m.size, m.mode, m.uid, m.gid, int(m.mtime), pax, content


def register(spark: SparkSession) -> None:
    for source in (TreeSource, TarSource, BlockSource):
        spark.dataSource.register(source)


def numbered(entries: DataFrame, path: str = "path") -> DataFrame:
    """file_no from 1 by depth, then path, without gaps; and the number of the parent, 0 at a root. For one tree, whose paths fit one sort."""
    from pyspark.sql import Window

    depth = F.size(F.split(path, "/"))
    out = entries.withColumn("file_no", F.row_number().over(Window.orderBy(depth, path)).cast("long"))
    parents = out.select(F.col(path).alias("parent_path"), F.col("file_no").alias("parent_file_no"))
    return out.withColumn("parent_path", F.regexp_replace(path, r"/[^/]+$", "")).join(parents, "parent_path", "left").withColumn("parent_file_no", F.coalesce("parent_file_no", F.lit(0).cast("long"))).drop("parent_path")
