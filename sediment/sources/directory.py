"""A directory tree as a Spark data source: one row for each entry, read in parallel by top-level sub-trees.

    spark.dataSource.register(DirectorySource)
    spark.read.format("directory").option("paths", "/a\\n/b").option("hash", "true").load()
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "seq BIGINT, path STRING, path_bytes BINARY, abs_path STRING, size BIGINT, mtime BIGINT, mtime_nsec BIGINT, ctime BIGINT, ctime_nsec BIGINT, ino BIGINT, dev BIGINT, "
    "mode BIGINT, uid BIGINT, gid BIGINT, nlink BIGINT, link_target STRING, dev_major BIGINT, dev_minor BIGINT, sparse BOOLEAN, xattrs MAP<BINARY,BINARY>, data_hash STRING"
)


def common_base(paths: list[bytes]) -> bytes:
    """The directory that all roots share; a single directory is its own."""
    if len(paths) == 1 and os.path.isdir(paths[0]) and not os.path.islink(paths[0]):
        return paths[0]
    return os.path.commonpath([os.path.dirname(p) for p in paths])


def prune_roots(paths: list[bytes]) -> list[bytes]:
    """Distinct absolute roots, without those that lie below another."""
    own = sorted({os.path.normpath(os.path.abspath(p)) for p in paths})
    return [p for p in own if not any(p != q and p.startswith(q.rstrip(b"/") + b"/") for q in own)]


def is_sparse(path: bytes, st: os.stat_result) -> bool:
    """Fewer blocks than bytes, confirmed by a hole where the system can tell."""
    if st.st_blocks * 512 >= st.st_size:
        return False
    try:
        fd = os.open(path, os.O_RDONLY)
        try:
            return os.lseek(fd, 0, os.SEEK_HOLE) < st.st_size
        finally:
            os.close(fd)
    except (OSError, AttributeError):
        return True


def file_hash(path: bytes) -> str:
    with open(path, "rb") as f:
        return "sha256:" + hashlib.file_digest(f, "sha256").hexdigest()


def sparse_copy(source, target, block: int = 4096) -> int:
    """Copy a binary stream into a file, with holes where whole blocks are zero; the bytes copied."""
    size = 0
    while part := source.read(block):
        if part.count(0) == len(part):
            target.seek(len(part), os.SEEK_CUR)
        else:
            target.write(part)
        size += len(part)
    target.truncate(size)
    return size


def entry(path: bytes, base: bytes, want_hash: bool, want_xattrs: bool) -> tuple:
    """The row of one path, without its place; numbers of devices only for device nodes, sizes only for files."""
    st = os.lstat(path)
    kind = stat.S_IFMT(st.st_mode)
    regular, device = kind == stat.S_IFREG, kind in (stat.S_IFBLK, stat.S_IFCHR)
    rel = os.path.relpath(path, base)
    xattrs = None
    if want_xattrs and kind in (stat.S_IFREG, stat.S_IFDIR) and hasattr(os, "listxattr"):
        xattrs = {}
        for name in os.listxattr(path):
            try:
                xattrs[os.fsencode(name)] = os.getxattr(path, name)
            except OSError:
                continue
    return (
        rel.decode("utf-8", "replace"), rel, path.decode("utf-8", "replace"), st.st_size if regular else 0, st.st_mtime_ns // 10**9, st.st_mtime_ns % 10**9, st.st_ctime_ns // 10**9, st.st_ctime_ns % 10**9,
        st.st_ino, st.st_dev, st.st_mode, st.st_uid, st.st_gid, st.st_nlink, os.readlink(path).decode("utf-8", "replace") if kind == stat.S_IFLNK else None,
        os.major(st.st_rdev) if device else 0, os.minor(st.st_rdev) if device else 0, regular and is_sparse(path, st), xattrs or None, file_hash(path) if want_hash and regular else None,
    )


class _Part(InputPartition):
    def __init__(self, number: int, roots: list[bytes], alone: list[bytes]):
        self.number, self.roots, self.alone = number, roots, alone


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        on = lambda k: str(options.get(k, "false")).lower() == "true"
        self.roots = prune_roots([os.fsencode(p) for p in options["paths"].split("\n") if p])
        self.base = common_base(self.roots)
        self.hash, self.xattrs, self.tolerate, self.one_device = on("hash"), on("xattrs"), on("ignorepermissionerrors"), on("onefilesystem")

    def partitions(self) -> list[_Part]:
        """One part for the base and the directories between it and the roots, then one for each root or, of a single root, each of its children."""
        between = {self.base}
        for r in self.roots:
            p = r
            while p != self.base and len(p) > len(self.base):
                p = os.path.dirname(p)
                between.add(p)
        tops = [p for p in self.roots if p not in between]
        if self.roots == [self.base]:
            tops = [os.path.join(self.base, n) for n in sorted(os.listdir(self.base))]
        return [_Part(0, [], sorted(between)), *(_Part(k + 1, [t], []) for k, t in enumerate(tops))]

    def read(self, part: _Part) -> Iterator[tuple]:
        n = part.number << 40
        home = os.lstat(self.base).st_dev
        stack = [(p, False) for p in reversed(part.alone)] + [(p, True) for p in reversed(part.roots)]
        while stack:
            path, descend = stack.pop()
            try:
                st = os.lstat(path)
                if stat.S_ISSOCK(st.st_mode):
                    continue
                row = entry(path, self.base, self.hash, self.xattrs)
            except FileNotFoundError:
                continue
            except PermissionError:
                if self.tolerate:
                    continue
                raise
            yield (n, *row)
            n += 1
            if descend and stat.S_ISDIR(st.st_mode) and not (self.one_device and st.st_dev != home):
                try:
                    names = sorted(os.listdir(path), reverse=True)
                except PermissionError:
                    if not self.tolerate:
                        raise
                    names = []
                except FileNotFoundError:
                    names = []
                stack += [(os.path.join(path, x), True) for x in names]


class DirectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "directory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
