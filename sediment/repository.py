"""A snapshot repository as a directory of Parquet tables behind one version pointer.

Tables: oplog, items, removed, chunks, htree, index_entries. Every change writes new files of the
tables it concerns and then replaces the pointer file, so readers see all of a change or nothing.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import json
import os
import shutil
import subprocess
import tarfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas
from .functions import scalars
from .operators import chunks as ck
from .operators import htree, index, oplog, querylang, sendlog

TABLES = {"oplog": schemas.OPLOG, "items": schemas.ITEMS, "removed": schemas.ITEMS, "chunks": schemas.CHUNKS, "htree": schemas.HTREE_NODES, "index_entries": schemas.INDEX_ENTRIES}
MAX_TAG_BYTES = 32 * 1024
PEM = ("-----BEGIN SEDIMENT KEY-----", "-----END SEDIMENT KEY-----")
MAX_SKEW_S = 15 * 60
#: What each permission allows besides itself.
IMPLIED = {"get": {"list"}, "remove": {"list"}}
ALL = frozenset({"init", "put", "remove", "gc", "get", "list", "sync"})


class NotPermitted(PermissionError):
    """The repository was opened without the permission."""


class NoMatch(LookupError):
    """A query that must match matched nothing."""


class ManyMatches(LookupError):
    """A query that must match once matched several items."""


def allowed(permissions: set[str] | frozenset[str]) -> frozenset[str]:
    return frozenset(permissions).union(*(IMPLIED.get(p, set()) for p in permissions))


@dataclass(frozen=True)
class Key:
    """What its holder may do: each capability is there if its secret is."""

    key_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    primary_key_id: str | None = None
    seed: bytes = b"sediment"
    address_key: bytes = b""
    #: 16, 24 or 32 bytes; without them chunks are stored in clear.
    data_key: bytes = b""
    can_put: bool = True
    can_list: bool = True
    can_list_contents: bool = True
    can_get: bool = True

    @property
    def primary(self) -> str:
        return self.primary_key_id or self.key_id

    def sub_key(self, put: bool = False, list_: bool = False, list_contents: bool = False, get: bool = False) -> Key:
        """A key with some of these capabilities: getting and listing contents include listing."""
        return Key(uuid.uuid4().hex, self.primary, self.seed, self.address_key, self.data_key if put or get else b"", put and self.can_put, (list_ or list_contents or get) and self.can_list, (list_contents or get) and self.can_list_contents, get and self.can_get)

    def save(self, path: str) -> None:
        body = {k: (v.hex() if isinstance(v, bytes) else v) for k, v in self.__dict__.items()}
        text = base64.encodebytes(json.dumps(body).encode()).decode()
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
            f.write(f"{PEM[0]}\n{text}{PEM[1]}\n")

    @staticmethod
    def load(path: str) -> Key:
        with open(path) as f:
            text = f.read().strip()
        if text.startswith(PEM[0]):
            if not text.endswith(PEM[1]):
                raise ValueError("the key file is cut short")
            text = base64.b64decode(text.removeprefix(PEM[0]).removesuffix(PEM[1])).decode()
        body = json.loads(text)
        return Key(**{k: (bytes.fromhex(v) if k in ("seed", "address_key", "data_key") else v) for k, v in body.items()})


def checked_ids(ids: list[str]) -> list[str]:
    if bad := [i for i in ids if len(i) != 32 or set(i.lower()) - set("0123456789abcdef")]:
        raise ValueError(f"invalid id {bad[0]!r}")
    return ids


def read_ids(lines: Iterator[str]) -> list[str]:
    """Ids from a text stream, one on a line; blank lines are skipped, and any bad line is an error."""
    return checked_ids([line.strip() for line in lines if line.strip()])


def default_name(paths: list[str]) -> str:
    """The name tag of an upload: the file's name, or that of the directory or common directory with .tar."""
    if len(paths) == 1 and not os.path.isdir(paths[0]):
        return os.path.basename(paths[0])
    name = os.path.basename(os.path.commonpath([os.path.abspath(p) for p in paths]))
    return f"{name or 'rootfs'}.tar"


class Repository:
    def __init__(self, spark: SparkSession, path: str, permissions: frozenset[str] | set[str] = ALL, key: Key | None = None, compression: str = "zstd:3", send_log: str | None = None):
        """send_log: a folder of this client's own, in which it keeps what it knows to be stored."""
        ck.parse_compression(compression)
        self.compression, self.send_log = compression, send_log
        self.spark, self.path, self.permissions, self.key = spark, path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file:") else path, allowed(permissions), key or Key()
        self._pointer = os.path.join(self.path, "current.json")

    # Storage.

    @staticmethod
    def init(spark: SparkSession, path: str, **more) -> Repository:
        repo = Repository(spark, path, **more)
        repo._need("init")
        os.makedirs(repo.path, exist_ok=True)
        if os.path.exists(repo._pointer):
            raise FileExistsError(path)
        repo._publish({"generation": uuid.uuid4().hex, "tables": {t: [] for t in TABLES}, "next_offset": 0})
        return repo

    def _need(self, permission: str) -> None:
        if permission not in self.permissions:
            raise NotPermitted(permission)

    def state(self) -> dict:
        with open(self._pointer) as f:
            return json.load(f)

    def _publish(self, state: dict) -> None:
        tmp = f"{self._pointer}.{uuid.uuid4().hex}"
        with open(tmp, "w") as f:
            json.dump(state, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, self._pointer)

    @contextmanager
    def _locked(self, then: Callable[[dict], None] | None = None) -> Iterator[dict]:
        """One writer at a time; what the block leaves in the state is published if it ends well, and `then` runs before others may write."""
        import fcntl

        with open(os.path.join(self.path, "lock"), "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            state = self.state()
            yield state
            self._publish(state)
            if then:
                then(state)

    def table(self, name: str, state: dict | None = None) -> DataFrame:
        files = (state or self.state())["tables"][name]
        if not files:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(os.path.join(self.path, f) for f in files))

    def _write(self, name: str, rows: DataFrame) -> str:
        part = f"{name}/{uuid.uuid4().hex}"
        self.spark.createDataFrame([], TABLES[name]).unionByName(rows, allowMissingColumns=True).write.parquet(os.path.join(self.path, part))
        return part

    def _append(self, state: dict, name: str, rows: DataFrame) -> DataFrame:
        part = self._write(name, rows)
        state["tables"][name].append(part)
        return self.spark.read.schema(TABLES[name]).parquet(os.path.join(self.path, part))

    def _replace(self, state: dict, name: str, rows: DataFrame) -> None:
        state["tables"][name] = [self._write(name, rows)]

    def _log(self, state: dict, op: str, item: dict | None = None, removed: list[str] | None = None, generation: str | None = None) -> int:
        at = state["next_offset"]
        row = [(at, op, item["item_id"] if item else None, removed, {**item, "log_offset": at} if item else None, generation)]
        self._append(state, "oplog", self.spark.createDataFrame(row, schemas.OPLOG))
        state["next_offset"] = at + 1
        return at

    # Adding.

    def _store(self, state: dict, item: str, kind: str, pieces: DataFrame) -> tuple[dict, dict]:
        """Store chunks (pos, address, data, n_bytes) and their tree; (tree, flush statistics).

        What the send log holds isn't offered; of the rest, what the store lacks is compressed, encrypted and written."""
        offered = pieces.select("address", "data", "n_bytes")
        if self.send_log:
            offered = sendlog.unsent(offered, self._known(state))
        fresh = ck.new_chunks(offered, self.table("chunks", state))
        fresh = self._append(state, "chunks", fresh.withColumn("data", ck.pack(F.col("data"), self.compression, self.key.data_key)))
        stats = ck.flush_stats(fresh).first().asDict()
        edges = htree.build(pieces.select(F.lit(f"{item}/{kind}").alias("tree_id"), "pos", "address"))
        rows = edges.collect()  # edges of one new tree: one for each chunk and node
        top = next(r for r in rows if r.pos < 0)
        own = [(r.parent, r.pos, r.height, r.leaf_count, r.child) for r in rows if r.pos >= 0]
        if own:
            held = self.table("htree", state).select("parent").distinct()
            new = self.spark.createDataFrame(own, schemas.HTREE_NODES).dropDuplicates(["parent", "pos"]).join(held, "parent", "left_anti")
            self._append(state, "htree", new)
        return {"address": top.child, "height": top.height, "data_chunk_count": top.leaf_count}, stats

    def _known(self, state: dict) -> DataFrame:
        """Rows of the send log that still hold: those of the store's generation, or of the log's item if the store has it."""
        names = sorted(os.listdir(self.send_log)) if os.path.isdir(self.send_log) else []
        if not names:
            return self.spark.createDataFrame([], schemas.SENT)
        log = self.spark.read.schema(schemas.SENT).parquet(os.path.join(self.send_log, names[-1]))
        last = log.select("item_id").first()
        kept = last.item_id if last and not self.table("items", state).where(F.col("item_id") == last.item_id).isEmpty() else None
        return sendlog.invalidate(log, state["generation"], kept)

    def _remember(self, state: dict, item: dict) -> None:
        """The send log after a put: the addresses of the item's trees."""
        if not self.send_log:
            return
        tops = self._tops(self.spark.createDataFrame([item], schemas.ITEMS))
        seen = htree.reachable(tops, self.table("htree", state)).join(self.table("chunks", state).select("address"), "address", "left_semi")
        log = sendlog.commit(sendlog.touch(self._known(state), seen, "address", state["generation"], item["item_id"]), item["item_id"], item["item_id"])
        names = sorted(os.listdir(self.send_log)) if os.path.isdir(self.send_log) else []
        part = os.path.join(self.send_log, f"{time.time_ns():020d}")
        log.write.parquet(part + ".tmp")
        os.rename(part + ".tmp", part)
        for name in names:
            shutil.rmtree(os.path.join(self.send_log, name))

    def _add_item(self, state: dict, item: dict) -> None:
        if not self.find_item(item["item_id"], state).isEmpty():
            raise ValueError("the item exists")
        at = self._log(state, schemas.ADD, item)
        self._append(state, "items", self.spark.createDataFrame([{**item, "log_offset": at}], schemas.ITEMS))

    def _new_item(self, tags: dict[str, str], now_millis: int | None) -> dict:
        if reserved := querylang.RESERVED & tags.keys():
            raise ValueError(f"reserved tags: {sorted(reserved)}")
        if sum(len(k.encode()) + len(v.encode()) for k, v in tags.items()) > MAX_TAG_BYTES:
            raise ValueError("tags are too large")
        clock = int(time.time() * 1000)
        if now_millis is not None and self.check_clock and abs(clock - now_millis) > MAX_SKEW_S * 1000:
            raise ValueError("the clocks differ by more than 15 minutes")
        return {"item_id": uuid.uuid4().hex, "primary_key_id": self.key.primary, "put_key_id": self.key.key_id, "unix_timestamp_millis": now_millis if now_millis is not None else clock, "tags": tags}

    check_clock = False

    def put_bytes(self, data: bytes, tags: dict[str, str] | None = None, now_millis: int | None = None, **sizes) -> str:
        self._need("put")
        item = self._new_item(dict(tags or {}), now_millis)
        stream = self.spark.createDataFrame([(item["item_id"], bytearray(data))], "stream_id string, data binary")
        with self._locked() as state:
            pieces = ck.chunk_streams(stream, self.key.seed, self.key.address_key, **sizes)
            tree, self.last_stats = self._store(state, item["item_id"], "data", pieces)
            item |= {"data_size": len(data), "index_size": 0, "data_tree": tree, "index_tree": None}
            self._add_item(state, item)
        self._remember(state, item)
        return item["item_id"]

    def put_file(self, path: str, tags: dict[str, str] | None = None, **more) -> str:
        with open(path, "rb") as f:
            return self.put_bytes(f.read(), {"name": os.path.basename(path), **(tags or {})}, **more)

    def put_command(self, command: list[str], tags: dict[str, str] | None = None, **more) -> str:
        """The output of a command, which counts only if the command succeeds."""
        done = subprocess.run(command, capture_output=True, check=True)
        return self.put_bytes(done.stdout, tags, **more)

    def put_dir(self, paths: str | list[str], tags: dict[str, str] | None = None, exclude: list[str] = (), exclude_if_present: list[str] = (), now_millis: int | None = None, hashes: bool = True, xattrs: bool = False, **sizes) -> str:
        """A directory, or several paths below their common one: an index, and the files' bytes as one chunked stream in index order."""
        from .functions import globs
        from .sources.directory import DirectorySource

        self._need("put")
        paths = [paths] if isinstance(paths, str) else list(paths)
        item = self._new_item({"name": default_name(paths), **(tags or {})}, now_millis)
        self.spark.dataSource.register(DirectorySource)
        found = self.spark.read.format("directory").option("paths", "\n".join(paths)).option("hash", str(hashes).lower()).option("xattrs", str(xattrs).lower()).load()
        found = index.exclude(found, [globs.exclusion(g) for g in exclude], "abs_path")
        if exclude_if_present:
            found = index.exclude_marked(found, list(exclude_if_present), "abs_path")
        rows = index.normalized_devices(found).drop("dev").withColumn("rank", F.row_number().over(Window.orderBy(scalars.path_key(F.col("path"))))).orderBy("rank").collect()
        # The bytes of one upload are one stream, so they are read here in order; chunks and entries go to tables.
        body, entries, at = io.BytesIO(), [], 0
        for r in rows:
            size = 0
            if (r.mode & scalars.TYPE_MASK) == scalars.REGULAR:
                try:
                    with open(r.abs_path, "rb") as f:
                        size = body.write(f.read())
                except FileNotFoundError:
                    continue
                except PermissionError:
                    size = 0
            entries.append((r, at, size))
            at += size
        data = body.getvalue()
        ends = ck.split_points(data, ck.gear_table(self.key.seed), **sizes) or [0]
        starts = [0, *ends[:-1]]
        table = []
        for r, a, size in entries:
            first = min(bisect.bisect_right(starts, a) - 1, len(starts) - 1)
            last = min(bisect.bisect_right(starts, a + size) - 1, len(starts) - 1)
            if size and a + size == len(data):
                last = len(starts) - 1
            # A cursor is relative to the chunk in which the entry before it ended.
            table.append((r, {"chunk_delta": last - first if size else 0, "start_byte_offset": a - starts[first], "end_byte_offset": a + size - starts[last] if size else a - starts[first]}, size))
        stream = self.spark.createDataFrame([(item["item_id"], bytearray(data))], "stream_id string, data binary")
        with self._locked() as state:
            tree, self.last_stats = self._store(state, item["item_id"], "data", ck.chunk_streams(stream, self.key.seed, self.key.address_key, **sizes))
            names = [c.split()[0] for c in schemas.INDEX_ENTRIES.split(", ") if c.split()[0] in rows[0].__fields__] if rows else []
            out = [{**{k: r[k] for k in names}, "item_id": item["item_id"], "seq": k, "size": size if (r.mode & scalars.TYPE_MASK) == scalars.REGULAR else 0, "data_cursor": cursor} for k, (r, cursor, size) in enumerate(table)]
            self._append(state, "index_entries", self.spark.createDataFrame(out, schemas.INDEX_ENTRIES))
            encoded = json.dumps([{k: v for k, v in o.items() if k not in ("path_bytes", "xattrs")} for o in out]).encode()
            stream = self.spark.createDataFrame([(item["item_id"], bytearray(encoded))], "stream_id string, data binary")
            index_tree, _ = self._store(state, item["item_id"], "index", ck.chunk_streams(stream, self.key.seed, self.key.address_key, **sizes))
            item |= {"data_size": len(data), "index_size": len(encoded), "data_tree": tree, "index_tree": index_tree}
            self._add_item(state, item)
        self._remember(state, item)
        return item["item_id"]

    # Reading.

    def find_item(self, item_id: str, state: dict | None = None) -> DataFrame:
        """An item by id, removed ones that weren't collected included."""
        return self.table("items", state).unionByName(self.table("removed", state)).where(F.col("item_id") == item_id.lower())

    def read_items(self, ids: list[str]) -> DataFrame:
        """The items of these ids, removed ones that weren't collected included, in the order of the list; an error names ids that are missing."""
        asked = self.spark.createDataFrame([(k, i.lower()) for k, i in enumerate(checked_ids(ids))], "place long, item_id string")
        known = self.table("items").unionByName(self.table("removed"))
        if lost := [r.item_id for r in asked.join(known, "item_id", "left_anti").orderBy("place").limit(10).collect()]:
            raise NoMatch(f"no such items: {', '.join(lost)}")
        return asked.join(known, "item_id").orderBy("place").drop("place")

    def list(self, query: str | list[str] | None = None, now_millis: int | None = None, encrypted: bool = False, utc: bool = True) -> DataFrame:
        """Live items in log order with their tags, synthetic ones included."""
        self._need("list")
        if not encrypted and not self.key.can_list:
            raise NotPermitted("this key can't list")
        items = self.table("items")
        ts = F.timestamp_millis("unix_timestamp_millis")
        if encrypted:
            tags = F.create_map(F.lit("id"), F.col("item_id"), F.lit("decryption-key-id"), F.col("primary_key_id"))
        else:
            items = items.where(F.col("primary_key_id") == self.key.primary)
            tags = scalars.synthetic_tags(F.col("tags"), F.col("item_id"), ts, F.coalesce("data_size", F.lit(0)) + F.coalesce("index_size", F.lit(0)))
        out = items.withColumn("tags", tags)
        if query:
            age = (F.lit(int(time.time() * 1000) if now_millis is None else now_millis) - F.col("unix_timestamp_millis")) * 1_000_000
            out = out.where(querylang.compile_query(querylang.parse(query), querylang.map_lookup(F.col("tags")), age, encrypted))
        return out.orderBy("log_offset")

    def one(self, query: str | list[str]) -> dict:
        """The item that a query matches; an id alone is looked up without a scan."""
        item_id = querylang.single_id(querylang.parse(query))
        if item_id:
            self._need("list")
            if not self.key.can_list:
                raise NotPermitted("this key can't list")
        found = (self.find_item(item_id).where(F.col("primary_key_id") == self.key.primary) if item_id else self.list(query)).limit(2).collect()
        if not found:
            raise NoMatch(f"nothing matches {query!r}")
        if len(found) > 1:
            raise ManyMatches(f"several items match {query!r}")
        return found[0].asDict(recursive=True)

    def _leaves(self, tree: dict, ranges: DataFrame | None = None) -> DataFrame:
        top = self.spark.createDataFrame([("t", tree["address"], tree["height"], tree["data_chunk_count"])], "tree_id string, root string, height int, data_chunk_count long")
        return htree.leaf_positions(top, self.table("htree"), ranges).select(F.col("idx").alias("pos"), "address")

    def get(self, query: str | list[str], pick: str | None = None) -> bytes:
        """The bytes of an item; of a snapshot a tar archive, or with `pick` one file's bytes or a directory's archive."""
        self._need("get")
        if not self.key.can_get:
            raise NotPermitted("this key can't get")
        item = self.one(query)
        if item["index_tree"] is None or not pick:
            pieces = self._fetch(self._leaves(item["data_tree"])).toLocalIterator()
            data = b"".join(self._checked(r) for r in pieces)
            if len(data) != item["data_size"]:
                raise ValueError("the data has another length than was recorded")
            if item["index_tree"] is None:
                return data
        entries = self.table("index_entries").where(F.col("item_id") == item["item_id"])
        if not pick:
            offsets = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
            entries = entries.withColumn("at", F.coalesce(F.sum("size").over(offsets), F.lit(0)))
            return self.tar(index.hard_links(entries).orderBy(scalars.path_key(F.col("path"))).toLocalIterator(), lambda e: data[e.at : e.at + e.size])
        kind = index.picked_kind(entries, pick)
        own = index.below(F.col("path"), pick.rstrip("/")) if kind == "directory" else F.col("path") == pick.rstrip("/")
        body = self._bodies(item, entries, own)
        chosen = index.absolute_chunks(entries).where(own)
        if kind == "regular":
            return body(chosen.first())
        return self.tar(index.hard_links(index.pick(chosen, pick)).orderBy(scalars.path_key(F.col("path"))).toLocalIterator(), body)

    def _bodies(self, item: dict, entries: DataFrame, own: Column) -> Callable:
        """The bytes of an entry (first_chunk, data_cursor), from the chunks alone that hold the entries `own`: other sub-trees aren't walked, other chunks aren't read."""
        ranges = index.chunk_ranges(entries, selected=own).select(F.lit("t").alias("tree_id"), "start_idx", "end_idx")
        found = self._fetch(self._leaves(item["data_tree"], ranges)).toLocalIterator()
        held = {r.pos: self._checked(r) for r in found}  # what was asked for, and the rest of its chunks
        self.last_fetched = len(held)

        def body(e) -> bytes:
            if not e.size:
                return b""
            c, first = e.data_cursor, e.first_chunk
            if not c.chunk_delta:
                return held[first][c.start_byte_offset : c.end_byte_offset]
            parts = [held[first][c.start_byte_offset :], *(held[first + k] for k in range(1, c.chunk_delta)), held[first + c.chunk_delta][: c.end_byte_offset] if c.end_byte_offset else b""]
            return b"".join(parts)

        return body

    def _fetch(self, leaves: DataFrame) -> DataFrame:
        return ck.fetch(leaves, self.table("chunks")).withColumn("data", ck.unpack(F.col("data"), self.key.data_key))

    def _checked(self, row) -> bytes:
        data = bytes(row.data) if row.data is not None else None
        if data is None or ck.address_of(data, self.key.address_key) != row.address:
            raise ValueError(f"chunk {row.address} is missing or changed")
        return data

    @staticmethod
    def tar(entries, content: Callable) -> bytes:
        """A PAX archive of entries (path, size, mode, ..., first_path) with what `content` gives for each file; an error if that isn't what was hashed."""
        types = {scalars.REGULAR: tarfile.REGTYPE, scalars.DIRECTORY: tarfile.DIRTYPE, scalars.SYMLINK: tarfile.SYMTYPE, scalars.CHARACTER: tarfile.CHRTYPE, scalars.BLOCK: tarfile.BLKTYPE, scalars.FIFO: tarfile.FIFOTYPE}
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
            for e in entries:
                info = tarfile.TarInfo(e.path)
                info.type = types.get(e.mode & scalars.TYPE_MASK, tarfile.REGTYPE)
                info.mode, info.uid, info.gid, info.mtime = e.mode & 0o7777, e.uid, e.gid, e.mtime
                info.devmajor, info.devminor, info.linkname = e.dev_major or 0, e.dev_minor or 0, e.link_target or ""
                info.pax_headers = {f"SCHILY.xattr.{bytes(k).decode()}": bytes(v).decode("utf-8", "surrogateescape") for k, v in (e.xattrs or {}).items()}
                body = b""
                if e.first_path:
                    info.type, info.linkname = tarfile.LNKTYPE, e.first_path
                elif info.type == tarfile.REGTYPE:
                    body = content(e)
                    if len(body) != e.size or e.data_hash and e.data_hash != "sha256:" + hashlib.sha256(body).hexdigest():
                        raise ValueError(f"{e.path} has other contents than were recorded")
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
        return out.getvalue()

    def list_contents(self, query: str | list[str], pick: str | None = None) -> DataFrame:
        self._need("list")
        if not self.key.can_list_contents:
            raise NotPermitted("this key can't list contents")
        item = self.one(query)
        entries = self.table("index_entries").where(F.col("item_id") == item["item_id"])
        if pick and index.picked_kind(entries, pick) != "directory":
            raise ValueError(f"not a directory: {pick}")
        return index.pick(entries, pick or ".").orderBy(scalars.path_key(F.col("path")))

    def local_index(self, path: str, hashes: bool = True) -> DataFrame:
        from .sources.directory import DirectorySource

        self.spark.dataSource.register(DirectorySource)
        found = self.spark.read.format("directory").option("paths", path).option("hash", str(hashes).lower()).load()
        none = F.lit(None).cast("struct<chunk_delta: bigint, start_byte_offset: bigint, end_byte_offset: bigint>")
        return index.normalized_devices(found).withColumn("item_id", F.lit(None).cast("string")).withColumn("data_cursor", none)

    def diff(self, left: str | list[str], right: str | list[str], ignore: str | None = None, relaxed: bool = False, left_pick: str | None = None, right_pick: str | None = None) -> DataFrame:
        """Changes between two sides, each a query or, with a leading / or ./, a local directory."""
        columns = [c.split()[0] for c in schemas.INDEX_ENTRIES.split(", ")]
        columns = [c for c in columns if c in self.table("index_entries").columns and c not in ("item_id", "seq")]
        sides = []
        for side, pick in ((left, left_pick), (right, right_pick)):
            local = isinstance(side, str) and side.startswith(("/", "./"))
            entries = index.pick(self.local_index(side), pick or ".") if local else self.list_contents(side, pick)
            sides.append(entries.select(*columns))
        return index.in_listing_order(index.diff(*sides, index.ignored(ignore, relaxed)), "step")

    def plan_restore(self, target: str, query: str | list[str], pick: str | None = None) -> DataFrame:
        self._need("get")
        columns = [c for c in self.table("index_entries").columns if c not in ("item_id", "seq")]
        return index.restore_plan(self.local_index(target).select(*columns), self.list_contents(query, pick).select(*columns))

    def plan_attributes(self, target: str, query: str | list[str], pick: str | None = None) -> DataFrame:
        """Entries whose permissions, extended attributes or times differ from the snapshot's: the second step of a restore, once contents are equal."""
        self._need("get")
        columns = [c for c in self.table("index_entries").columns if c not in ("item_id", "seq")]
        changed = index.diff(self.local_index(target).select(*columns), self.list_contents(query, pick).select(*columns), index.RESTORE_ATTRIBUTES)
        return changed.where("op = '+'")

    def restore(self, target: str, query: str | list[str], pick: str | None = None) -> int:
        """Make a local directory equal a snapshot: deletions from the leaves up, directories, files, links, then attributes. Returns the steps taken."""
        steps = sorted(self.plan_restore(target, query, pick).collect(), key=lambda r: (r.phase, r.path if r.phase else "", r.step))
        archive = tarfile.open(fileobj=io.BytesIO(self.get(query, pick)))
        for r in sorted((r for r in steps if r.action == "delete"), key=lambda r: r.path.count("/"), reverse=True):
            own = os.path.join(target, r.path)
            if os.path.isdir(own) and not os.path.islink(own):
                os.rmdir(own)
            else:
                os.unlink(own)
        wanted = {r.path for r in steps if r.action != "delete"}
        for member in archive:
            if member.name in wanted and member.name != ".":
                archive.extract(member, target, filter="tar")
        entries = self.plan_attributes(target, query, pick).orderBy(scalars.path_key(F.col("path"))).collect()
        for e in reversed(entries):
            own = os.path.join(target, e.path) if e.path != "." else target
            if (e.mode & scalars.TYPE_MASK) != scalars.SYMLINK:
                os.chmod(own, e.mode & 0o7777)
                os.utime(own, ns=(e.mtime * 10**9 + e.mtime_nsec,) * 2)
        return len(steps)

    # Life cycle.

    def rm(self, query: str | list[str] | None = None, ids: list[str] | None = None, allow_many: bool = False) -> int:
        """Remove what a query or a list of ids names; returns how many items were live."""
        self._need("remove")
        if ids is None:
            ids = [r.item_id for r in self.list(query).select("item_id").collect()]
            if len(ids) > 1 and not allow_many:
                raise ManyMatches("the query matches several items")
        named = self.spark.createDataFrame([(i.lower(),) for i in set(checked_ids(ids))], "item_id string")
        with self._locked() as state:
            gone = self.table("items", state).join(named, "item_id", "left_semi").collect()
            if gone:
                rows = self.spark.createDataFrame(gone, schemas.ITEMS)
                rest = self.table("items", state).join(named, "item_id", "left_anti")
                self._append(state, "removed", rows.select(*self.table("removed", state).columns))
                self._replace(state, "items", rest)
                self._log(state, schemas.REMOVE, removed=[r.item_id for r in gone])
        return len(gone)

    def recover_removed(self) -> int:
        """Bring back all removed items that weren't collected, at their places in the log."""
        for p in ("get", "put", "list"):
            self._need(p)
        with self._locked() as state:
            gone = self.table("removed", state)
            n = gone.count()
            if n:
                self._append(state, "items", gone)
                state["tables"]["removed"] = []
                self._log(state, schemas.RECOVER)
        return n

    def _tops(self, items: DataFrame) -> DataFrame:
        trees = F.array("data_tree", "index_tree")
        return items.select(F.explode(trees).alias("t")).where("t IS NOT NULL").select(F.col("t.address").alias("root"), "t.height")

    def _sweep(self, state: dict, marks: DataFrame) -> dict:
        """Leave marked chunks only. Addresses decide; data are read of those parts alone that hold a dead chunk."""
        stored = self.table("chunks", state)
        stats = ck.sweep_stats(stored, marks).first().asDict()
        dead = stored.select("address", F.col("_metadata.file_path").alias("file")).join(marks, "address", "left_anti") if state["tables"]["chunks"] else None
        files = [] if dead is None else [r.file for r in dead.select("file").distinct().collect()]  # one name for each file
        touched = {p for p in state["tables"]["chunks"] if any(f"/{p}/" in f for f in files)}
        if touched:
            old = self.spark.read.schema(TABLES["chunks"]).parquet(*(os.path.join(self.path, p) for p in sorted(touched)))
            kept = self._write("chunks", old.join(marks, "address", "left_semi"))
            state["tables"]["chunks"] = [p for p in state["tables"]["chunks"] if p not in touched] + [kept]
        return stats

    def _tidy(self, state: dict) -> None:
        """Delete parts that the published version doesn't name: what a collection replaced, and what failed writers left."""
        named = {p for parts in state["tables"].values() for p in parts}
        for name in TABLES:
            folder = os.path.join(self.path, name)
            for part in os.listdir(folder) if os.path.isdir(folder) else ():
                if f"{name}/{part}" not in named:
                    shutil.rmtree(os.path.join(folder, part))

    def gc(self) -> dict:
        """Forget removed items, compact the log and delete unreachable chunks, with their files; a new generation invalidates caches.

        It excludes writers; a reader that still holds a frame of an older version must read again."""
        self._need("gc")
        with self._locked(self._tidy) as state:
            items = self.table("items", state)
            marks = htree.reachable(self._tops(items), self.table("htree", state))
            edges = self.table("htree", state)
            stats = self._sweep(state, marks)
            self._replace(state, "htree", edges.join(marks, edges["parent"] == marks["address"], "left_semi"))
            self._replace(state, "index_entries", self.table("index_entries", state).join(items.select("item_id"), "item_id", "left_semi"))
            self._replace(state, "oplog", oplog.compact(self.table("oplog", state), items))
            state["tables"]["removed"] = []
            state["generation"] = uuid.uuid4().hex
        return stats

    def sync(self, to: Repository, query: str | list[str] | None = None) -> dict:
        """Copy items, and the chunks that the other repository lacks; items that it holds or holds as removed are left alone."""
        self._need("sync")
        to._need("sync")
        with to._locked() as state:
            source = self.list(query, encrypted=True) if query else self.table("items")
            held = to.table("items", state).select("item_id").unionByName(to.table("removed", state).select("item_id"))
            new = self.table("items").join(source.select("item_id"), "item_id", "left_semi").join(held, "item_id", "left_anti")
            rows = new.orderBy("log_offset").collect()
            marks = htree.reachable(self._tops(new), self.table("htree")) if rows else None
            copied = {"added_chunks": 0, "added_bytes": 0}
            if rows:
                missing = self.table("chunks").join(marks, "address", "left_semi").join(to.table("chunks", state).select("address"), "address", "left_anti")
                copied = ck.flush_stats(to._append(state, "chunks", missing)).first().asDict()
                edges = self.table("htree")
                edges = edges.join(marks, edges["parent"] == marks["address"], "left_semi").join(to.table("htree", state).select("parent").distinct(), "parent", "left_anti")
                to._append(state, "htree", edges)
                to._append(state, "index_entries", self.table("index_entries").join(new.select("item_id"), "item_id", "left_semi"))
                placed = [{**r.asDict(recursive=True), "log_offset": state["next_offset"] + k} for k, r in enumerate(rows)]
                to._append(state, "oplog", self.spark.createDataFrame([(i["log_offset"], schemas.ADD, i["item_id"], None, i, None) for i in placed], schemas.OPLOG))
                to._append(state, "items", self.spark.createDataFrame(placed, schemas.ITEMS))
                state["next_offset"] += len(placed)
        return copied | {"items": len(rows)}

    def verify(self) -> DataFrame:
        """(kind, address) of chunks and nodes that don't hash to their addresses, and of leaves that are missing."""
        key = self.key.address_key
        plain = ck.unpack(F.col("data"), self.key.data_key)
        bad = self.table("chunks").where(F.coalesce(scalars.content_address(plain, key or None) != F.col("address"), F.lit(True))).select(F.lit("chunk").alias("kind"), "address")
        torn = htree.verify(self.table("htree")).select(F.lit("node").alias("kind"), F.col("parent").alias("address"))
        edges = self.table("htree").select("parent").distinct()
        known = self.table("chunks").select("address").unionByName(edges.toDF("address"))
        lost = htree.reachable(self._tops(self.table("items")), self.table("htree")).join(known, "address", "left_anti").select(F.lit("missing").alias("kind"), "address")
        return bad.unionByName(torn).unionByName(lost)
