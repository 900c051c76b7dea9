"""File indexes as relations: sub-tree picks, diffs under a mask, hard links, devices and data ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DIRECTORY, REGULAR, TYPE_MASK, file_type, path_key

#: Attribute groups of a comparison, by the name that ignores them.
GROUPS: dict[str, tuple[str, ...]] = {
    "type": ("mode & 61440",),
    "perms": ("mode & ~61440",),
    "size": ("size",),
    "data_hash": ("data_hash",),
    "mtime": ("mtime", "mtime_nsec"),
    "ctime": ("ctime", "ctime_nsec"),
    "dev": ("norm_dev",),
    "uid": ("uid",),
    "gid": ("gid",),
    "inode": ("ino",),
    "nlink": ("nlink",),
    "link_target": ("link_target",),
    "devnos": ("dev_major", "dev_minor"),
    "xattrs": ("array_sort(map_entries(xattrs))",),
    "cursors": ("data_cursor",),
}
ALIASES = {"times": ("mtime", "ctime"), "file-content": ("size", "data_hash"), "content": ("size", "data_hash"), "ino": ("inode",)}
RELAXED = frozenset({"mtime", "ctime", "dev", "uid", "gid", "inode", "nlink", "xattrs", "cursors"})
#: Restoring compares contents first, attributes second.
RESTORE_CONTENT = frozenset(GROUPS) - {"type", "link_target", "devnos", "data_hash"}
RESTORE_ATTRIBUTES = frozenset(GROUPS) - {"perms", "xattrs", "mtime"}


def ignored(names: str | None = None, relaxed: bool = False) -> frozenset[str]:
    """The groups that a comma-separated list ignores, always with the cursors."""
    out = set(RELAXED if relaxed else ()) | {"cursors"}
    for name in filter(None, (names or "").split(",")):
        if name not in GROUPS and name not in ALIASES:
            raise ValueError(f"unknown attribute {name!r}")
        out |= set(ALIASES.get(name, (name,)))
    return frozenset(out)


def signature(columns: list[str], ignore: frozenset[str]) -> Column:
    """One comparable value of all compared groups that the relation has; nulls equal nulls."""
    kept = [e for name, exprs in GROUPS.items() if name not in ignore for e in exprs if any(c in e.replace("(", " ").replace(")", " ").split() for c in columns)]
    return F.struct(F.lit(0).alias("z"), *(F.expr(e).alias(f"g{k}") for k, e in enumerate(kept)))


def diff(left: DataFrame, right: DataFrame, ignore: frozenset[str] = frozenset({"cursors"}), unchanged: bool = False) -> DataFrame:
    """(op, the columns of the entry): `-` of the left and `+` of the right; a changed entry is both, in this order. Paths are unique on each side."""
    columns = left.columns
    sides = [s.select(F.col("path"), signature(columns, ignore).alias(f"{n}_sig"), F.struct(*columns).alias(n)) for s, n in ((left, "l"), (right, "r"))]
    both = sides[0].join(sides[1], "path", "full_outer")
    same = F.col("l").isNotNull() & F.col("r").isNotNull() & F.col("l_sig").eqNullSafe(F.col("r_sig"))
    none = F.lit(None).cast("string")
    ops = F.array(
        F.struct(F.when(same, F.lit("=") if unchanged else none).when(F.col("l").isNotNull(), "-").alias("op"), F.col("l").alias("entry"), F.lit(0).alias("step")),
        F.struct(F.when(same, none).when(F.col("r").isNotNull(), "+").alias("op"), F.col("r").alias("entry"), F.lit(1).alias("step")),
    )
    return both.select(F.explode(ops).alias("x")).where("x.op IS NOT NULL").select("x.op", "x.step", "x.entry.*")


def in_listing_order(entries: DataFrame, *more: str) -> DataFrame:
    return entries.orderBy(path_key(F.col("path")), *more)


def with_places(rows: DataFrame, key: Column, unique: Column, place: str = "place", ranges: int = 256) -> DataFrame:
    """rows with their place by `key`, from 1, nulls last; `unique` names a row and breaks ties.

    Bounds cut the keys into ranges; the rank within a range and the sizes of those before it need no single task. A row's
    range follows from its key and from the rows' hashes alone, so every reading of the rows agrees on it, whatever the
    layout, a retry or a changed plan. The bounds come from the few rows with the least hashes and only balance the ranges.
    """
    keyed = rows.withColumn("_key", key).withColumn("_unique", unique)
    bounds = keyed.where("_key IS NOT NULL").orderBy(F.xxhash64("_unique"), "_unique").limit(ranges - 1).agg(F.sort_array(F.collect_list("_key")).alias("_bounds"))

    def search(low: Column, step: Column) -> Column:
        return F.when(F.get("_bounds", low + step - 1) <= F.col("_key"), low + step).otherwise(low)

    steps = F.array(*(F.lit(1 << k) for k in reversed(range((ranges - 1).bit_length()))))
    own = keyed.crossJoin(F.broadcast(bounds)).withColumn("_range", F.when(F.col("_key").isNull(), ranges).otherwise(F.aggregate(steps, F.lit(0), search))).drop("_bounds")
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = own.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("_key").asc_nulls_last(), "_unique"))
    return own.withColumn(place, rank).join(F.broadcast(sizes), "_range").withColumn(place, F.col(place) + F.col("_before")).drop("_key", "_unique", "_range", "_before")


def below(path: Column, root: str) -> Column:
    """If a path is the root or lies below it."""
    root = root.rstrip("/")
    return F.lit(True) if root in ("", ".") else (path == root) | path.startswith(f"{root}/")


def pick(entries: DataFrame, root: str) -> DataFrame:
    """The sub-tree of a directory, its root as `.`."""
    root = root.rstrip("/")
    if root in ("", "."):
        return entries
    rebased = F.when(F.col("path") == root, ".").otherwise(F.substring("path", len(root) + 2, 1 << 30))
    return entries.where(below(F.col("path"), root)).withColumn("path", rebased)


def picked_kind(entries: DataFrame, root: str) -> str:
    """`directory` or `regular`; an error if the path is missing or can't be picked."""
    rows = entries.where(F.col("path") == (root.rstrip("/") or ".")).select("mode").limit(2).collect()
    if not rows:
        raise LookupError(f"no such path: {root}")
    kind = rows[0].mode & TYPE_MASK
    if kind not in (DIRECTORY, REGULAR):
        raise ValueError(f"not a file or directory: {root}")
    return "directory" if kind == DIRECTORY else "regular"


def hard_links(entries: DataFrame, *by: str) -> DataFrame:
    """Entries with `first_path`, the first entry of the same file where that is another one. Directories and single links have none."""
    own = Window.partitionBy(*by, "norm_dev", "ino").orderBy("seq")
    first = F.first_value("path").over(own)
    linked = (F.col("nlink") > 1) & (file_type(F.col("mode")) != DIRECTORY)
    return entries.withColumn("first_path", F.when(linked & (F.row_number().over(own) > 1), first))


def normalized_devices(entries: DataFrame, dev: str = "dev", seq: str = "seq") -> DataFrame:
    """norm_dev: devices numbered from 0 in order of first appearance. Only one row a device is ranked, and joined back."""
    firsts = entries.groupBy(dev).agg(F.min(seq).alias("first_seq"))
    ranked = firsts.withColumn("norm_dev", (F.dense_rank().over(Window.orderBy("first_seq")) - 1).cast("long")).drop("first_seq")
    return entries.join(ranked, dev)


def absolute_chunks(entries: DataFrame, *by: str) -> DataFrame:
    """Entries with the absolute index of their first chunk (`first_chunk`): the chunk deltas before them, added up."""
    own = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("first_chunk", F.coalesce(F.sum("data_cursor.chunk_delta").over(own), F.lit(0)))


def chunk_ranges(entries: DataFrame, *by: str, selected: Column | None = None) -> DataFrame:
    """(by..., start_idx, end_idx): inclusive ranges of the chunks that hold the selected entries' data, joined where they touch.

    An entry that ends on a chunk boundary doesn't need the chunk behind it."""
    placed = absolute_chunks(entries, *by)
    if selected is not None:
        placed = placed.where(selected)
    delta, end = F.col("data_cursor.chunk_delta"), F.col("data_cursor.end_byte_offset")
    spans = placed.where("size > 0").select(*by, "seq", F.col("first_chunk").alias("s"), (F.col("first_chunk") + delta - F.when((delta > 0) & (end == 0), 1).otherwise(0)).alias("e"))
    own = Window.partitionBy(*by).orderBy("seq")
    before = F.lag("e").over(own)
    marked = spans.withColumn("opens", F.when((F.col("s") == before) | (F.col("s") == before + 1), 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("opens").over(own))
    return islands.groupBy(*by, "island").agg(F.min("s").alias("start_idx"), F.max("e").alias("end_idx")).drop("island")


def partial_chunks(entries: DataFrame, *by: str, selected: Column | None = None) -> DataFrame:
    """(by..., chunk_idx, start, stop): merged byte ranges wanted of chunks that aren't wanted whole; stop is null for "to the end"."""
    placed = absolute_chunks(entries, *by)
    if selected is not None:
        placed = placed.where(selected)
    c = F.col("data_cursor")
    piece = lambda idx, a, b: F.struct(idx.alias("chunk_idx"), a.alias("start"), b.alias("stop"))
    top = F.lit((1 << 62)).cast("long")
    single = F.array(piece(F.col("first_chunk"), c["start_byte_offset"], c["end_byte_offset"]))
    spread = F.array(piece(F.col("first_chunk"), c["start_byte_offset"], top), piece(F.col("first_chunk") + c["chunk_delta"], F.lit(0).cast("long"), c["end_byte_offset"]))
    pieces = placed.where("size > 0").select(*by, F.explode(F.when(c["chunk_delta"] == 0, single).otherwise(spread)).alias("p")).select(*by, "p.*").where("start < stop")
    own = Window.partitionBy(*by, "chunk_idx").orderBy("start", "stop")
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = pieces.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("opens").over(own))
    merged = islands.groupBy(*by, "chunk_idx", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")
    return merged.where((F.col("start") > 0) | (F.col("stop") < top)).withColumn("stop", F.when(F.col("stop") < top, F.col("stop")))


def exclude(entries: DataFrame, globs: list, path: str = "path") -> DataFrame:
    """Entries that no exclusion matches, nor a directory above them does."""
    if not globs:
        return entries
    above = F.expr(f"transform(sequence(1, size(split({path}, '/'))), i -> array_join(slice(split({path}, '/'), 1, i), '/'))")
    return entries.where(~F.exists(above, lambda p: reduce(lambda a, b: a | b, (F.coalesce(g.column(p), F.lit(False)) for g in globs))))


def exclude_marked(entries: DataFrame, markers: list[str], path: str = "path") -> DataFrame:
    """Of directories that hold a marker, only the marker entries (and the directory itself); nothing below."""
    name, parent = F.substring_index(path, "/", -1), F.regexp_replace(F.col(path), "/[^/]*$", "")
    marked = entries.where(name.isin(*markers)).select(parent.alias("dir")).distinct()
    above = F.expr(f"transform(sequence(1, size(split({path}, '/')) - 1), i -> array_join(slice(split({path}, '/'), 1, i), '/'))")
    inside = entries.where(F.size(F.split(path, "/")) > 1).select(F.col(path).alias("p"), F.explode(above).alias("dir"))
    hidden = inside.join(marked, "dir", "left_semi").where(~(F.substring_index("p", "/", -1).isin(*markers) & (F.regexp_replace("p", "/[^/]*$", "") == F.col("dir")))).select("p").distinct()
    return entries.join(hidden, entries[path] == hidden["p"], "left_anti")


def upcast(entries: DataFrame, version: int) -> DataFrame:
    """Index rows of an older version as current ones: what a version lacks is null, `sparse` false before 4, hashes absent in 1."""
    have, out = set(entries.columns), entries
    if "sparse" not in have or version < 4:
        out = out.withColumn("sparse", F.lit(False))
    if version == 1 or "data_hash" not in have:
        out = out.withColumn("data_hash", F.lit(None).cast("string"))
    if version < 3 or "data_cursor" not in have:
        out = out.withColumn("data_cursor", F.lit(None).cast("struct<chunk_delta: bigint, start_byte_offset: bigint, end_byte_offset: bigint>"))
    return out


def restore_plan(target: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(action, path, ...): what makes a directory equal the snapshot: delete, mkdir, download, special, in the order of `phase`, then `place`."""
    changes = diff(target, snapshot, RESTORE_CONTENT)
    kind = file_type(F.col("mode"))
    action = F.when(F.col("op") == "-", "delete").when(kind == DIRECTORY, "mkdir").when(kind == REGULAR, "download").otherwise("special")
    phase = F.when(F.col("op") == "-", 0).when(kind == DIRECTORY, 1).when(kind == REGULAR, 2).otherwise(3)
    return changes.withColumn("action", action).withColumn("phase", phase)


def exclude_by_root(entries: DataFrame, roots: list[str], path: str = "path") -> DataFrame:
    """Entries below none of the roots."""
    return entries.where(~reduce(lambda a, b: a | b, (below(F.col(path), r) for r in roots), F.lit(False)))
