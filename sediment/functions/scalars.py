"""Scalar functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the mode word: file types under their mask.
TYPE_MASK = 0o170000
FIFO, CHARACTER, DIRECTORY, BLOCK, REGULAR, SYMLINK, SOCKET = 0o010000, 0o020000, 0o040000, 0o060000, 0o100000, 0o120000, 0o140000
#: Kind name, listing letter and first letter of the mode string of each type.
KINDS = {
    REGULAR: ("regular", "f", "-"),
    SYMLINK: ("symlink", "l", "l"),
    CHARACTER: ("char", "c", "c"),
    DIRECTORY: ("directory", "d", "d"),
    BLOCK: ("block", "b", "b"),
    FIFO: ("fifo", "p", "p"),
}
SIZE_UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB")


def file_type(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(TYPE_MASK))


def _by_kind(mode: Column, place: int, other: str) -> Column:
    kind, out = file_type(mode), None
    for value, names in KINDS.items():
        out = F.when(kind == value, names[place]) if out is None else out.when(kind == value, names[place])
    return out.otherwise(other)


def kind(mode: Column) -> Column:
    return _by_kind(mode, 0, "other")


def type_char(mode: Column) -> Column:
    return _by_kind(mode, 1, "?")


def display_mode(mode: Column) -> Column:
    """Ten characters: the type, then read, write and execute of user, group and others; s and t mark the special bits, in upper case without execute."""
    parts = [_by_kind(mode, 2, "?")]
    for shift, special, low in ((6, 0o4000, "s"), (3, 0o2000, "s"), (0, 0o1000, "t")):
        def bit(b: int) -> Column:
            return mode.bitwiseAND(F.lit(b)) != 0
        run = bit(1 << shift)
        parts += [
            F.when(bit(4 << shift), "r").otherwise("-"),
            F.when(bit(2 << shift), "w").otherwise("-"),
            F.when(bit(special) & run, low).when(bit(special), low.upper()).when(run, "x").otherwise("-"),
        ]
    return F.concat(*parts)


def format_size(n: Column) -> Column:
    """Binary units. A unit begins strictly above its size, and its fraction, in truncated hundredths, may take three digits."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for k, unit in enumerate(SIZE_UNITS, 1):
        size = 1 << (10 * k)
        hundredths = F.call_function("div", n % F.lit(size), F.lit(size // 100))
        out = F.when(n > size, F.concat(F.call_function("div", n, F.lit(size)).cast("string"), F.lit("."), F.format_string("%02d", hundredths), F.lit(unit))).otherwise(out)
    return out


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd HH:mm:ss")


def components_key(path: Column) -> Column:
    """A sort key: files and directories of a directory before what is below them, components bytewise."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda c, i: F.struct((i < F.size(parts) - 1).alias("below"), c.cast("binary").alias("name")))


def path_key(path: Column) -> Column:
    """The key of a path in an index, where the root comes first."""
    key = components_key(path)
    return F.when(path == ".", F.slice(key, 1, 0)).otherwise(key)


def ordered_tags(tags: Column) -> Column:
    """Entries of a tag map for display: id, name, then by key."""
    def rank(e: Column) -> Column:
        return F.when(e["key"] == "id", 0).when(e["key"] == "name", 1).otherwise(2)
    keyed = F.transform(F.map_entries(tags), lambda e: F.struct(rank(e).alias("rank"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def human_tags(tags: Column) -> Column:
    """One line of k="v" pairs; quotes and backslashes in values are escaped."""
    def quoted(v: Column) -> Column:
        return F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.array_join(F.transform(ordered_tags(tags), lambda e: F.concat(e["key"], F.lit('="'), quoted(e["value"]), F.lit('"'))), " ")


def synthetic_tags(tags: Column, item_id: Column, ts: Column, size: Column) -> Column:
    """User tags with id, timestamp and size, which win over tags of those names."""
    own = F.create_map(F.lit("id"), item_id, F.lit("timestamp"), format_timestamp(ts), F.lit("size"), format_size(size))
    return F.map_concat(F.map_filter(tags, lambda k, _: ~k.isin("id", "timestamp", "size")), own)


def content_address(data: Column, key: bytes | None = None) -> Column:
    """Lower-case hex SHA-256 of the key, if any, and the data."""
    data = data.cast("binary")
    return F.sha2(F.concat(F.lit(key), data) if key else data, 256)


def from_hex(text: Column) -> Column:
    """Bytes of hex digits in either case; null where it isn't hex."""
    return F.unhex(text)


def derived_key(first: Column, second: Column) -> Column:
    """The key that two parts give together: the SHA-256 of one behind the other."""
    return F.unhex(F.sha2(F.concat(first.cast("binary"), second.cast("binary")), 256))


def all_zeros(data: Column) -> Column:
    return F.length(F.replace(F.hex(data), F.lit("0"), F.lit(""))) == 0
