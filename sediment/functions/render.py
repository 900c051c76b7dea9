"""Lines for people and for programs: contents of snapshots, differences, and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalars

#: Fixed value: the widest size text, for indexes too large to be measured.
WIDEST = 11


def size_width(entries: DataFrame) -> int:
    """Characters of the longest size of the entries."""
    return entries.agg(F.max(F.length(scalars.format_size(F.col("size"))))).first()[0] or 0


def contents_line(width: int = WIDEST) -> Column:
    """`mode size time path` of an entry; only files have a size, which is padded to `width`."""
    size = F.when(F.col("mode").bitwiseAND(scalars.TYPE_MASK) == scalars.REGULAR, scalars.format_size(F.col("size"))).otherwise("-")
    return F.concat_ws(" ", scalars.display_mode(F.col("mode")), F.rpad(size, width, " "), scalars.format_timestamp(F.timestamp_seconds("ctime")), "path")


def _octets(raw: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int"))


def text_or_bytes(raw: Column) -> Column:
    """JSON of a byte string: a string where it is UTF-8, otherwise an array of its bytes."""
    text = F.to_json(F.array(raw.cast("string")))
    return F.when(F.is_valid_utf8(raw.cast("string")), F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(F.concat(F.lit("["), F.array_join(_octets(raw).cast("array<string>"), ","), F.lit("]")))


def contents_json(entries: DataFrame) -> Column:
    """One JSON object of an entry's columns, without those that place it in an item; paths that aren't UTF-8 are arrays of bytes."""
    names = [c for c in entries.columns if c not in ("item_id", "seq", "path", "path_bytes", "abs_path", "xattrs")]
    path = text_or_bytes(F.col("path_bytes")) if "path_bytes" in entries.columns else text_or_bytes(F.col("path").cast("binary"))
    rest = F.to_json(F.struct(*names))
    return F.concat(F.lit('{"path":'), path, F.when(rest != "{}", F.concat(F.lit(","), F.substr(rest, F.lit(2)))).otherwise("}"))


def diff_line(line: Column) -> Column:
    """A line of a changed entry, with its sign before it."""
    return F.concat_ws(" ", "op", line)


def item_json() -> Column:
    """One JSON object of an item with its tags, id first."""
    tags = F.array_join(F.transform(scalars.ordered_tags(F.col("tags")), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _quoted(e["value"]))), ", ")
    rest = F.to_json(F.struct("data_tree", "index_tree", "data_size", "index_size", "put_key_id", "unix_timestamp_millis"))
    return F.concat(F.lit('{"id":"'), "item_id", F.lit('","decryption_key_id":"'), "primary_key_id", F.lit('",'), F.substr(rest, F.lit(2), F.length(rest) - 2), F.lit(',"tags":{'), tags, F.lit("}}"))


def _quoted(c: Column) -> Column:
    text = F.to_json(F.array(c))
    return F.substr(text, F.lit(2), F.length(text) - 2)
