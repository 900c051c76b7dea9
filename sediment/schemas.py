"""Schemas of the repository's tables, as DDL."""

TREE = "STRUCT<address: STRING, height: BIGINT, data_chunk_count: BIGINT>"
ITEMS = (
    "item_id STRING, log_offset BIGINT, primary_key_id STRING, put_key_id STRING, unix_timestamp_millis BIGINT, "
    f"tags MAP<STRING,STRING>, data_size BIGINT, index_size BIGINT, data_tree {TREE}, index_tree {TREE}"
)
OPLOG = f"log_offset BIGINT, op STRING, item_id STRING, removed_ids ARRAY<STRING>, metadata STRUCT<{ITEMS.replace(' STRING', ': STRING').replace(' BIGINT', ': BIGINT').replace(' MAP', ': MAP').replace(' STRUCT', ': STRUCT').replace('::', ':')}>, gc_generation STRING"
INDEX_ENTRIES = (
    "item_id STRING, seq BIGINT, path STRING, path_bytes BINARY, size BIGINT, mtime BIGINT, mtime_nsec BIGINT, ctime BIGINT, ctime_nsec BIGINT, "
    "ino BIGINT, norm_dev BIGINT, mode BIGINT, uid BIGINT, gid BIGINT, nlink BIGINT, link_target STRING, dev_major BIGINT, dev_minor BIGINT, "
    "sparse BOOLEAN, xattrs MAP<BINARY,BINARY>, data_cursor STRUCT<chunk_delta: BIGINT, start_byte_offset: BIGINT, end_byte_offset: BIGINT>, data_hash STRING"
)
CHUNKS = "address STRING, data BINARY, n_bytes BIGINT"
HTREE_NODES = "parent STRING, pos INT, height INT, leaf_count BIGINT, child STRING"
SENT = "address STRING, gc_generation STRING, latest_session_id STRING, item_id STRING"
STAT_CACHE = "hash STRING, cached STRING, gc_generation STRING, latest_session_id STRING, item_id STRING"

ADD, REMOVE, RECOVER = "AddItem", "RemoveItems", "RecoverRemoved"
