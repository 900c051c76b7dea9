"""Chat formatting (native): one training string for each conversation, and what can be read back from it.

Template: a run of adjacent turns of one role is ``### role:`` + newline, the texts of its turns
with ``<cont/>`` + newline between them, then ``</turn>`` + newline. In roles and texts ``\\``, ``#``
and ``<`` are written ``\\s``, ``\\h`` and ``\\l``; so no control string can occur in them, and the
replacement is undone exactly. In roles ``:`` is written ``\\c`` as well, as it ends them. The loss mask covers the texts of the roles in ``loss_roles``.

Defined results: rows are ordered by turn (null first), then role, then text; a null role or text is
empty; a null conv_id is a conversation of its own; repeated rows stay; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, COLON, BREAK, CLOSE = "### ", ":\n", "<cont/>\n", "</turn>\n"
ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(c: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, code in escapes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted) of rows (conv_id, turn, role, text)."""
    turns = rows.select("conv_id", F.struct("turn", escape(F.coalesce("role", F.lit("")), ROLE_ESCAPES).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # Indices (from 1) at which a run of one role begins; each run's texts are then one slice.
    begins = F.expr("filter(sequence(1, size(t)), i -> i = 1 OR element_at(t, i).role <> element_at(t, i - 1).role)")
    runs = F.expr("transform(b, (s, k) -> struct(element_at(t, s).role AS role, slice(t.text, s, coalesce(get(b, k + 1), size(t) + 1) - s) AS texts))")
    blocks = F.transform("r", lambda r: F.concat(F.lit(OPEN), r["role"], F.lit(COLON), F.array_join(r["texts"], BREAK), F.lit(CLOSE)))
    return grouped.withColumn("b", begins).withColumn("r", runs).select("conv_id", F.array_join(blocks, "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the original turns as an array of (role, text), from the string alone."""
    blocks = F.filter(F.split("formatted", F.lit("</turn>\\n"), -1), lambda x: x != "")
    head = F.transform(blocks, lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), COLON, 1), ROLE_ESCAPES).alias("role"), x.alias("x")))
    def body(h: Column) -> Column:
        start = F.locate(COLON, h["x"]) + F.lit(len(COLON))
        return F.split(F.substr(h["x"], start), F.lit(BREAK), -1)
    turns = F.flatten(F.transform(head, lambda h: F.transform(body(h), lambda x: F.struct(h["role"].alias("role"), unescape(x).alias("text")))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"))


def digests(back: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"].isin(*loss_roles)), lambda t: t["text"]), "")
    return (
        back.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"))
        .select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(read_back(format_conversations(rows)))


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\s'), '#', '\h'), '<', '\l'), ':', '\c') AS erole,
    length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) AS etext,
    CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role THEN 0 ELSE 1 END AS opens
  FROM rows
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(etext) + sum(CASE WHEN opens = 1 THEN 4 + length(erole) + 2 + 8 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
