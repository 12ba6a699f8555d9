"""Exact dedup: 128-bit content hash, one stable row per group, bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, free_name, staged, with_ids


def squeezed(text: Column) -> Column:
    """Text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = md5_bytes,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after their ASCII white space is deleted. The row with the most code
    points stays, then the smallest id. Only narrow rows (id, length, hashes) are shuffled for all
    documents; texts move only for groups of two or more, and there as one minimum and one maximum per
    task and group: the group's bytes are all equal exactly when the two are. A group whose bytes differ
    (a hash collision) is divided by its texts.

    Null text: as empty. Null id: sorts last and may be kept only where no other id is in the group.
    Repeated rows: each counts in group_size; rows that repeat the kept id share its verdict. Empty
    table: no rows. Extra columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.char_length(F.coalesce(text_col, F.lit(""))).alias("n_cp"), squeezed(F.col(text_col)).alias("norm"))
    texts = texts.withColumn("h", content_hash(F.col("norm")))
    rows = staged(texts.select("doc_id", "n_cp", "h", F.sha2("norm", 256).alias("text_sha256")), "exact-rows")
    multi = staged(_groups(rows, "h").where("group_size > 1"), "exact-groups")

    in_groups = texts.join(multi.select("h"), "h")
    differ = staged(in_groups.groupBy("h").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a != b").select("h"), "exact-collisions")
    if differ.isEmpty():
        return _verdicts(rows, multi, ["h"])
    whole = rows.join(differ, "h", "left_anti").withColumn("variant", F.lit(""))
    parts = texts.join(differ, "h").select("doc_id", "n_cp", "h", F.sha2("norm", 256).alias("text_sha256"), F.col("norm").alias("variant"))
    rows = staged(whole.unionByName(parts), "exact-variants")
    return _verdicts(rows, staged(_groups(rows, "h", "variant").where("group_size > 1"), "exact-groups"), ["h", "variant"])


def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    first = F.min(F.struct(-F.col("n_cp"), F.col("doc_id").isNull(), F.col("doc_id").alias("id")))
    return rows.groupBy(*keys).agg(F.count("*").alias("group_size"), first.alias("first")).select(*keys, "group_size", F.col("first.id").alias("group_keep"))


def _verdicts(rows: DataFrame, multi: DataFrame, keys: list[str]) -> DataFrame:
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("group_keep"))
    return rows.join(multi, keys, "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all their columns, whatever their names; of rows that repeat both id and text, one.

    Null text: as empty. Null id: a row stays only where no other id is in its group. Empty table: no rows.
    """
    verdicts = staged(exact_groups(docs, id_col, text_col).select("doc_id", "kept", "text_sha256"), "exact-verdicts")
    again = staged(verdicts.groupBy("doc_id").count().where("count > 1").select("doc_id"), "exact-again")
    kept = verdicts.where("kept")
    if again.isEmpty():
        return with_ids(docs, kept.select("doc_id"), id_col)
    single = with_ids(docs, with_ids(kept, again, "doc_id", "left_anti").select("doc_id"), id_col)
    name = free_name(docs, "__digest")  # rows that share an id are told apart by their texts
    rest = with_ids(docs, again, id_col).withColumn(name, F.sha2(squeezed(F.col(text_col)), 256))
    own = with_ids(kept, again).select(F.col("doc_id").alias("own"), F.col("text_sha256").alias("sha")).distinct()
    rest = rest.join(own, rest[id_col].eqNullSafe(own["own"]) & (rest[name] == own["sha"]), "left_semi")
    return single.unionByName(rest.dropDuplicates([id_col, name]).drop(name))
