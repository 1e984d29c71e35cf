"""Keyed tables: field updates, change sets with unique keys, seeds and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityops.functions import text as T
from entityops.functions.ordering import first_row, last_row
from entityops.session import materialise


def update_by_key(
    table: DataFrame, updates: DataFrame, key: str, field: str, status: str | None = None, done: str = "extracted",
    deletes: DataFrame | None = None,
) -> DataFrame:
    """Replace one field of the rows that ``updates`` names (key, field, ordinal) and mark them.

    Unknown keys change nothing; the last update of a key counts; ``deletes`` lists keys to drop.
    """
    newest = last_row(updates.select(key, field, "ordinal"), [key], [F.col("ordinal")])
    fresh = newest.select(key, F.col(field).alias("_new"), F.lit(True).alias("_hit"))
    joined = table.join(fresh, key, "left")
    hit = F.col("_hit").isNotNull()
    changed = {field: F.when(hit, F.col("_new")).otherwise(F.col(field))}
    if status is not None:
        changed[status] = F.when(hit, F.lit(done)).otherwise(F.col(status))
    out = joined.withColumns(changed).select(*table.columns)
    return out if deletes is None else out.join(deletes.select(key).distinct(), key, "left_anti").select(*table.columns)


def list_by_scope(table: DataFrame, scope: str, value, created: str, tie: str) -> DataFrame:
    """Rows of one scope, newest first."""
    return table.where(F.col(scope) == value).orderBy(F.col(created).desc(), F.col(tie))


def normal_key(col: Column) -> Column:
    return F.upper(T.strip(col))


def apply_changes(table: DataFrame, changes: DataFrame, row_id: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table after the changes, rejected changes with a reason).

    changes: op (insert, update, delete), ``row_id``, the table's other columns and ordinal.  Keys are
    trimmed and upper-cased.  A change set is checked against the table and its own earlier changes: one change per row,
    an unknown row cannot be changed, and a key that another row holds, or that an earlier change of
    the set claims, is refused.  An update may keep its own key, and a key is free after the set deleted
    its holder; a refused change claims nothing.
    """
    columns = table.columns
    normal = changes.withColumns({k: normal_key(F.col(k)) for k in keys})
    first_per_row = normal.groupBy(row_id).agg(F.min("ordinal").alias("_row_first"))
    holders = first_row(table.select(*keys, F.col(row_id).alias("_holder")), keys, [F.col("_holder")])
    known = table.select(F.col(row_id), F.lit(True).alias("_known"))
    checked = normal.join(first_per_row, row_id).join(known, row_id, "left").join(holders, keys, "left")
    # A holder that the set deletes leaves its key from that change on.
    alone = checked.withColumn(
        "_alone",
        F.when(F.col("ordinal") > F.col("_row_first"), "repeated row")
        .when((F.col("op") != "insert") & F.col("_known").isNull(), "unknown row")
        .when((F.col("op") == "insert") & F.col("_known").isNotNull(), "row exists"),
    )
    freed = alone.where("op = 'delete' AND _alone IS NULL").select(F.col(row_id).alias("_holder"), F.col("ordinal").alias("_freed"))
    alone = alone.join(freed, "_holder", "left")
    claiming = F.col("op") != "delete"
    held = F.col("_holder").isNotNull() & (F.col("_holder") != F.col(row_id)) & ~F.coalesce(F.col("_freed") < F.col("ordinal"), F.lit(False))
    alone = alone.withColumn("_alone", F.coalesce("_alone", F.when(claiming & held, "key taken")))
    # Only a change that stands on its own claims its key.
    first_per_key = alone.where(claiming & F.col("_alone").isNull()).groupBy(*keys).agg(F.min("ordinal").alias("_key_first"))
    late = claiming & (F.col("ordinal") > F.col("_key_first"))
    judged = alone.join(first_per_key, keys, "left").withColumn("reason", F.coalesce("_alone", F.when(late, "key claimed earlier")))
    accepted = judged.where("reason IS NULL")
    touched = accepted.where("op <> 'insert'").select(row_id)
    after = table.join(touched, row_id, "left_anti").select(*columns).unionByName(accepted.where("op <> 'delete'").select(*columns))
    return after, judged.where("reason IS NOT NULL").select(row_id, "op", *keys, "ordinal", "reason")


def seed_missing(table: DataFrame, seeds: DataFrame, group: str) -> DataFrame:
    """Add seed rows only for groups the table does not have at all."""
    return table.unionByName(seeds.join(table.select(group).distinct(), group, "left_anti").select(*table.columns))


def exact_duplicates(df: DataFrame, key: str, content: str, batch: list[str] = (), order: str | None = None) -> DataFrame:
    """First row with the same content (SHA-256) inside a batch, for every row; first by ``order``, then by key.

    Only (key, hash) is kept of the content and written once to the checkpoint folder, because the
    hash feeds both the aggregate and the join; a hash that fills a third of the table is one row on
    the aggregated side, and adaptive execution splits it on the other.
    """
    place = F.col(order or key).alias("_order")
    hashed = materialise(df.select(key, *batch, place, F.sha2(F.col(content), 256).alias("content_hash")))
    first = F.min(F.struct("_order", key))[key]
    firsts = hashed.groupBy(*batch, "content_hash").agg(first.alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return hashed.join(firsts, [*batch, "content_hash"], "left").select(
        key, *batch, "content_hash", F.coalesce("first_id", F.col(key)).alias("first_id"),
        (F.coalesce("first_id", F.col(key)) != F.col(key)).alias("is_duplicate"),
    )
