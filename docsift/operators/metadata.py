"""Document metadata in map and long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.schema import META_TYPE

def explode_metadata(docs: DataFrame) -> DataFrame:
    """Map form -> long rows [document_id, key, value]."""
    return docs.select(F.col("id").alias("document_id"), F.explode("metadata").alias("key", "value"))


def fold_metadata(long_rows: DataFrame) -> DataFrame:
    """P1 (first half): long rows -> [document_id, metadata map].

    A document's rows are bounded by its distinct keys (the long table's
    key is (document_id, key)), so the per-group list is small.
    """
    return long_rows.groupBy("document_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata")
    )


def attach_metadata(docs: DataFrame, long_rows: DataFrame) -> DataFrame:
    """One join instead of one lookup per document; no metadata -> {}."""
    folded = fold_metadata(long_rows).withColumnRenamed("document_id", "id")
    base = docs.drop("metadata") if "metadata" in docs.columns else docs
    out = base.join(folded, "id", "left")
    return out.withColumn("metadata", F.coalesce("metadata", F.create_map().cast(META_TYPE)))


def metadata_equals(docs: DataFrame, key: str, value: str) -> DataFrame:
    """F4 (map form): documents whose metadata[key] == value."""
    return docs.filter(F.col("metadata").getItem(key) == F.lit(value))


def metadata_join(docs: DataFrame, long_rows: DataFrame, key: str, value: str) -> DataFrame:
    """J1 + A3 (long form): docs inner-join the matching metadata rows, DISTINCT.

    The key/value predicate is on plain columns and reaches the scan of the
    long table; the (document_id, key) uniqueness makes the semi join the
    same rows as join+distinct without a distinct shuffle over documents.
    """
    hits = long_rows.filter((F.col("key") == F.lit(key)) & (F.col("value") == F.lit(value)))
    return docs.join(hits.select(F.col("document_id").alias("id")), "id", "left_semi")


def _filtered(docs: DataFrame, key: str | None, value: str | None) -> DataFrame:
    """Matches of a filter; without both key and value (None or empty), every document."""
    return metadata_equals(docs, key, value) if key and value else docs


def list_by_metadata(docs: DataFrame, key: str | None, value: str | None, limit: int | None = None) -> DataFrame:
    """T4: matches in id order, the first ``limit`` of them if one is given."""
    out = _filtered(docs, key, value).select("id", "text", "metadata").orderBy("id")
    return out if limit is None else out.limit(limit)


def count_by_metadata(docs: DataFrame, key: str | None, value: str | None) -> DataFrame:
    """A2: count of matching documents; without both key and value, all."""
    return _filtered(docs, key, value).agg(F.count(F.lit(1)).alias("count"))


def count_by_metadata_grouped(docs: DataFrame) -> DataFrame:
    """A2 grouped: [key, value, count]. Partial aggregation before the
    shuffle keeps a hot (key, value) pair to one row per task."""
    return explode_metadata(docs).groupBy("key", "value").agg(F.count(F.lit(1)).alias("count"))


def put_metadata(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """M7: insert or replace one key per edit row [id, key, value].

    Other keys are kept. Edits for unknown ids do nothing (the reference's
    foreign key refuses them), nor do edits with a null key or value; see
    ``put_metadata_report``. Several edits of one (id, key) apply in order (last wins):
    by ``ordinal``, or the input position where it is NULL or absent; then by position.
    """
    position = F.monotonically_increasing_id()
    ordinal = F.coalesce(F.col("ordinal").cast("long"), position) if "ordinal" in edits.columns else position
    ordered = edits.select("id", "key", "value", F.struct(ordinal.alias("a"), position.alias("b")).alias("_order"))
    last = ordered.where("key is not null and value is not null").groupBy("id", "key").agg(F.max_by("value", "_order").alias("value"))
    per_doc = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_new"))
    joined = docs.join(per_doc, "id", "left")
    merged = F.when(
        F.col("_new").isNull(), F.col("metadata")
    ).otherwise(
        F.map_concat(
            F.map_filter("metadata", lambda k, v: ~F.array_contains(F.map_keys(F.col("_new")), k)),
            F.col("_new"),
        )
    )
    return joined.withColumn("metadata", merged).drop("_new")


def put_metadata_report(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """[id, key, status]: ``ok``, ``not_found``, or ``invalid`` (a null key or value) for each edit row."""
    want = edits.select("id").distinct()
    have = docs.select("id").join(want, "id", "left_semi").withColumn("_has", F.lit(True))
    status = F.when(F.col("_has"), F.lit("ok")).otherwise(F.lit("not_found"))
    invalid = F.col("key").isNull() | F.col("value").isNull()
    return edits.join(have, "id", "left").select("id", "key", F.when(invalid, F.lit("invalid")).otherwise(status).alias("status"))


def delete_metadata(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """M8: remove keys given as rows [id, key]; other keys kept."""
    per_doc = edits.groupBy("id").agg(F.collect_set("key").alias("_drop"))
    joined = docs.join(per_doc, "id", "left")
    kept = F.when(F.col("_drop").isNull(), F.col("metadata")).otherwise(
        F.map_filter("metadata", lambda k, v: ~F.array_contains(F.col("_drop"), k))
    )
    return joined.withColumn("metadata", kept).drop("_drop")


def delete_metadata_report(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """[id, key, deleted]: whether the key existed on that document."""
    want = edits.select("id").distinct()
    have = docs.select("id", "metadata").join(want, "id", "left_semi")
    return edits.join(have, "id", "left").select(
        "id", "key", F.coalesce(F.map_contains_key("metadata", F.col("key")), F.lit(False)).alias("deleted")
    )
