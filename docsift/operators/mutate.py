"""Document mutations as DataFrame functions.

Every function returns ``(table, report)``: the new document table (to be published as a
new version) and one report row per input row. Nothing but the change set is materialised.

All of them start from ``prepare``: one pass that validates the changes, assigns missing
ids, fixes the input order and checkpoints the result, so ids and order are the same in
the table, the report and the vectors. Joins are plain; Spark broadcasts a change set by
its size in bytes or shuffles it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.json import normalise_metadata_json
from docsift.functions.text import text_hash
from docsift.schema import DOC_COLUMNS, META_TYPE
from docsift.session import materialised


def _empty_meta():
    return F.create_map().cast(META_TYPE)


def _ts(as_of):
    return F.lit(as_of).cast("timestamp")


def _existing(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """[id, _exists] for the ids of ``ids`` that the table has."""
    return docs.select("id").join(ids.select("id").distinct(), "id", "left_semi").withColumn("_exists", F.lit(True))


# ----------------------------------------------------------------- F6 / P3 / P4


def validate(changes: DataFrame, require_id: bool = False) -> DataFrame:
    """add ``error`` (NULL when valid) in one pass.

    Input: [id?, text?, metadata_json? | metadata?, _invalid?, ...]. ``metadata_json`` (raw
    JSON text) is normalised by P3 into ``metadata``; a given but unusable object (malformed,
    repeated key, not an object) is an error. ``_invalid`` is what a reader found wrong.
    """
    df = changes
    if "metadata_json" in df.columns:
        df = df.withColumn("metadata", normalise_metadata_json("metadata_json"))
        bad_meta = F.col("metadata_json").isNotNull() & F.col("metadata").isNull()
    else:
        if "metadata" not in df.columns:
            df = df.withColumn("metadata", F.lit(None).cast(META_TYPE))
        bad_meta = F.lit(False)
    if "id" not in df.columns:
        df = df.withColumn("id", F.lit(None).cast("string"))
    invalid = F.col("_invalid") if "_invalid" in df.columns else F.lit(None).cast("string")
    err = F.when(invalid.isNotNull(), invalid).when(F.col("text").isNull(), F.lit("Missing 'text' field"))
    if require_id:
        err = err.when(F.col("id").isNull() | (F.col("id") == ""), F.lit("Missing 'id' field"))
    err = err.when(bad_meta, F.lit("Invalid 'metadata': must be a JSON object of unique keys"))
    return df.withColumn("error", err).drop("_invalid")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows [id, error])."""
    return checked.filter(F.col("error").isNull()).drop("error"), checked.filter(F.col("error").isNotNull())


def assign_ids(df: DataFrame) -> DataFrame:
    """Keep a non-empty given id, else generate a unique ``doc_<hex>``. A generated id is
    random, so the result must be materialised before it is used twice (``prepare`` does)."""
    given = F.when(F.col("id") != "", F.col("id"))
    fresh = F.concat(F.lit("doc_"), F.regexp_replace(F.uuid(), "-", ""))
    return df.withColumn("id_generated", given.isNull()).withColumn("id", F.coalesce(given, fresh))


def prepare(changes: DataFrame, require_id: bool = False, generate_ids: bool = False) -> DataFrame:
    """The change set that mutations work on, materialised once:
    [id, text, metadata, text_hash, ordinal, error, _order].

    ``_order`` is (ordinal, or the input position where it is NULL or absent; position): a
    total order that no tie or NULL can break."""
    if "_order" in changes.columns:
        return changes
    df = changes if "error" in changes.columns else validate(changes, require_id)
    if "ordinal" not in df.columns:
        df = df.withColumn("ordinal", F.lit(None).cast("long"))
    position = F.monotonically_increasing_id()
    df = df.withColumn("_position", position)
    if generate_ids:
        df = assign_ids(df)
    return materialised(
        df.select(
            "id",
            "text",
            F.coalesce(F.col("metadata"), _empty_meta()).alias("metadata"),
            text_hash("text").alias("text_hash"),
            F.col("ordinal").cast("long").alias("ordinal"),
            "error",
            F.struct(F.coalesce(F.col("ordinal").cast("long"), F.col("_position")), "_position").alias("_order"),
        )
    )


def _rejected(prepared: DataFrame, *extra: str) -> DataFrame:
    why = F.concat(F.lit("rejected: "), F.col("error")).alias("status")
    return prepared.filter(F.col("error").isNotNull()).select("id", *extra, why)


def _as_docs(rows: DataFrame, as_of) -> DataFrame:
    """Stamp new rows."""
    return rows.select("id", "text", "metadata", _ts(as_of).alias("created_at"), _ts(as_of).alias("updated_at"), "text_hash")


# ----------------------------------------------------------------- M1 / J3


def insert(docs: DataFrame, new: DataFrame, as_of, require_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """M1: insert rows whose id is absent; an existing id is refused and the old row kept. Of
    several rows with one new id the first is inserted and the rest refused. A missing id is
    generated, or rejected with ``require_id``; a missing text is rejected.

    Report: [id, ordinal, status], a row for each input row."""
    rows = prepare(new, require_id, generate_ids=not require_id)
    valid = rows.filter(F.col("error").isNull())
    firsts = valid.groupBy("id").agg(F.min("_order").alias("_first"))
    flagged = valid.join(firsts, "id").join(_existing(docs, valid), "id", "left")
    status = (
        F.when(F.col("_exists").isNotNull(), F.lit("exists"))
        .when(F.col("_order") != F.col("_first"), F.lit("duplicate"))
        .otherwise(F.lit("inserted"))
    )
    flagged = flagged.withColumn("status", status)
    table = docs.select(*DOC_COLUMNS).unionByName(_as_docs(flagged.filter(F.col("status") == "inserted"), as_of))
    return table, flagged.select("id", "ordinal", "status").unionByName(_rejected(rows, "ordinal"))


# ----------------------------------------------------------------- M2


def insert_batch(docs: DataFrame, batch: DataFrame, as_of, require_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """M2: all or nothing. One id already in the table, repeated inside the batch, or an
    invalid row rolls the whole batch back.

    The decision is one action; the report says what really happened: ``inserted`` for every
    row, or ``rolled_back`` with the reason on the rows that caused it.
    """
    rows = prepare(batch, require_id, generate_ids=not require_id)
    valid = rows.filter(F.col("error").isNull())
    per_id = valid.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).join(_existing(docs, valid), "id", "left")
    reason = F.when(F.col("_exists").isNotNull(), F.lit("exists")).when(F.col("_n") > 1, F.lit("duplicate in batch"))
    rows = rows.join(per_id.select("id", reason.alias("reason")), "id", "left")
    rows = rows.withColumn("reason", F.coalesce("error", "reason"))
    if not rows.filter(F.col("reason").isNotNull()).isEmpty():
        return docs.select(*DOC_COLUMNS), rows.select("id", F.lit("rolled_back").alias("status"), "reason")
    table = docs.select(*DOC_COLUMNS).unionByName(_as_docs(valid, as_of))
    return table, rows.select("id", F.lit("inserted").alias("status"), F.lit(None).cast("string").alias("reason"))


# ----------------------------------------------------------------- M3 / M4 / M5


def latest_per_id(prepared: DataFrame) -> DataFrame:
    """The last valid row of each id (``max_by`` is a partial aggregate: a hot id is reduced
    before the shuffle)."""
    valid = prepared.filter(F.col("error").isNull())
    last = valid.groupBy("id").agg(F.max_by(F.struct("text", "metadata", "text_hash"), "_order").alias("_r"))
    return last.select("id", "_r.*")


def _apply(docs: DataFrame, last: DataFrame, as_of, insert_missing: bool) -> DataFrame:
    """Replace text and metadata of the ids in ``last`` (unique ids); metadata is replaced
    wholesale; created_at kept, updated_at set. With ``insert_missing`` the other change
    rows are inserted (upsert)."""
    ch = last.select("id", F.struct("text", "metadata", "text_hash").alias("_new"))
    joined = docs.select(*DOC_COLUMNS).join(ch, "id", "left")
    hit = F.col("_new").isNotNull()
    pick = lambda c: F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c)
    updated = joined.select(
        "id",
        pick("text"),
        pick("metadata"),
        "created_at",
        F.when(hit, _ts(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
        pick("text_hash"),
    )
    if not insert_missing:
        return updated
    fresh = last.join(_existing(docs, last), "id", "left_anti")
    return updated.unionByName(_as_docs(fresh, as_of))


def _merge(docs: DataFrame, last: DataFrame, as_of, deal) -> DataFrame:
    """``_apply`` with inserts by one shuffle of the documents, the one that writing them takes anyway:
    documents and changes are dealt out together by ``deal`` (see ``Store.deal``), whose columns are kept."""
    rows = docs.select(*DOC_COLUMNS, F.lit(False).alias("_change"))
    rows, keys = deal(rows.unionByName(_as_docs(last, as_of).withColumn("_change", F.lit(True))))
    of_id = Window.partitionBy(*keys)
    new = F.when(F.col("_change"), F.struct("text", "metadata", "text_hash"))
    rows = rows.withColumn("_new", F.first(new, ignorenulls=True).over(of_id))
    rows = rows.withColumn("_absent", F.min("_change").over(of_id))
    hit = F.col("_new").isNotNull()
    pick = lambda c: F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c)
    return rows.filter(~F.col("_change") | F.col("_absent")).select(
        "id",
        pick("text"),
        pick("metadata"),
        "created_at",
        F.when(hit, _ts(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
        pick("text_hash"),
        *[k for k in keys if k != "id"],
    )


def update(docs: DataFrame, changes: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """M3: existing ids only (the last change of each); others reported not_found."""
    rows = prepare(changes, require_id=True)
    table = _apply(docs, latest_per_id(rows), as_of, insert_missing=False)
    valid = rows.filter(F.col("error").isNull())
    found = valid.select("id").join(_existing(docs, valid), "id", "left")
    report = found.select("id", F.when(F.col("_exists").isNotNull(), "updated").otherwise("not_found").alias("status"))
    return table, report.unionByName(_rejected(rows))


def upsert(docs: DataFrame, changes: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """M4: update existing ids, insert the others; the last change of each id."""
    table, report = upsert_batch(docs, changes, as_of)
    return table, report.drop("ordinal")


def upsert_batch(docs: DataFrame, changes: DataFrame, as_of, deal=None) -> tuple[DataFrame, DataFrame]:
    """M5: rows without an id or a text are rejected; of several rows per id the last wins
    (largest ordinal, then input position); then M4. Report: [id, ordinal, status]. With ``deal``
    (``Store.deal``) the table comes dealt out as the store writes it."""
    rows = prepare(changes, require_id=True)
    last = latest_per_id(rows)
    table = _apply(docs, last, as_of, insert_missing=True) if deal is None else _merge(docs, last, as_of, deal)
    done = rows.filter(F.col("error").isNull()).select("id", "ordinal", F.lit("upserted").alias("status"))
    return table, done.unionByName(_rejected(rows, "ordinal"))


# ----------------------------------------------------------------- M6 / J4


def _wanted(ids: DataFrame) -> DataFrame:
    return ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct()


def delete(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove the ids (metadata goes with the row); report ``deleted`` or
    ``not_found`` per distinct requested id."""
    want = _wanted(ids)
    table = docs.select(*DOC_COLUMNS).join(want, "id", "left_anti")
    report = want.join(_existing(docs, want), "id", "left").select(
        "id", F.when(F.col("_exists").isNotNull(), "deleted").otherwise("not_found").alias("status")
    )
    return table, report


def delete_cascade(long_rows: DataFrame, vectors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J4 cascade: the same ids removed from long metadata and vectors."""
    want = _wanted(ids)
    kept = long_rows.join(want.withColumnRenamed("id", "document_id"), "document_id", "left_anti")
    return kept, vectors.join(want, "id", "left_anti")
