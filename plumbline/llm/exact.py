"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text.
A batch is reduced to one row per digest, the digests that the index lacks are
found by a sort-merge anti-join that reads the index without a shuffle, and
those are appended. Documents then look up the row that stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, stored
from plumbline.session import shared_folder

SPACES = "[\\x20\\x09-\\x0D]+"
#: Buckets of an index; a bucket is one sorted run per append.
BUCKETS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


class DigestIndex:
    """Digests already seen, with the id of the document that stays for each.

    ``path`` is a folder every executor reaches; an index written by an earlier
    session is opened again with its bucketing. Appending the same batch twice
    adds nothing, so a batch that failed half-way may simply be run again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path or shared_folder(spark, "digests")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, digests: DataFrame) -> None:
        """Add the rows of (digest, keep_id) whose digest is not there yet; digests must be unique."""
        new = digests.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        new = stored(new.select("digest", "keep_id"), "new-digests")
        # Dealt by bucket number, so that a bucket is one file however many tasks write.
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        new.repartition(self.buckets, bucket).write.insertInto(self.name)


def decide(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``keep_id, group_size, kept, text_sha256``; the index learns the new texts.

    Texts are equal when identical after each run of ASCII white space becomes
    one space; null counts as empty. A text the index knows keeps the id stored
    there; otherwise the smallest id of the batch stays. ``group_size`` counts
    rows of this batch. A repeated id stays on all its rows, a null id never
    stays unless its whole group has none. Input columns with one of the four
    names are replaced.
    """
    made = ["keep_id", "group_size", "kept", "text_sha256"]
    docs = docs.drop(*made)
    digest, size = fresh(docs, "digest"), fresh(docs, "size")
    hashed = docs.withColumn(digest, F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    groups = stored(
        docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))
        .groupBy("digest")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("size")),
        "batch-digests",
    )
    index.append(groups.select("digest", "keep_id"))
    keepers = groups.select(F.col("digest").alias(digest), F.col("size").alias(size)).join(
        index.rows().select(F.col("digest").alias(digest), "keep_id"), digest
    )
    return (
        hashed.join(stored(keepers, "keepers"), digest)
        .withColumn("group_size", F.col(size))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
        .withColumn("text_sha256", F.lower(F.hex(F.col(digest))))
        .select(*docs.columns, *made)
    )


def dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    index = index or DigestIndex(docs.sparkSession)
    flag = decide(docs.withColumn("__row", F.struct(*docs.columns)), index, id_col, text_col)
    return flag.where("kept").select("__row.*")
