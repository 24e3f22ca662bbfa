"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest. A batch is reduced to one line per distinct text, which
meets the index in a sort-merge anti-join: the index is read in place, only the batch is shuffled. Lines of
new texts are appended.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyframe.llm.common import join_groups, kept, lower_ascii, new_folder


class DigestIndex:
    """One line per text ever added: digest (SHA-256), keep_id (its row that stays), n (rows of the batch that brought it).

    An existing `folder` is opened again under the same name and number of buckets; without one a new index
    begins in the shared folder. Choose `buckets` so that a bucket of the final index fits a task.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, folder: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.folder = folder or new_folder(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, n BIGINT) USING parquet OPTIONS (path '{self.folder}') "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, lines: DataFrame) -> None:
        lines.select("digest", "keep_id", "n").write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").option("path", self.folder).saveAsTable(self.name)

    def deduplicate(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """Add a batch; one line per row of it, dropped ones too.

        Null text counts as empty, and texts are equal when identical after lower-casing A-Z. Of equal texts of a
        batch the row with the largest id stays, unless the index has the text from an earlier batch: then none
        does and keep_id is the earlier row (`known`). Rows without id stay only if no equal text has one. Rows
        that repeat an id with the same text can't be told apart and share one decision. group_size counts the
        rows of the batch with that text. Further columns of docs are ignored. An empty batch gives no lines.
        """
        rows, groups = self._add(docs, id_column, text_column)
        out = join_groups(rows, groups, "digest", "group_size", rows.count(), "doc_id")
        return out.select(*self._columns(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("known")), "known")

    def deduplicate_in_batches(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", batches: int = 2) -> DataFrame:
        """Add docs as batches of falling id ranges; one line per row, as if they were one batch.

        Each batch meets the index that the batches before have filled. They had the larger ids, so the row that the
        index names is the one with the largest id, and of texts new to the index that row stays. Rows without id
        come last. group_size counts the rows of all these batches; a text from before docs is `known`, and none of
        its rows is kept. Otherwise as deduplicate().
        """
        ids = F.col(id_column).cast("long")
        low, high = docs.agg(F.min(ids), F.max(ids)).first()
        if low is None:
            return self.deduplicate(docs, id_column, text_column)
        cuts = [low + (high - low + 1) * i // batches for i in range(batches)]
        done = []
        for i in reversed(range(batches)):
            part = ids >= cuts[i] if i else F.lit(True)
            if i < batches - 1:
                part = part & (ids < cuts[i + 1])
            done.append(self._add(docs.where(part | ids.isNull() if i == 0 else part), id_column, text_column))
        rows, groups = (reduce(DataFrame.unionByName, x) for x in zip(*done))
        # whatever batch brought a text, later ones know it by then: only the first tells whether the index did before
        first = groups.select("*", (~F.col("known")).alias("_new"))
        groups = kept(first.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), (~F.bool_or("_new")).alias("known")))
        out = join_groups(rows, groups, "digest", "group_size", rows.count(), "doc_id")
        return out.select(*self._columns(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("known")), "known")

    def drop(self) -> None:
        """Forget the table's name; its files stay in `folder`, and results given out stay whole."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _add(self, docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
        """doc_id, digest of the rows; digest, keep_id, group_size, known of their texts. New texts are appended."""
        rows = kept(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.unhex(F.sha2(lower_ascii(F.coalesce(F.col(text_column), F.lit(""))), 256)).alias("digest")))
        groups = kept(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
        fresh = kept(groups.join(self.read().hint("merge"), "digest", "left_anti"))
        earlier = self.read().select("digest", F.col("keep_id").alias("earlier_id"), F.lit(True).alias("known"))
        groups = groups.join(earlier.hint("merge"), "digest", "left").select("digest", F.when(F.col("known"), F.col("earlier_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.col("n").alias("group_size"), F.coalesce("known", F.lit(False)).alias("known"))
        groups = kept(groups)  # as the index was before this batch
        self.append(fresh)
        return rows, groups

    @staticmethod
    def _columns(stays: Column) -> list[Column]:
        return [F.col("doc_id"), F.col("keep_id"), F.col("group_size"), stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
