"""Keywords in order of arrival: each writing is compared with what was there when it came, and its keywords stay."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import keyness


class KeywordLog:
    """Keywords, totals and known ids in a shared folder, a folder a batch.

    A batch reads what the batch before it left and writes folders of its own number only, so running it
    again after a failure, as a restarted stream does, writes the same once more: each writing counts once.
    Totals are written whole by each batch, so a batch reads one table and not all that came before.
    """

    def __init__(self, spark: SparkSession, folder: str, top: int = 8, least: int = 2, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.folder, self.top, self.least, self.id_col, self.text_col = spark, folder.rstrip("/"), top, least, id_col, text_col

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def _batches(self, kind: str) -> list[int]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"batch=(\d+)", n)))

    def batch(self, rows: DataFrame, number: int) -> None:
        """The writings of one batch that are not known yet: their counts, then the new totals, then their keywords.

        Of rows that share an id one is taken; rows without an id or a text go.
        """
        rows = rows.select(self.id_col, self.text_col).dropna()
        before = [b for b in self._batches("counts") if b < number]
        if before:
            known = self.spark.read.parquet(*(self._path("counts", b) for b in before)).select(self.id_col).distinct()
            rows = rows.join(known, self.id_col, "left_anti")
        one = rows.groupBy(self.id_col).agg(F.min(self.text_col).alias(self.text_col))
        # a writing without words is known as well, by a row without a term
        terms = one.select(self.id_col, F.explode_outer(keyness.tx.tokens(F.col(self.text_col))).alias("term"))
        terms.groupBy(self.id_col, "term").agg(F.count("term").alias("focus")).write.mode("overwrite").parquet(self._path("counts", number))
        counts = self.spark.read.parquet(self._path("counts", number)).where("term IS NOT NULL")
        totals = counts.select("term", F.col("focus").alias("total"))
        if earlier := [b for b in self._batches("totals") if b < number]:
            totals = totals.unionByName(self.spark.read.parquet(self._path("totals", earlier[-1])))
        totals.groupBy("term").agg(F.sum("total").alias("total")).write.mode("overwrite").parquet(self._path("totals", number))
        totals = self.spark.read.parquet(self._path("totals", number))
        sizes = counts.groupBy(self.id_col).agg(F.sum("focus").alias("n_focus"))
        whole = totals.agg(F.sum("total").alias("n_all"))  # one number
        found = counts.where(F.col("focus") >= self.least).join(totals, "term").join(sizes, self.id_col).crossJoin(F.broadcast(whole))
        found = found.withColumn("reference", F.col("total") - F.col("focus")).withColumn("n_reference", F.col("n_all") - F.col("n_focus"))
        place = Window.partitionBy(self.id_col).orderBy(F.desc(F.round("score", 6)), "term")
        best = keyness.scored(found).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= self.top)
        best.select(self.id_col, "rank", "term", F.round("score", 6).alias("score"), "focus").write.mode("overwrite").parquet(self._path("keywords", number))

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """All that the stream holds now, batch by batch; called again, it goes on where it stopped."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def keywords(self) -> DataFrame:
        """id, rank, term, score, focus, batch of all batches that are done."""
        return self.spark.read.option("basePath", f"{self.folder}/keywords").parquet(*(self._path("keywords", b) for b in self._batches("keywords")))
