"""Exact duplicates by a persistent index of text digests, bucketed and sorted by digest.

The index is a Parquet table in a folder of its own: a row for each distinct text seen so far, with the row that stays.
New data loses its own copies first, then meets the index in a sort-merge anti-join on its buckets, and only what is
left is appended. The index itself is neither shuffled nor rewritten: a batch costs its own digests and one scan of
the index, whose rows are 50 bytes or so. A folder may be opened again by any later session.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import dropped, shared_dir, written

#: White space that counts as one space when texts are compared.
SPACES = r"[\x20\x09-\x0D]+"
#: Copies of a text are spread over so many keys where rows look up their group.
SPREAD = 64


def normalised(text: Column) -> Column:
    """A text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, row) of every document, written, so that the row numbers hold for all that follows."""
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()))


class DigestIndex:
    """A folder of (digest, id, row, batch), bucketed and sorted by digest.

    The number of buckets is fixed when a folder is made and read from its name after that.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        found = self._buckets_of_folder()
        if found is not None and buckets not in (None, found):
            raise ValueError(f"the index in {path} has {found} buckets, not {buckets}")
        self.buckets = found or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{self.path}/buckets={self.buckets}"
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self.kind: T.DataType | None = None
        if found is not None:
            self._declare(spark.read.parquet(self.folder).schema["id"].dataType)

    def _files(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _buckets_of_folder(self) -> int | None:
        at, fs = self._files()
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        found = [int(m[1]) for n in names if (m := re.fullmatch(r"buckets=(\d+)", n))]
        return found[0] if found else None

    def _declare(self, kind: T.DataType) -> None:
        """The catalogue entry of this session. The files hold no trace of the buckets' rule, so it is given here."""
        self.kind = kind
        self.spark.sql(
            f"CREATE TABLE {self.name} (id {kind.simpleString()}, row BIGINT, batch BIGINT, digest BINARY) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Appends the texts of rows (id, digest, row) that the index lacks, each with its smallest id.

        Copies are pre-aggregated before the shuffle, so a text with any number of copies is a row for each task. Of
        rows with the smallest id, the one with the smallest row number stays; null ids come last. Adding rows twice,
        as a retry does, changes nothing.
        """
        if self.kind is None:
            self._declare(rows.schema["id"].dataType)
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
        # Written, as Spark would move the join below the aggregate, where each copy is a row.
        new = written(rows.groupBy("digest").agg(least.alias("m")).select(F.col("m.id").alias("id"), F.col("m.row").alias("row"), F.lit(batch).cast("long").alias("batch"), "digest"))
        fresh = new.hint("merge").join(self.table(), "digest", "left_anti").select("id", "row", "batch", "digest")
        fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.folder).saveAsTable(self.name)
        dropped(new)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Forgets the catalogue entry; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def delete(self) -> None:
        """Deletes the folder as well."""
        self.close()
        at, fs = self._files()
        fs.delete(at, True)


def verdicts(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Each of rows (id, digest, row) with keep_id, group_size (over these rows), kept and its digest.

    Only texts with several rows, or whose stayer is not among these rows, need a look-up: their groups are repeated
    over SPREAD keys, and the rows of one text are dealt over those. Row numbers of other sessions may be the same, so
    the stayer is told by its id as well.

    The repeated groups meet the rows by sort and merge: Spark takes their size for that of the groups, and would send
    what is SPREAD times as large to the driver.
    """
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.min("row").alias("own"), F.min("id").alias("own_id"))
    groups = written(sizes.join(index.select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row")), "digest").where("group_size > 1 or own <> keep_row or not own_id <=> keep_id"))
    spread = F.pmod(F.xxhash64("row"), F.lit(SPREAD)).cast("int")
    some = groups.select("digest", "group_size", "keep_id", "keep_row", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
    out = rows.withColumn("spread", spread).join(some.hint("merge"), ["digest", "spread"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row")) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrivals: int = 2, index_path: str | None = None, buckets: int | None = None) -> DataFrame:
    """One row per document: its id, keep_id (the id of the row that stays), group_size, kept and text_sha256.

    Documents come to the index in `arrivals` batches, cut at equal steps between the smallest and the largest id where
    ids are numbers (else in one batch), the smaller ids first; so the index keeps the smallest id of equal texts. The
    index in `index_path` stays there and should be new; without a path it is made in the shared folder and deleted.

    Null text counts as empty, as do no other texts: one of white space alone is a single space. Of repeated rows with
    one id and text one is kept. Null ids come last, so one stays only where a text has no other. An empty table gives
    no rows. Other columns are not read. A text is read once, in one row of one task, whatever its length.
    """
    rows = digests(docs, id_col, text_col)
    index = DigestIndex(docs.sparkSession, index_path or f"{shared_dir(docs.sparkSession)}/digests-{uuid.uuid4().hex}", buckets)
    kind = rows.schema["id"].dataType
    low, high = rows.agg(F.min("id"), F.max("id")).first() if isinstance(kind, T.IntegralType) else (None, None)
    cuts = [low + (high - low) * k // arrivals for k in range(1, arrivals)] if low is not None else []
    for k, (after, upto) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = rows
        if after is not None:
            part = part.where((F.col("id") > after) | F.col("id").isNull() if upto is None else F.col("id") > after)
        if upto is not None:
            part = part.where(F.col("id") <= upto)
        index.add(part, k)
    out = written(verdicts(rows, index.table()))
    index.close() if index_path else index.delete()
    dropped(rows)
    return out.withColumnRenamed("id", id_col)
