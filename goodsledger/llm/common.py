"""What the operators of this package share: column intake, stored intermediate tables, labelled samples."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema

from goodsledger.session import ensure_checkpoint_dir, ship_package

ID, TEXT = "_id", "_text"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def intake(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names of its own; a null text is empty.

    Further columns of the table are pruned here, so their names cannot clash with the operator's.
    """
    return docs.select(
        F.col(quoted(id_col)).alias(ID), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias(TEXT)
    )


def store(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and read it back.

    Cuts lineage, survives lost executors, and fixes row numbers given by ``monotonically_increasing_id``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/goodsledger-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """``store`` as a table bucketed by ``key``: later grouping by the key needs no shuffle of these rows."""
    spark = df.sparkSession
    name = f"goodsledger_{label}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def in_arrow(df: DataFrame, func, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(func, schema)


def id_type(df: DataFrame) -> str:
    return df.schema[ID].dataType.simpleString()


def byte_texts(batch: pa.RecordBatch) -> list[bytes]:
    """The whole texts of a batch in UTF-8."""
    return batch.column(TEXT).cast(pa.binary()).to_pylist()


def packed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``intake`` beside the whole row as one struct, for operators that return rows with all their columns."""
    return docs.select(
        F.struct("*").alias("row"),
        F.col(quoted(id_col)).alias(ID),
        F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias(TEXT),
    )


def derive(rows: DataFrame, func, fields: str) -> DataFrame:
    """Columns that ``func(texts) -> {name: values}`` makes of the whole texts, beside all of ``rows`` but the text."""
    made = T.StructType.fromDDL(fields)
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != TEXT), *made.fields])

    def run(batches):
        kinds = to_arrow_schema(made)
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names if name != TEXT}
            found = func(byte_texts(batch))
            columns |= {k.name: pa.array(found[k.name], k.type) for k in kinds}
            yield pa.RecordBatch.from_pydict(columns)

    return in_arrow(rows, run, schema)


def per_batch(batches: Iterable[pa.RecordBatch], build) -> Iterator[pa.RecordBatch]:
    """Apply ``build(ids, texts) -> arrays by name`` to each batch that has rows."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_pydict(build(batch.column(ID), byte_texts(batch)))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows that no model may learn from: crc32 of the id as text, remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, bound: int, learnable: Column | None = None):
    """Ids and labels of at most ``bound`` labelled rows, chosen by a hash of the id.

    The bound is the documented size of the training sample; the ids go to the driver, the texts do not.
    Rows without an id or label are no examples. An id that has several labels counts once per distinct label.
    """
    rows = labels.select(F.col(quoted(id_col)).alias(ID), F.col(quoted(label_col)).cast("int").alias("label"))
    rows = rows.where(F.col(ID).isNotNull() & F.col("label").isNotNull())
    if learnable is not None:
        rows = rows.where(learnable)
    rows = rows.distinct().orderBy(F.xxhash64(F.col(ID)), F.col(ID), F.col("label")).limit(bound)
    return [(r[ID], r["label"]) for r in rows.collect()]


def sample_texts(docs: DataFrame, sample: list[tuple]) -> DataFrame:
    """The sampled documents with their labels. The sample's size is bounded, so it is broadcast.

    The bound holds for rows too: where an id repeats, its text with the smallest hash counts, once per label.
    """
    spark = docs.sparkSession
    wanted = spark.createDataFrame(sample, f"{ID} {id_type(docs)}, label int")
    rows = docs.join(F.broadcast(wanted), ID)
    return rows.groupBy(ID, "label").agg(F.min_by(TEXT, F.struct(F.xxhash64(TEXT), TEXT)).alias(TEXT))


def keep_rows(docs: DataFrame, id_col: str, text_col: str, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``kept(_id, _sha, copies)`` names, with all their columns; of repeated rows one.

    A row is named by its id (null equals null) and the SHA-256 of its text. Only rows that are repeated
    (``copies`` over 1) are grouped once more; the others pass after one join.
    """
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(quoted(id_col)).alias(ID),
        F.sha2(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")), 256).alias("_sha"),
    )
    kept = kept.select(F.col(ID).alias("k_id"), F.col("_sha").alias("k_sha"), "copies")
    found = rows.join(kept, (F.col("_sha") == F.col("k_sha")) & F.col(ID).eqNullSafe(F.col("k_id")))
    once = found.where("copies = 1").select("row.*")
    repeated = found.where("copies > 1").groupBy(ID, "_sha").agg(F.first("row").alias("row")).select("row.*")
    return once.union(repeated)


def fold_of(value) -> int:
    """``held_out`` for one id outside Spark, as tests use it."""
    return zlib.crc32(str(value).encode()) % 5
