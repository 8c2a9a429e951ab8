"""Where frames come from: landed text files, tables of frames, or a message topic.

Every source gives ``frame`` plus ``ingest_*`` columns that say in which order frames arrived.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktape import schemas as S

FRAME_TABLE_SCHEMA = "ingest_seq BIGINT, frame STRING"
#: Splits per core from which on a table is read where it lies.
_SPLITS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """A freshly read table, dealt out evenly to all cores unless it has many splits for each of them.

    Decoding costs far more than moving a table.  A split is no measure of rows: a row group of a columnar file lies in one
    split, whole, and the others of that file are empty.  With several splits a core that evens out, and a large table stays
    where it is.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df if splits >= _SPLITS_PER_CORE * cores else df.repartition(max(cores, splits))


def numbered(frames: DataFrame) -> DataFrame:
    """Text frames with ``ingest_seq``, their order inside a file block.  Not for a stream itself, but for its
    micro-batches."""
    return frames if "ingest_seq" in frames.columns else frames.withColumn("ingest_seq", F.monotonically_increasing_id())


def _text_lines(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("value").alias("frame"),
        F.col("_metadata.file_modification_time").alias("ingest_ts"),
        F.format_string("%s#%020d", "_metadata.file_path", "_metadata.file_block_start").alias("ingest_src"),
    )


def read_text_frames(spark: SparkSession, path: str | list[str], line_sep: str = "\n", tolerant: bool = False) -> DataFrame:
    """Landed text files, one frame to a line.

    Files arrive by modification time and name; inside a file, blocks and lines keep their order.  ``tolerant`` reads a damaged
    file as far as it goes instead of ending the job.
    """
    reader = spark.read.option("ignoreCorruptFiles", tolerant).option("lineSep", line_sep)
    return spread(numbered(_text_lines(reader.text(path))))


def read_frame_table(spark: SparkSession, path: str | list[str], file_format: str = "parquet", tolerant: bool = False) -> DataFrame:
    """A table of ``ingest_seq`` and ``frame`` (Parquet, ORC or JSON lines).  ``tolerant`` as for text."""
    reader = spark.read.schema(FRAME_TABLE_SCHEMA).option("ignoreCorruptFiles", tolerant)
    return spread(reader.format(file_format).load(path))


def landed_files(spark: SparkSession, path: str) -> list[str]:
    """The files under a path, as Spark lists them."""
    return sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())


def unreadable_files(spark: SparkSession, files: list[str], read: Callable[..., DataFrame]) -> list[str]:
    """Those of ``files`` that cannot be read to their end.

    All of them are read in one distributed job; only if it fails are they halved, again and again, so b damaged files among n cost
    about b log n jobs, and none costs one.
    """
    if not files:
        return []
    try:
        read(spark, files, tolerant=False).agg(F.max(F.length("frame"))).collect()
        return []
    except (PySparkException, Py4JJavaError):
        if len(files) == 1:
            return files
    half = len(files) // 2
    return unreadable_files(spark, files[:half], read) + unreadable_files(spark, files[half:], read)


def lost_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    """Damaged files as rejects: the path and the reason."""
    return spark.createDataFrame([(f, S.UNREADABLE_FILE) for f in files], "raw STRING, reason STRING")


def read_with_losses(spark: SparkSession, path: str, read: Callable[..., DataFrame] = read_frame_table) -> tuple[DataFrame, DataFrame]:
    """The frames under a path, damaged files as far as they go, and the damaged files as rejects.

    ``read`` is ``read_frame_table`` or ``read_text_frames``.  The files are read once more than without the account of losses.
    """
    files = landed_files(spark, path)
    lost = unreadable_files(spark, files, read)
    return read(spark, files, tolerant=bool(lost)), lost_rows(spark, lost)


def stream_text_frames(
    spark: SparkSession, path: str, max_files: int = 100, line_sep: str = "\n", tolerant: bool = False
) -> DataFrame:
    """Text files as they land, a frame to a line, each with its file and block.

    A stream cannot number its lines; ``numbered`` does in its micro-batches, which gives every frame its place as
    in ``read_text_frames``.  ``max_files`` per micro-batch is the back-pressure.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", max_files).option("ignoreCorruptFiles", tolerant)
    return _text_lines(reader.option("lineSep", line_sep).text(path))


def stream_frame_table(
    spark: SparkSession, path: str, file_format: str = "parquet", max_files: int = 100, tolerant: bool = False
) -> DataFrame:
    """A growing table of ``ingest_seq`` and ``frame``, for work that depends on arrival order.

    ``tolerant`` reads a damaged file as far as it goes; ``tables.note_lost_files`` then keeps the account.
    """
    return (
        spark.readStream.schema(FRAME_TABLE_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .option("ignoreCorruptFiles", tolerant)
        .format(file_format)
        .load(path)
    )


def kafka_frames(
    spark: SparkSession, servers: str, topic: str, max_offsets: int | None = 100_000, stream: bool = True
) -> DataFrame:
    """Frames from a Kafka topic, ``max_offsets`` of them per micro-batch at most.

    Needs the Kafka connector on the class path.
    """
    reader = (spark.readStream if stream else spark.read).format("kafka")
    reader = reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_offsets is not None and stream:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return kafka_records(reader.load())


def kafka_records(records: DataFrame) -> DataFrame:
    """The frame columns of raw topic records.

    A frame may hold several pairs, so a topic is not keyed by pair: records are ordered by their time first,
    and by partition and offset where that is equal.
    """
    source: Column = F.format_string("%s#%010d", "topic", "partition")
    return records.select(
        F.col("value").cast("string").alias("frame"), F.col("timestamp").alias("ingest_ts"), source.alias("ingest_src"),
        F.col("offset").alias("ingest_seq"),
    )


def frames_from_text(df: DataFrame, column: str, seq: str) -> DataFrame:
    """Frames held in a text column of any table, ordered by a BIGINT column."""
    return df.select(F.col(column).alias("frame"), F.col(seq).cast("long").alias("ingest_seq"))
