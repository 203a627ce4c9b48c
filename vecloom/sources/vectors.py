"""Vector tables: (vec_id, embedding ARRAY<FLOAT>), and their long form (vec_id, dim, x)."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated floats without a header, a vector per line; vec_id numbers the lines from 0.

    Several files count in the order of their names.  Lines are numbered once, in a checkpoint: how
    files are split can differ from one scan to the next.  Blank, ragged or non-numeric lines raise
    an error when they are read.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")
    checkpoint_dir(spark)
    lines = lines.checkpoint()
    sizes = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)  # a row per input split
    starts = sizes.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    top = lines.orderBy("file", "split", "row").select("value").head()
    width = len((top or [""])[0].split(","))
    cells = F.split("value", ",")
    vector = F.when(F.size(cells) == width, cells.cast("array<float>")).otherwise(F.raise_error(F.concat(F.lit("ragged line: "), F.col("value"))))
    return lines.join(starts, ["file", "split"]).select((F.col("start") + F.col("row") - F.col("first")).alias("vec_id"), vector.alias("embedding"))


def checkpoint_dir(spark: SparkSession) -> None:
    """The session's shared folder; a temporary one only in local mode where it is unset."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="vecloom-")
    sc.setCheckpointDir(shared)


def write_csv(vectors: DataFrame, path: str) -> None:
    """What read_csv reads, in the order of vec_id: files are named in that order."""
    line = F.concat_ws(",", F.transform("embedding", lambda x: x.cast("string")))
    vectors.orderBy("vec_id").select(line).write.text(path)


def read_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def from_rows(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    """A row-major matrix in memory."""
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")


def components(vectors: DataFrame) -> DataFrame:
    """One row per vector and dimension: vec_id, dim, x."""
    return vectors.select("vec_id", F.posexplode("embedding").alias("dim", "x"))


def from_components(long: DataFrame) -> DataFrame:
    """The inverse of components."""
    cells = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return long.groupBy("vec_id").agg(cells.alias("cells")).select("vec_id", F.col("cells.x").alias("embedding"))


def shape(vectors: DataFrame) -> DataFrame:
    """n_values, n, d."""
    return vectors.agg(F.sum(F.size("embedding")).cast("long").alias("n_values"), F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d"))
