"""Text reports and files of designed codebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def codebook_lines(codebook: DataFrame, digits: int | None = None) -> DataFrame:
    """(subspace_id, line_no, line): a heading, the dimensions, and a line per codeword.

    codebook: subspace_id, dims, code_id, codeword; digits: decimals of components, or as many as they have.
    """
    text = (lambda x: x.cast("string")) if digits is None else (lambda x: F.format_string(f"%.{digits}f", x.cast("double")))
    word = codebook.select("subspace_id", (F.col("code_id") + 2).alias("line_no"), F.concat_ws(" ", F.transform("codeword", text)).alias("line"))
    return _headed(codebook.select("subspace_id", "dims").distinct()).unionByName(word).orderBy("subspace_id", "line_no")


def summary_lines(summary: DataFrame) -> DataFrame:
    """The same with a count in place of codewords.  summary: subspace_id, dims, num_codewords."""
    count = summary.select("subspace_id", F.lit(2).alias("line_no"), F.concat(F.lit("Number of codewords: "), F.col("num_codewords").cast("string")).alias("line"))
    return _headed(summary.select("subspace_id", "dims")).unionByName(count).orderBy("subspace_id", "line_no")


def _headed(subspaces: DataFrame) -> DataFrame:
    dims = F.concat(F.lit("Dimensions: "), F.concat_ws(" ", F.transform("dims", lambda x: x.cast("string"))))
    head = subspaces.select("subspace_id", F.lit(0).alias("line_no"), F.concat(F.lit("Subspace "), F.col("subspace_id").cast("string"), F.lit(":")).alias("line"))
    return head.unionByName(subspaces.select("subspace_id", F.lit(1).alias("line_no"), dims.alias("line")))


def write_text(lines: DataFrame, path: str) -> None:
    """One ordered text file; reports have a few lines per codeword."""
    lines.orderBy("subspace_id", "line_no").coalesce(1).select("line").write.mode("overwrite").text(path)


def write_parquet(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)
