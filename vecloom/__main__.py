"""Designs a codebook from the command line:

    python -m vecloom VECTORS TRUE_N TARGET [--fit simplified|hybrid|tree] [--margin M] [--degree D] [--correct] [--out FOLDER]

VECTORS is a CSV file without a header, or a Parquet table with vec_id and embedding.  Prints the
size of the table and the subspaces; with --out, writes the report and the trace of costs there.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from vecloom.params import Params
from vecloom.plans import pipelines
from vecloom.shipping import ship
from vecloom.sources import sinks
from vecloom.sources import vectors as V

FITS = {"simplified": pipelines.recommend, "hybrid": pipelines.fit_allpairs, "tree": pipelines.fit_tree}


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="vecloom")
    p.add_argument("vectors")
    p.add_argument("true_n", type=int)
    p.add_argument("target", type=float)
    p.add_argument("--fit", choices=FITS, default="simplified")
    p.add_argument("--margin", type=float, default=0.0)
    p.add_argument("--degree", type=int, default=0)
    p.add_argument("--correct", action="store_true")
    p.add_argument("--out")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("vecloom").getOrCreate()
    ship(spark)
    table = V.read_csv(spark, a.vectors) if a.vectors.endswith(".csv") else spark.read.parquet(a.vectors).select("vec_id", "embedding")
    size = V.shape(table).first()
    print(f"Data size: {size.n_values}\nNumber of vectors: {size.n}\nDimensionality: {size.d}")
    model = FITS[a.fit](table, Params(a.true_n, a.target, a.margin, a.degree, a.correct))
    lines = sinks.summary_lines(model.summary) if model.codebook is None else sinks.codebook_lines(model.codebook)
    for r in sinks.summary_lines(model.summary).collect():  # three lines a subspace
        print(r.line)
    if a.out:
        sinks.write_text(lines, f"{a.out}/report")
        sinks.write_parquet(model.trace, f"{a.out}/trace")


if __name__ == "__main__":
    main()
