"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard has ``replicas`` points on a ring of 2**32 places; a row stands at the hash of its
doc_id and belongs to the next point clockwise.  Shards hold floor or ceil of rows / shards, so
counts differ by one at most.  Rows are admitted in turns: in turn t, each row that has no shard yet
stands before the t-th point clockwise from its own, and the shard takes those before it, by arc and
then by rank within the arc, as far as it has room.  All others walk on.

Rows of one arc walk the same way, so only their number matters: the driver plans with one count per
arc (shards * replicas, whatever the input), and rows find their shard by their rank in the arc.  Ranks
follow a hash of what a row says and of its place among equal rows, so the same rows get the same
shards in whatever files or order they come.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import table

CELLS = 4096
RING = 1 << 32
RANKED = 20_000


def ring(shards: int, replicas: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise.  Adding a shard only adds points."""
    return sorted((int(hashlib.md5(f"shard {s} point {r}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for r in range(replicas))


def plan(counts: dict[int, int], points: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, rows, shard, first slot): where the rows of each arc go."""
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    taken = [0] * shards
    out, waiting, turn = [], [(arc, 0, c) for arc, c in sorted(counts.items()) if c], 0
    while waiting:
        rest = []
        for arc, start, c in waiting:
            s = points[(arc + turn) % len(points)][1]
            k = min(c, room[s] - taken[s])
            if k:
                out.append((arc, start, k, s, taken[s]))
                taken[s] += k
            if k < c:
                rest.append((arc, start + k, c - k))
        waiting, turn = rest, turn + 1
    return out


def assign(docs: DataFrame, shards: int = 24, replicas: int = 128) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Law ``rows``.  size: UTF-8 bytes of the text plus 8 (null text: 8, and crc32 of nothing, 0).
    Rows with a null doc_id stand at one place of the ring together.  A doc_id that many rows share
    fills its shard and then walks on clockwise.  Ranks within an arc are taken in ranges of hashes of
    about RANKED rows, so that such a doc_id doesn't end up in one task, and neither do equal rows,
    whose places among each other are counted per task of the scan.  An empty table gives an empty result.  Other columns are ignored.
    Of a text only its length and its checksum are used, however long it is.
    """
    spark = docs.sparkSession
    points = ring(shards, replicas)
    step = RING // CELLS
    cells = []
    for c in range(CELLS):
        k = bisect.bisect_left(points, (c * step, -1))
        own = []
        while k < len(points) and points[k][0] < (c + 1) * step:
            own.append({"place": points[k][0], "arc": k})
            k += 1
        cells.append({"cell": c, "arcs": [*own, {"place": RING, "arc": k % len(points)}]})
    near = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(cells)), "array<struct<cell:int,arcs:array<struct<place:bigint,arc:int>>>>")))
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("bigint")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("bigint").alias("text_crc32"),
        place.alias("place"), F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.withColumn("cell", F.expr(f"int(place div {step})"))
    # near has CELLS rows and shards * replicas points, whatever the input
    rows = rows.join(F.broadcast(near), "cell").withColumn("arc", F.filter("arcs", lambda a: a["place"] >= F.col("place"))[0]["arc"])
    rows = table(rows.select("doc_id", "size", "text_crc32", "row", "arc"), "ring")
    counts = {r.arc: r["count"] for r in rows.groupBy("arc").count().collect()}  # shards * replicas numbers at most
    segments = plan(counts, points, shards)
    by_arc: dict[int, list[dict]] = {}
    for arc, start, k, s, slot in segments:
        by_arc.setdefault(arc, []).append({"start": start, "rows": k, "shard": s, "slot": slot})
    plans = [{"arc": a, "parts": counts[a] // RANKED + 1, "segments": x} for a, x in by_arc.items()]
    plans = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plans)), "array<struct<arc:int,parts:int,segments:array<struct<start:bigint,rows:bigint,shard:int,slot:bigint>>>>")))
    rows = rows.join(F.broadcast(plans), "arc")  # a row per arc, and a segment more each time that a shard fills
    # equal rows: their numbers follow each other, over the tasks that wrote them
    same, task = ["doc_id", "text_crc32", "size"], F.shiftright("row", 33).alias("task")
    rows = rows.withColumn("task", task).withColumn("nth", F.row_number().over(Window.partitionBy(*same, "task").orderBy("row")) - 1)
    held = rows.groupBy(*same, "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*same).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    held = held.withColumn("from", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(F.col("from") > 0).select(*(F.col(c).alias(f"of_{c}") for c in (*same, "task")), "from")
    alike = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*same, "task")]
    rows = rows.join(held, alike, "left").withColumn("nth", F.col("nth") + F.coalesce("from", F.lit(0)))
    rows = rows.withColumn("turn", F.xxhash64(*same, "nth")).withColumn("high", F.shiftrightunsigned("turn", 33))
    rows = rows.withColumn("part", F.shiftright(F.col("high") * F.col("parts"), 31))
    before = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("arc", "part").agg(F.count(F.lit(1)).alias("n")).select("arc", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.withColumn("own", F.row_number().over(Window.partitionBy("arc", "part").orderBy("high", "turn", *same, "nth")) - 1)
    ranked = ranked.join(parts, ["arc", "part"]).withColumn("rank", F.col("base") + F.col("own"))
    home = F.filter("segments", lambda x: (x["start"] <= F.col("rank")) & (F.col("rank") < x["start"] + x["rows"]))[0]
    return ranked.withColumn("home", home).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("home.shard").alias("shard"),
        (F.col("home.slot") + F.col("rank") - F.col("home.start")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
