"""Shared parts of the corpus operators: durable tables, word hashing, connected components.

Word hashing works on the UTF-8 bytes of a whole Arrow batch at once.  Every byte b has a random
64-bit value T[b]; a span has the polynomial hash sum T[b_j] * P**j (mod 2**64), read off prefix
sums in O(1) and then mixed.  Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ------------------------------------------------------------------ durable tables


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if configured is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="vecloom-")
        sc.setCheckpointDir(configured)
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


#: whether Spark deletes what a query has shuffled once the query has ended
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    What was shuffled on the way is deleted then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables written by table() that nothing will read any more."""
    for t in tables:
        remove(t.sparkSession, t.folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A durable copy of df with a number of its own for every row, and the name of that column.

    Numbers are only the same from one use to the next once they are written.
    """
    key = free_names(df, "row")[0]
    return table(df.withColumn(key, F.monotonically_increasing_id()), name), key


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with underscores until df has none like it; Spark ignores case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Lets Spark hand texts to Python in Arrow batches of about 4 MB rather than 64 MB, for the rest of the session.

    A batch is held by the JVM, outside its heap, and by the Python worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # nobody has chosen a size
        spark.conf.set(name, str(size))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bloom(ids: DataFrame, column: str, bits: int = 1 << 27, mixed: bool = False) -> np.ndarray:
    """A bitmap of hashed ids, of ``bits`` bits at most (16 MB) however many ids there are.

    A set bit only says that an id may be among them, so a full bitmap costs time and no rows.
    mixed: the ids are hashes themselves; their low bits are the place.
    """
    many = max(1 << 16, ids.count() * 16)
    bits = min(bits, 1 << (many - 1).bit_length())
    key = F.col(column).cast("long")
    at = F.pmod(key if mixed else F.xxhash64(key), F.lit(bits)) + 1
    rows = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map")).collect()
    out = np.zeros((bits + 32767) // 32768 * 4096, np.uint8)
    for r in rows:
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.map), np.uint8)
    return out


# ------------------------------------------------------------------ word hashing

SEGMENT = 1 << 19
#: stand for the start and the end of a text among words
START, END = np.uint64(0x5D588B656C078965), np.uint64(0x269EC3B1F0E2D7A5)
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= SEGMENT:
        up, down = np.full(SEGMENT + 1, _BASE, np.uint64), np.full(SEGMENT + 1, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def _next_space(data: np.ndarray, at: int, end: int) -> int:
    """The first white space in data[at:end], or end."""
    while at < end:
        gaps = np.flatnonzero(_SPACE[data[at : min(end, at + SEGMENT)]])
        if len(gaps):
            return at + int(gaps[0])
        at += SEGMENT
    return end


def _long_word(part: np.ndarray, values: np.ndarray) -> np.uint64:
    """The hash of a word of any length, a segment at a time."""
    up, total = _power_tables()[0], 0
    for at in range(0, len(part), SEGMENT):
        some = part[at : at + SEGMENT]
        total += int((values[some] * up[: len(some)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return mix(np.array([total % (1 << 64)], np.uint64))[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, in order, and for each row the position of its first word (rows + 1 values)."""
    h, _, _, at = word_spans(data, offsets, fold)
    return h, at


def word_spans(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word, in order, and for each row the position of its first word (rows + 1 values).

    fold lower-cases A-Z.  Works through segments cut at spaces and row ends, so memory beyond the
    result stays near 30 MB.
    """
    values = _FOLDED if fold else _BYTES
    hashes, starts, ends, at, end = [], [], [], 0, len(data)
    up, down = _power_tables()
    while at < end:
        stop = min(end, at + SEGMENT)
        if stop < end:
            gaps = np.flatnonzero(_SPACE[data[at:stop]])
            row = offsets[np.searchsorted(offsets, stop, "right") - 1]
            best = max(int(gaps[-1]) + 1 + at if len(gaps) else 0, int(row))
            if best > at:
                stop = best
            else:  # one word fills the segment
                stop = _next_space(data, stop, int(offsets[np.searchsorted(offsets, at, "right")]))
                hashes.append(np.array([_long_word(data[at:stop], values)], np.uint64))
                starts.append(np.array([at]))
                ends.append(np.array([stop]))
                at = stop
                continue
        part = data[at:stop]
        space = _SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        own = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop, "right")] - at
        edge[own] = True
        edge[0] = edge[-1] = True
        word = ~space
        first = word & edge[:-1]
        first[1:] |= word[1:] & space[:-1]
        last = word & edge[1:]
        last[:-1] |= word[:-1] & space[1:]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up[: len(part)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s, e = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
    return h, s, e, np.searchsorted(s, offsets)


def word_parts(column: pa.Array, fold: bool = True, most: int = 1 << 23) -> Iterator[tuple[np.ndarray, np.ndarray, bool, bool]]:
    """Word hashes and row positions as word_hashes gives them, and whether each row begins and ends in this part.

    A batch is one part, but a single row of more than ``most`` bytes comes in parts cut at white
    space, so that work on its words needs no more memory than on a batch.
    """
    raw, offsets = utf8(column)
    if len(offsets) != 2 or len(raw) <= most:
        yield *word_hashes(raw, offsets, fold), True, True
        return
    at = 0
    while at < len(raw):
        stop = _next_space(raw, min(len(raw), at + most), len(raw))
        words, _ = word_hashes(raw[at:stop], np.array([0, stop - at]), fold)
        yield words, np.array([0, len(words)]), at == 0, stop == len(raw)
        at = stop


def bigrams(column: pa.Array, fold: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool, bool]]:
    """History and word of each token, ends included, each row's number of tokens, whether rows begin here, and whether they end here.

    A long row comes in parts (see word_parts).
    """
    last = START
    for words, at, opens, closes in word_parts(column, fold):
        if closes:
            words = np.insert(words, at[1:], END)
            at = at + np.arange(len(at))
        history = np.empty_like(words)
        history[1:] = words[:-1]
        if opens:
            history[at[:-1]] = START
        elif len(words):
            history[0] = last
        last = words[-1] if len(words) else last
        yield history, words, np.diff(at), opens, closes


def batches(rows: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes, at least a row each; what the work on them leaves unused goes back to the system."""
    map_large()
    for batch in rows:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * size / max(size, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)
    trim()


@cache
def map_large(size: int = 1 << 20) -> None:
    """Lets this process take memory for larger arrays from the system and give it back at once.

    By default such blocks are soon kept in a heap, whose gaps add up to several times what is in use.
    """
    adjust = getattr(ctypes.CDLL(None), "mallopt", None)
    if adjust is not None:  # glibc has it; -3 is M_MMAP_THRESHOLD
        adjust(-3, size)


def trim() -> None:
    """Gives memory that this process has freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trimmer = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trimmer is not None:  # glibc has it
        trimmer(0)


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, byte by byte: the compressor finds the empty ones."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, :width] = part.T
    return out.view("<u8").ravel()


# ------------------------------------------------------------------ connected components


def components(nodes: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node reachable over links(u, v).

    Each round takes the smallest label among neighbours and then jumps to the label's label, so
    the number of rounds grows with the logarithm of the longest path.  All tables are distributed;
    the driver sees one count per round.
    """
    both = checkpoint(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    touched = both.select(F.col("u").alias("node")).distinct()
    labels = checkpoint(touched.withColumn("label", F.col("node")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = checkpoint(low.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        moved = new.where("was <> label").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
