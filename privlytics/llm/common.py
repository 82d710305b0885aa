"""Shared pieces: scratch tables, sizes, row keys, spans of regular expressions."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables up to this many bytes may be broadcast; the size is measured, not assumed.
BROADCAST_BYTES = 64 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; where none is set, a folder of the warehouse, which is shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/privlytics"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    # small row groups: writers of large binary values hold a whole one in memory
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Hand memory that is free back to the system; where the C library has no ``malloc_trim`` only Arrow's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow``; afterwards its worker, which stays for later tasks, keeps no free memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the sum of ``row_bytes`` is within ``limit``; else as it is (a shuffle join)."""
    size = df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def crc_mod(column: Column, m: int) -> Column:
    return F.crc32(column.cast("string")) % F.lit(m)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Matches that are walked at once: an array that grows by one item is copied each time.
WALK = 128


def regex_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,value>>; code points, end exclusive.

    Starts come from the lengths of the pieces between the matches, so the text is walked twice and never per match. The
    walk goes block by block of ``WALK`` matches, so its time grows with the matches, not with their square.
    """
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    item = "struct<start:int,end:int,value:string>"
    gaps = F.zip_with(pieces, found, lambda p, m: F.struct(F.char_length(p).alias("gap"), m.alias("m")))

    def walk(part: Column, at: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(at.alias("at"), F.array().cast(f"array<{item}>").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + F.coalesce(F.char_length(x["m"]), F.lit(0))).alias("at"),
                F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.char_length(x["m"])).alias("end"), x["m"].alias("value"))))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    def blocks(whole: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / WALK).cast("int")), lambda b: F.slice(whole, b * WALK + 1, F.lit(WALK)))
        span = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(F.char_length(x["m"]), F.lit(0)))
        placed = F.aggregate(
            cut,
            F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,part:array<struct<gap:int,m:string>>>>").alias("out")),
            lambda acc, part: F.struct((acc["at"] + span(part)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), part.alias("part")))).alias("out")),
            lambda acc: acc["out"],
        )
        return F.flatten(F.transform(placed, lambda b: walk(b["part"], b["at"])))

    # rows without a match skip the walk
    return F.when(F.size(found) == 0, F.array().cast(f"array<{item}>")).when(F.size(found) < 2 * WALK, walk(gaps, F.lit(0))).otherwise(blocks(gaps))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
