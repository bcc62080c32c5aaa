"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Partitions permute their rows locally; a matrix drawn on the driver (partitions x shards numbers, never
rows) says how many of each partition's rows go to each shard; after the exchange every shard permutes
again. Shard sizes differ by one row at most (law ``rows``).

Defined results: NULL texts have no bytes; repeated rows are dealt as rows of their own; an empty table
gives an empty result; no column of the input can clash, all stay inside ``row``.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.session import stage

SHARDS = 8
#: Rows that one task orders in the second permutation.
BUCKET_ROWS = 16_384
_LOCAL = (1 << 33) - 1


def hypergeometric(good: int, bad: int, drawn: int, u: float) -> int:
    """How many of ``drawn`` items are good, by inversion of ``u`` outward from the mode."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(max((drawn + 1) * (good + 1) // (good + bad + 2), low), high)

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    down = up = mode
    p_down = p_up = p
    u -= p
    while u > 0 and (down > low or up < high):
        next_down = p_down * down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1)) if down > low else -1.0
        next_up = p_up * (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1)) if up < high else -1.0
        if next_up >= next_down:
            up, p_up = up + 1, next_up
            u -= p_up
            mode = up
        else:
            down, p_down = down - 1, next_down
            u -= p_down
            mode = down
        if max(p_up, p_down) == 0.0:
            break
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard: margins exact, drawn as a uniform shuffle would."""
    draw = random.Random(seed)
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in counts:
        row, left, rest = [], n, sum(room)
        for s in range(shards):
            rest -= room[s]
            take = hypergeometric(room[s], rest, left, draw.random())
            row.append(take)
            left -= take
        room = [a - b for a, b in zip(room, row)]
        matrix.append(row)
    return matrix


def shuffle_rows(df: DataFrame, shards: int = SHARDS, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``row`` (all columns), ``shard`` and ``slot`` (from 0 without gaps within each shard)."""
    spark = df.sparkSession
    mixed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.rand(seed).alias("_r"))
    local = stage(mixed.sortWithinPartitions("_r").select("row", F.monotonically_increasing_id().alias("at")))
    pid = F.shiftright("at", 33)
    counts = sorted((r["pid"], r["n"]) for r in local.groupBy(pid.alias("pid")).agg(F.count("*").alias("n")).collect())
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    ends = [[sum(row[: s + 1]) for s in range(shards)] for row in matrix]
    plan = spark.createDataFrame([(p, e) for (p, _), e in zip(counts, ends)], "pid long, ends array<long>")
    rows = sum(n for _, n in counts)
    buckets = max(1, -(-rows // (shards * bucket_rows)))
    rank = F.col("at").bitwiseAND(F.lit(_LOCAL))
    # as many rows as the table has partitions: bounded by the number of its files' splits
    dealt = (local.withColumn("pid", pid).join(F.broadcast(plan), "pid")
             .withColumn("shard", F.size(F.filter("ends", lambda e: e <= rank)))
             .withColumn("again", F.xxhash64(F.lit(seed), F.lit("second"), "at"))
             .withColumn("bucket", F.pmod("again", F.lit(buckets))))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
               .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("again", "at"))
    numbered = dealt.select("row", "shard", "bucket", place.alias("place"))
    return (numbered.join(offsets, ["shard", "bucket"])
            .select("row", "shard", (F.col("offset") + F.col("place") - 1).alias("slot")))


def sized(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """What the digest of a shuffle needs of each row: id, UTF-8 bytes plus one, checksum."""
    value = F.coalesce(F.col(text), F.lit(""))
    return documents.select(F.col(id), (F.octet_length(value) + 1).cast("long").alias("size"),
                            F.crc32(value.cast("binary")).alias("text_crc32"))
