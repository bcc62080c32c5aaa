"""A bit table of fixed size that tells which rows cannot have a partner, before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits that a table can have; its rows are two longs each, so at most 16 MB are broadcast.
WORDS = 1 << 20


def flagged(rows: DataFrame, table: DataFrame, key: str, flag: str = "met") -> DataFrame:
    """``rows`` with a boolean ``flag``: false where ``table`` surely lacks the row's ``key``.

    A key sets two bits of one word. With few keys to a word nearly all other rows are told apart; a table that
    fills the words flags more rows than hold a partner, never fewer, so an exact join has to follow. NULL
    keys are false; an empty table flags none.
    """
    h = F.xxhash64(key)
    word = F.pmod(h, F.lit(WORDS)).alias("_word")
    bit = [F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64(`{key}`), {s}), 64) as int))") for s in (24, 40)]
    mask = bit[0].bitwiseOR(bit[1])
    words = (table.where(F.col(key).isNotNull()).select(word, mask.alias("_bits"))
             .groupBy("_word").agg(F.bit_or("_bits").alias("_bits")))
    hit = F.col(key).isNotNull() & (F.col("_bits").bitwiseAND(mask) == mask)
    return (rows.withColumn("_word", F.pmod(h, F.lit(WORDS))).join(F.broadcast(words), "_word", "left")
            .withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_word", "_bits"))


def narrowed(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` without those that ``flagged`` rules out: what an inner join with ``table`` has to shuffle."""
    return flagged(rows, table, key, "_met").where("_met").drop("_met")


def without(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Anti join: ``rows`` whose ``key`` is not in ``table``. Only flagged rows are shuffled; NULL keys stay."""
    told = flagged(rows, table, key, "_met")
    clear = told.where("NOT _met").drop("_met")
    return clear.unionByName(told.where("_met").drop("_met").join(table.select(key), key, "left_anti").select(*clear.columns))
