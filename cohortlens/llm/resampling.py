"""Resampling towards a target distribution: importance weights over hashed n-grams, and an exact top draw.

Features are runs of 1 to ``order`` words, hashed into ``buckets``. Bucket counts over all documents and over all
target texts give one gain per bucket, an array of fixed size that every task gets; a document's weight is the
floored mean of its features' gains. Weight and a noise that depends on seed and id alone add up to its score, so
that the highest scores are a draw without replacement in proportion to the weights.

The lowest score drawn is found without sorting: the scores are written once, and jobs that only count narrow the
threshold down, each by several probes, until it is exact. Of the rows tied at that score the ids are narrowed down
in the same way, then, where rows share score and id, their places. Only rows drawn are range-partitioned for ranks.

Defined results: NULL texts have no words; documents without features weigh 0; documents of fewer than ``least_words``
words get a score but are never drawn; a NULL id counts as empty in the noise and comes last among ties; repeated
rows count each, in the statistics and in the draw; texts of any length are read whole; an empty table gives an empty
result; input columns stay in ``row``. Ids are whole numbers.
"""

from __future__ import annotations

import math
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from cohortlens.llm.arrays import map_texts
from cohortlens.llm.terms import terms_of
from cohortlens.session import stage

#: Thresholds that one counting job tries.
PROBES = 15
#: Rows of one range when ranks are dealt.
RANGE_ROWS = 1 << 20
#: Bytes of words that a worker remembers the bucket of.
REMEMBERED = 1 << 24


class Buckets(dict):
    """Bucket of each feature met so far; forgets all of them when they hold too many bytes."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets, self.size = buckets, 0

    def __missing__(self, feature: bytes) -> int:
        self.size += len(feature)
        if self.size > REMEMBERED:
            self.clear()
            self.size = len(feature)
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features_of(text: str | None, order: int) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of 1 to ``order`` of them."""
    words = terms_of(text)
    runs = words
    for n in range(2, order + 1):
        runs = runs + [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    return len(words), runs


def hashed(texts: DataFrame, text: str, order: int, buckets: int, keep: list[str] | None) -> DataFrame:
    """``row``, ``n_words``, ``n_features`` and the features' buckets as the bytes of small numbers."""
    fields = StructType().add("n_words", LongType()).add("n_features", LongType()).add("buckets", BinaryType())
    kind = _kind(buckets)

    def make():
        bucket = Buckets(buckets)

        def work(column: pa.Array) -> list[pa.Array]:
            n_words, n_features, packed = [], [], []
            for value in column.to_pylist():
                n, runs = features_of(value, order)
                n_words.append(n)
                n_features.append(len(runs))
                packed.append(np.fromiter(map(bucket.__getitem__, runs), kind, len(runs)).tobytes())
            return [pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(packed, pa.binary())]
        return work

    return map_texts(texts, text, fields, make, keep)


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _packed(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of bytes, and where each row starts (one more for the end)."""
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return raw[bounds[0]:bounds[-1]].view(kind), (bounds - bounds[0]) // size


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: every task adds up its own rows, so at most ``buckets`` rows leave it."""
    kind = _kind(buckets)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_packed(batch.column(0), kind)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    partial = features.select("buckets").mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in partial.groupBy("bucket").agg(F.sum("n")).collect():  # at most `buckets` rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target and source shares of each bucket, floored."""
    n, S, T = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + n) / ((s + 1.0) * (T + n))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(seed: int, key: str | None) -> int:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a digest of seed and id."""
    h = int(sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gain: np.ndarray, key: str, seed: int) -> DataFrame:
    """``row``, ``n_words``, ``n_features``, ``weight``, ``score``, the id and the place of each document, written once."""
    carried = features.select("row", "n_words", "n_features", "buckets", F.col(f"row.`{key}`").cast("string").alias("key"))
    schema = StructType([carried.schema[c] for c in ("row", "n_words", "n_features")]).add("weight", LongType()).add("score", LongType())
    kind = _kind(len(gain))

    def run(batches):
        for batch in batches:
            rows, n_words, n_features, packed, keys = batch.columns
            numbers, bounds = _packed(packed, kind)
            total = np.concatenate([[0], np.cumsum(gain[numbers])])[bounds]
            weight = (total[1:] - total[:-1]) // np.maximum(np.diff(bounds), 1)
            drawn = np.fromiter((noise(seed, k) for k in keys.to_pylist()), np.int64, len(keys))
            yield pa.RecordBatch.from_arrays([rows, n_words, n_features, pa.array(weight), pa.array(weight + drawn)], schema.names)

    found = carried.mapInArrow(run, schema)
    return stage(found.withColumns({"_back": F.bitwise_not(F.col(f"row.`{key}`").cast("long")), "_place": F.monotonically_increasing_id()})
                 .withColumn("_back", F.coalesce("_back", F.lit(-(1 << 63)))))


def threshold(rows: DataFrame, column: str, need: int) -> int:
    """The largest value that at least ``need`` rows reach, by jobs that count the rows reaching each of some probes."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:  # `need` rows reach low; fewer reach high + 1
        probes = sorted({low + (high - low) * i // (PROBES + 1) + 1 for i in range(PROBES + 1)})
        counts = rows.agg(*(F.count_if(F.col(column) >= F.lit(p)).alias(f"c{i}") for i, p in enumerate(probes))).first()
        reached = sum(c >= need for c in counts)
        low, high = (probes[reached - 1] if reached else low), (probes[reached] - 1 if reached < len(probes) else high)
    return low


def drawn(rows: DataFrame, need: int, columns: tuple[str, ...]) -> Column:
    """The condition that holds for exactly the ``need`` rows highest in ``columns``, taken in turn."""
    chosen, tied = F.lit(False), F.lit(True)
    for column in columns:
        cut = threshold(rows, column, need)
        above, level = rows.agg(F.count_if(F.col(column) > cut), F.count_if(F.col(column) == cut)).first()
        chosen, tied = chosen | (tied & (F.col(column) > cut)), tied & (F.col(column) == cut)
        need -= above
        if need == level:
            break
        rows = stage(rows.where(F.col(column) == cut).select(*columns))
    return chosen | tied


def ranked(rows: DataFrame, n: int, order: tuple[str, ...]) -> DataFrame:
    """Add ``rank`` from 1 in descending ``order``: ranges are sorted alone and shifted by the rows before them."""
    down = [F.col(c).desc() for c in order]
    local = rows.repartitionByRange(max(1, -(-n // RANGE_ROWS)), *down).sortWithinPartitions(*down)
    # a number of this kind is the partition, then in 33 bits the row's position in it
    placed = stage(local.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per range
    before, offsets = 0, []
    for p, count in sizes:
        offsets.append((p, before))
        before += count
    shifts = rows.sparkSession.createDataFrame(offsets, "_p long, _before long")
    joined = placed.join(F.broadcast(shifts), part == F.col("_p"))
    return joined.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_p", "_before", "_at")


def resample(documents: DataFrame, target: DataFrame, percent: int, key: str = "doc_id", text: str = "text",
             target_text: str = "text", order: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20,
             keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns, the id among them), ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``
    (NULL: not drawn) of every document. ``percent`` of the documents of at least ``least_words`` words are drawn."""
    if keep is not None and key not in keep:
        raise ValueError(f"keep must hold the id {key}")
    features = stage(hashed(documents, text, order, buckets, keep))
    gain = gains(bucket_counts(features, buckets), bucket_counts(hashed(target, target_text, order, buckets, [target_text]), buckets))
    table = scored(features, gain, key, seed)
    eligible = table.where(F.col("n_words") >= least_words)
    need = eligible.count() * percent // 100
    by = ("score", "_back", "_place")
    shown = ["row", "n_words", "n_features", "weight", "score"]
    if not need:
        return table.select(*shown, F.lit(None).cast("long").alias("rank"))
    taken = (F.col("n_words") >= least_words) & drawn(eligible, need, by)
    rest = table.where(~taken).select(*shown, F.lit(None).cast("long").alias("rank"))
    return ranked(table.where(taken), need, by).select(*shown, "rank").unionByName(rest)
