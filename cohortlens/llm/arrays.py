"""Text columns as flat arrays: Arrow batches in, words as offsets and 64-bit hashes out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

SHARD_BYTES = 4 << 20
_SEED = np.random.default_rng(20240601)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BLOCK = 1 << 18


def _table(separators: bytes) -> np.ndarray:
    """Byte to lower-cased byte; separators become 0."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words of letters, digits and everything beyond ASCII.
ALNUM = _table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Words are what ASCII white space separates. Byte 0 belongs to words; 255 never occurs in UTF-8.
SPACED = _table(bytes([0x20, *range(9, 14)]))
SPACED_NUL = np.uint8(255)


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of a run of texts: ``data`` normalised bytes, ``starts``/``ends`` byte offsets of words,
    ``first`` index of each text's first word (one longer than the texts). NULL has no words."""

    def __init__(self, texts: pa.Array, table: np.ndarray):
        raw, bounds = text_bytes(texts)
        self.data = table[raw]
        if table is SPACED:
            self.data[raw == 0] = SPACED_NUL
        inside = self.data != 0
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[bounds[:-1][bounds[:-1] < len(raw)]] = False
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        for i in range(0, len(out), _BLOCK):
            s, e = self.starts[i:i + _BLOCK], self.ends[i:i + _BLOCK]
            lo = s[0]
            n = int(e[-1] - lo)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data[lo:lo + n]] * _powers(_BASE, n)[:n], out=total[1:])
            out[i:i + _BLOCK] = mix((total[e - lo] - total[s - lo]) * _powers(_INVERSE, n)[s - lo])
        return out


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16) + 1, base, np.uint64)
        have[0] = 1
        have = _POWERS[int(base)] = np.multiply.accumulate(have)
    return have


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts (one more for the end)."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    bounds = bounds.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def ranges(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """lo[i], lo[i] + 1, ... (``count[i]`` numbers) for each i, one after the other."""
    return np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text each, or of one longer text."""
    _, bounds = text_bytes(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column of consecutive runs of ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def map_texts(df: DataFrame, text: str, fields: StructType, make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
              keep: list[str] | None = None, limit: int = SHARD_BYTES) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns, all by default) and ``fields`` computed from ``text``.

    The input's columns stay inside ``row``, so that none can clash with a result. ``make`` is called
    once per task; what it returns gets runs of at most ``limit`` bytes of text.
    """
    keep = list(df.columns) if keep is None else keep
    carried = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text}`").alias("text"))
    inside = keep.index(text) if text in keep else None
    if inside is not None:
        carried = carried.select("row")
    schema = StructType([StructField("row", carried.schema["row"].dataType), *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = schema.names

    def run(batches):
        work = make()
        for batch in batches:
            rows = batch.column(0)
            texts = batch.column(1) if inside is None else rows.field(inside)
            for i, j in slices(texts, limit):
                found = work(texts.slice(i, j - i))
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(i, j - i), *(a if a.type == k else a.cast(k) for a, k in zip(found, kinds))], names)

    return carried.mapInArrow(run, schema)
