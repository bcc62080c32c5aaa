"""Removal of repeated byte strings by sorted suffixes.

Every string of ``LENGTH`` bytes has one anchor: the position of the smallest hash among its grams, which
depends on the string alone. Two equal strings thus share anchor and offset, and only suffixes that begin
at anchors need sorting, about one byte position in seventy.

1. Anchors whose gram occurs at no other place are dropped (blocks of hashes, exchanged once).
2. The suffixes at the others, with as much text before them as their strings need, are range-partitioned
   by their leading bytes at sampled splitters. Equal leads never part, so no boundary cuts a group.
3. Each bucket sorts its suffixes and the reversed texts before them by multikey quicksort, eight bytes
   at a time; runs of shared prefixes in both orders give the strings that occur twice, byte by byte.

A lead with very many suffixes (a passage in a large share of all rows) is not sorted in one bucket: its
strings are counted one by one with map-side aggregation, which gives the same answer.

Defined results: NULL is the empty text; copies of a whole text of at least LENGTH bytes lose every byte;
shorter texts lose none; repeated rows are copies; texts of any length are read in segments; an empty
table gives an empty result; input columns stay in ``row``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, LongType, StringType, StructField, StructType,
)

from cohortlens.llm.arrays import _BASE, _BYTE, _INVERSE, _powers, lists, mix, ranges, text_bytes
from cohortlens.session import stage

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM + 1  # grams in a string
SEGMENT = 1 << 20
LEAD = 24
#: Suffixes with one lead beyond which their strings are counted instead of sorted together.
HOT_SUFFIXES = 1 << 16
#: Suffixes that one bucket sorts, and bytes of hash blocks that one task compares, on average.
BUCKET_SUFFIXES = 1 << 17
BLOCK_BYTES = 64 << 20

_SPANS = ArrayType(StructType().add("start", LongType()).add("stop", LongType()))


# ---- anchors ------------------------------------------------------------------------------------------

def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def _anchors(raw: np.ndarray, bounds: np.ndarray):
    """For a run of texts: text, anchor, first and last string start (offsets in the text) and gram hash."""
    n = len(raw)
    size = np.diff(bounds)
    if n < LENGTH or size.max() < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_BASE, n)[:n], out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * _powers(_INVERSE, n)[:n - GRAM + 1])
    low = np.uint64(24)
    least = _sliding_min((grams >> low << low) | np.arange(len(grams), dtype=np.uint64), REACH)
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = ranges(bounds[:-1], np.maximum(size - LENGTH + 1, 0))
    anchor = anchor[start]
    head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    tail = np.append(head[1:], len(start)) - 1
    p, first, last = anchor[head], start[head], start[tail]
    text = np.searchsorted(bounds, p, "right") - 1
    base = bounds[text]
    return text, p - base, first - base, last - base, grams[p]


def anchors(raw: np.ndarray, bounds: np.ndarray):
    """The same, a segment of bytes at a time: texts in runs, long texts in overlapping stretches."""
    parts = []
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SEGMENT, "right")) - 1)
        lo, hi = bounds[i], bounds[j]
        if hi - lo <= SEGMENT:
            found = _anchors(raw[lo:hi], bounds[i:j + 1] - lo)
            parts.append((found[0] + i, *found[1:]))
        else:
            for s in range(int(lo), int(hi) - LENGTH + 1, SEGMENT):
                e = min(int(hi), s + SEGMENT + LENGTH - 1)
                found = _anchors(raw[s:e], np.array([0, e - s]))
                parts.append((found[0] + i, *(x + (s - lo) for x in found[1:4]), found[4]))
        i = j
    if not parts:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _pack(p, first, last):
    return p << 16 | (p - first) << 8 | (p - last)


_BLOCKS = "bucket int, keys binary, who binary, places binary, texts binary"


def _blocks(rows: DataFrame, buckets: int) -> DataFrame:
    """Anchors as blocks of hashes by bucket. A gram that a batch holds twice is known to be repeated:
    its places go on without hashes, and only one of them is sent to tell the other batches."""
    names = [x.split()[0] for x in _BLOCKS.split(", ")]

    def block(bucket: int, keys, who, places, ids):
        used, who = np.unique(who, return_inverse=True)
        return (bucket, None if keys is None else keys.tobytes(), who.astype(np.int32).tobytes(), places.tobytes(),
                ids[used].tobytes())

    def run(batches):
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), "V16")
            _, own = np.unique(ids, return_index=True)  # copies hold the same strings at the same places
            own = np.sort(own)
            raw, bounds = text_bytes(batch.column(1).take(pa.array(own)))
            who, p, first, last, key = anchors(raw, bounds)
            who, places = own[who], _pack(p, first, last)
            by = np.argsort(key)
            key, who, places = key[by], who[by], places[by]
            head = np.append(True, key[1:] != key[:-1])[:len(key)]
            begin = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
            other = (who != who[begin]) | (places >> 16 != places[begin] >> 16)
            twice = np.zeros(len(key), bool)
            twice[begin[other]] = True
            twice = twice[begin]
            out = []
            known = np.flatnonzero(twice)
            if len(known):
                for part in np.array_split(known, min(16, len(known))):
                    out.append(block(int(key[part[0]] % np.uint64(buckets)), None, who[part], places[part], ids))
            send = np.flatnonzero(~twice | head)
            bucket = (key[send] % np.uint64(buckets)).astype(np.int64)
            send = send[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)])
            for a, b in zip(cuts, np.append(cuts[1:], len(bucket))):
                part = send[a:b]
                out.append(block(int(bucket[a]), key[part], who[part], places[part], ids))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), [pa.int32()] + [pa.binary()] * 4)], names)

    return rows.mapInArrow(run, _BLOCKS)


def _repeated(blocks: DataFrame) -> DataFrame:
    """``id`` of a text and the places of its anchors whose gram occurs at another place too."""
    def rows(ids, places):
        order = np.argsort(ids, kind="stable")
        ids, places = ids[order], places[order]
        cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[:len(ids)])
        counts = np.diff(np.append(cuts, len(ids)))
        return pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes() for x in ids[cuts]], pa.binary()), lists(pa.array(places), counts)], ["id", "places"])

    def run(batches):
        keys, ids, places = [], [], []
        for batch in batches:
            for _, key, who, place, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                text = np.frombuffer(text, "V16")[np.frombuffer(who, np.int32)]
                place = np.frombuffer(place, np.int64)
                if key is None:
                    yield rows(text, place)
                else:
                    keys.append(np.frombuffer(key, np.uint64))
                    ids.append(text)
                    places.append(place)
        if keys:
            key = np.concatenate(keys)
            keys.clear()
            by = np.argsort(key)
            key = key[by]
            head = np.append(True, key[1:] != key[:-1])
            often = np.append(~head[1:], False) | ~head
            by, head = by[often], head[often]
            text, place = np.concatenate(ids)[by], np.concatenate(places)[by]
            begin = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
            other = (text != text[begin]) | (place >> 16 != place[begin] >> 16)
            twice = np.zeros(len(by), bool)
            twice[begin[other]] = True
            keep = twice[begin] if len(by) else twice
            if keep.any():
                yield rows(text[keep], place[keep])

    return blocks.repartition("bucket").mapInArrow(run, "id binary, places array<long>")


# ---- suffixes -----------------------------------------------------------------------------------------

_SUFFIXES = "id binary, place long, left int, low int, lead binary, context binary"


def _suffixes(texts: DataFrame) -> DataFrame:
    """One row per repeated anchor: its suffix with the text before it. Equal rows of a batch settle each
    other: one goes on, for the others ``place`` and ``left`` give the covered stretch, without context."""
    names = [x.split()[0] for x in _SUFFIXES.split(", ")]

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k, (data, places) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                data = data.encode()
                ids[k] = (ids[k], data, places)
            seen: dict[tuple[bytes, int], list] = {}
            out = []
            for one, data, places in ids:
                for place in places:
                    p, left, low = place >> 16, place >> 8 & 255, place & 255
                    context = data[p - left:p - low + LENGTH]
                    entry = seen.setdefault((context, left), [0, one, p, low])
                    entry[0] += 1
                    if entry[0] > 1:
                        out.append((one, p - left, len(context), 0, one[:8], None))
            for (context, left), (count, one, p, low) in seen.items():
                if count > 1:
                    out.append((one, p - left, len(context), 0, one[:8], None))
                out.append((one, p, left, low, context[left:left + LEAD], context))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    zip(*out), [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])], names)

    return texts.mapInArrow(run, _SUFFIXES)


def _words(data: np.ndarray, start: np.ndarray, size: np.ndarray, count: int, back: bool) -> np.ndarray:
    """Eight bytes at a time as big-endian numbers, from ``start`` on (or backwards), 0 beyond ``size``."""
    out = np.empty((len(start), count), np.uint64)
    step = np.arange(8 * count)
    for i in range(0, len(start), 1 << 13):
        s, n = start[i:i + (1 << 13), None], size[i:i + (1 << 13), None]
        at = s - 1 - step if back else s + step
        out[i:i + (1 << 13)] = np.where(step < n, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8).view(">u8")
    return out


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Rows in lexicographic order: sort by one word, then each run of equals by the next."""
    order = np.argsort(words[:, 0], kind="stable")
    at = np.arange(len(order))  # places whose rows still tie
    group = np.zeros(len(order), np.int64)
    for j in range(words.shape[1]):
        value = words[order[at], j]
        if j:
            by = np.lexsort((value, group))
            order[at] = order[at][by]
            value = value[by]
        fresh = np.append(True, (value[1:] != value[:-1]) | (group[1:] != group[:-1]))
        alone = fresh & np.append(fresh[1:], True)
        at, group = at[~alone], np.cumsum(fresh)[~alone]
        if not len(at):
            break
    return order


def shared_prefix(words: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in the order shares with the one before it (the first: -1)."""
    out = np.full(len(order), -1, np.int64)
    for i in range(1, len(order), 1 << 15):
        a, b = order[i - 1:i - 1 + (1 << 15)], order[i:i + (1 << 15)]
        a = a[:len(b)]
        differ = words[a] ^ words[b]
        first = np.argmax(differ != 0, axis=1)
        word = differ[np.arange(len(b)), first]
        width = np.zeros(len(b), np.int64)  # bytes from the top until the highest set bit
        for shift in range(56, -1, -8):
            width += (word >> np.uint64(shift)) == 0
        same = np.where(word == 0, 8 * words.shape[1], 8 * first + width)
        out[i:i + len(b)] = np.minimum(same, np.minimum(size[a], size[b]))
    return out


def sort_bucket(data: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray, low: np.ndarray):
    """For each suffix the largest and the smallest offset of its anchor in a string that occurs in another
    suffix of the bucket; -1 and -1 if there is none."""
    n = len(begin)
    right = np.minimum(size - left, LENGTH)
    after = _words(data, begin + left, right, LENGTH // 8, back=False)
    order = multikey_order(after)
    shared = shared_prefix(after, right, order)
    del after
    before = _words(data, begin + left, left, -(-(REACH - 1) // 8), back=True)
    back_order = multikey_order(before)
    back_shared = shared_prefix(before, left, back_order)
    del before
    most, least = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    forward, backward = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(REACH):
        mine = np.flatnonzero((low <= offset) & (offset <= left))
        if len(mine) < 2:
            continue
        forward[order] = np.cumsum(shared < LENGTH - offset)
        backward[back_order] = np.cumsum(back_shared < offset)
        both = forward[mine] * (n + 1) + backward[mine]
        by = np.argsort(both)
        same = both[by][1:] == both[by][:-1]
        twice = mine[by[np.append(same, False) | np.append(False, same)]]
        most[twice] = offset
        least[twice[least[twice] < 0]] = offset
    return most, least


def _covered(suffixes: DataFrame) -> DataFrame:
    """``id``, ``start``, ``stop``: bytes covered by strings that occur elsewhere, from sorted buckets."""
    names = ["id", "start", "stop"]

    def run(batches):
        held = []
        for batch in batches:
            context = batch.column(5)
            settled = np.asarray(context.is_null())
            if settled.any():
                rows = batch.filter(pa.array(settled))
                start = rows.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(start), pa.array(start + rows.column(2).to_numpy())], names)
            rows = batch.filter(pa.array(~settled))
            if rows.num_rows:
                held.append(rows)
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            data, bounds = text_bytes(rows.column(5).combine_chunks().cast(pa.large_binary()))
            left, low = (rows.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            most, least = sort_bucket(data, bounds[:-1], np.diff(bounds), left, low)
            hit = np.flatnonzero(most >= 0)
            place = rows.column(1).to_numpy()[hit]
            yield from pa.Table.from_arrays(
                [rows.column(0).take(pa.array(hit)), pa.array(place - most[hit]), pa.array(place - least[hit] + LENGTH)],
                names).to_batches(max_chunksize=1 << 16)

    return suffixes.mapInArrow(run, "id binary, start long, stop long")


def _counted(suffixes: DataFrame) -> DataFrame:
    """The same for suffixes with hot leads: every string is a row, counted with map-side aggregation."""
    own = suffixes.select("id", (F.col("place") - F.col("left")).alias("first"), "context",
                          F.explode(F.sequence(F.lit(0), F.col("left") - F.col("low"))).alias("i"))
    strings = own.select("id", (F.col("first") + F.col("i")).alias("start"),
                         F.unhex(F.sha2(F.substring("context", F.col("i") + 1, F.lit(LENGTH)), 256)).alias("string"))
    often = strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    return strings.join(often, "string").select("id", "start", (F.col("start") + LENGTH).alias("stop"))


def covered(texts: DataFrame, hot: int = HOT_SUFFIXES, bucket: int = BUCKET_SUFFIXES) -> DataFrame:
    """Covered stretches of texts (``id``, ``text``, ``places``)."""
    spark = texts.sparkSession
    rows = stage(_suffixes(texts))
    leads = rows.where("context IS NOT NULL").groupBy("lead").agg(F.count("*").alias("n"))
    summary = leads.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((summary["n"] or 0) / bucket))
    found = []
    cold = rows
    if (summary["most"] or 0) > hot:
        often = stage(leads.where(F.col("n") > hot).select("lead"))  # at most rows / hot leads
        found.append(_counted(rows.where("context IS NOT NULL").join(often, "lead", "left_semi")))
        cold = rows.join(often, (rows["lead"] == often["lead"]) & rows["context"].isNotNull(), "left_anti")
    found.append(_covered(cold.repartitionByRange(parts, "lead")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


# ---- the operator -------------------------------------------------------------------------------------

_RESULT = StructType([StructField("id", BinaryType()), StructField("n_removed", LongType()), StructField("spans", _SPANS),
                      StructField("kept_sha256", StringType()), StructField("kept", BinaryType())])


def _cut(rows: DataFrame, with_bytes: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            removed, spans, digests, kept = [], [], [], []
            for text, starts, stops in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                data, merged = text.encode(), []
                for a, b in sorted(zip(starts, stops)):
                    if merged and a <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(merged[-1]["stop"], b)
                    else:
                        merged.append({"start": a, "stop": b})
                rest, at = [], 0
                for s in merged:
                    rest.append(data[at:s["start"]])
                    at = s["stop"]
                rest = b"".join(rest) + data[at:]
                removed.append(len(data) - len(rest))
                spans.append(merged)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_bytes else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                 pa.array(digests, pa.string()), pa.array(kept, pa.binary())], _RESULT.names)

    return rows.mapInArrow(run, _RESULT)


def remove_repeats(documents: DataFrame, text: str = "text", keep: list[str] | None = None, with_bytes: bool = False,
                   hot: int = HOT_SUFFIXES, bucket: int = BUCKET_SUFFIXES) -> DataFrame:
    """``row`` (the ``keep`` columns), ``n_bytes``, ``n_removed``, ``spans`` (removed byte stretches),
    ``kept_sha256`` and, with ``with_bytes``, ``kept`` (what remains; it may cut characters)."""
    spark = documents.sparkSession
    keep = list(documents.columns) if keep is None else keep
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = documents.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), value.alias("text"),
                             F.unhex(F.md5(value)).alias("id"), F.octet_length(value).cast("long").alias("n_bytes"))
    rows = stage(keyed.select("row", "id", "n_bytes", F.sha2("text", 256).alias("sha")))
    size = rows.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size * 2 / REACH * 20 / BLOCK_BYTES))
    long = keyed.where(F.col("n_bytes") >= LENGTH)
    places = (_repeated(_blocks(long.select("id", "text"), buckets)).groupBy("id")
              .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")))
    distinct = long.groupBy("id").agg(F.first("text").alias("text"))
    texts = stage(distinct.join(places, "id").select("id", "text", "places"))
    stretches = (covered(texts, hot, bucket).groupBy("id")
                 .agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")))
    cut = _cut(texts.join(stretches, "id").select("id", "text", "starts", "stops"), with_bytes)
    copies = rows.where(F.col("n_bytes") >= LENGTH).groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1")
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    found = rows.join(copies, "id", "left").join(cut, "id", "left")
    copied = F.col("copies").isNotNull()
    none = F.array().cast(_SPANS)
    out = [
        "row", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, every).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if with_bytes:
        whole = keyed.groupBy("id").agg(F.first("text").alias("whole"))
        found = found.join(whole, "id")
        out.append(F.when(copied, F.lit(b"")).otherwise(F.coalesce("kept", F.col("whole").cast("binary"))).alias("kept"))
    return found.select(*out)
