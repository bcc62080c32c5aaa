"""Benchmark decontamination by training suffix arrays.

Each task cuts its documents into shards, sorts every word suffix of a shard (prefix doubling on
packed word ranks) and binary-searches every benchmark suffix in it. Whole documents lie in one
shard, so verbatim matches and their places come out without a shuffle.

Defined results: a NULL or empty text has no words, no match and is not contaminated; repeated rows
and repeated or NULL ids are judged row by row; benchmark items without words match nothing; an
empty benchmark leaves every document clean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from cohortlens.llm.arrays import ALNUM, Words, lists, map_texts, ranges
from cohortlens.session import stage

WINDOW = 13
#: Contaminated when the hit words times this reach the words (5 %).
SHARE = 20
#: Text bytes of benchmark that tasks hold at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 16 << 20

FIELDS = (StructType()
          .add("n_words", LongType()).add("n_hit", LongType())
          .add("items", ArrayType(StringType()))
          .add("matches", ArrayType(StructType().add("item_id", StringType()).add("item_word", IntegerType())
                                    .add("word", IntegerType()).add("n_words", IntegerType())))
          .add("hits", ArrayType(StructType().add("start", IntegerType()).add("stop", IntegerType()))))


@dataclass
class Block:
    """Benchmark suffixes of some items: words, and the distinct windows with the items that hold them."""

    ids: list[str]
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    item: np.ndarray  # of each word
    first: np.ndarray
    left: np.ndarray  # words from here to the item's end
    window: np.ndarray  # start word of each distinct window
    length: np.ndarray
    holders: list[np.ndarray]  # items with that window


def make_block(ids: list, texts: list, window: int) -> Block:
    words = Words(pa.array(texts, pa.large_string()), ALNUM)
    count = np.diff(words.first)
    item = np.repeat(np.arange(len(ids)), count)
    left = words.first[1:][item] - np.arange(len(item))
    held: dict[bytes, list] = {}
    spelled = [bytes(words.data[s:e]) for s, e in zip(words.starts, words.ends)]
    for k, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
        for s in range(a, max(b - window + 1, min(a + 1, b))):
            entry = held.setdefault(b" ".join(spelled[s:min(s + window, b)]), [s, min(window, b - s), set()])
            entry[2].add(k)
    windows = list(held.values())
    return Block(["null" if x is None else str(x) for x in ids], words.data, words.starts, words.ends, words.hashes(), item, words.first, left,
                 np.array([w[0] for w in windows], np.int64), np.array([w[1] for w in windows], np.int64),
                 [np.array(sorted(w[2])) for w in windows])


def suffix_array(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by at least their first ``depth`` ranks (prefix doubling on what still ties)."""
    n = len(ranks)
    bits = int(ranks.max(initial=0)).bit_length() or 1
    span = 3 if 3 * bits <= 62 else 2 if 2 * bits <= 62 else 1
    padded = np.concatenate([ranks, np.zeros(span, np.int64)])
    key = padded[:n].copy()
    for i in range(1, span):
        key = (key << bits) | padded[i:i + n]
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    place = np.arange(n)
    at = place  # places in the order that may still tie
    value = key[order]
    while True:
        fresh = np.ones(len(at), bool)
        fresh[1:] = value[1:] != value[:-1]
        heads = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        rank[order[at]] = heads
        alone = fresh & np.append(fresh[1:], True)
        at = at[~alone]
        if span >= depth or not len(at):
            return order
        who = order[at]
        value = rank[who] * (n + 2) + rank[np.minimum(who + span, n)] + 1
        by = np.argsort(value, kind="stable")
        order[at], value = who[by], value[by]
        span *= 2


def _compare(train: np.ndarray, at: np.ndarray, test: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Sign of train suffix against test words (cut to ``length``) and the words they share."""
    sign, shared = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64)
    live = np.flatnonzero(length > 0)
    j = 0
    while len(live):
        a, b = train[np.minimum(at[live] + j, len(train) - 1)], test[start[live] + j]
        a = np.where(at[live] + j < len(train), a, 0)
        sign[live] = np.sign(a - b)
        j += 1
        live = live[a == b]
        shared[live] = j
        live = live[length[live] > j]
    return sign, shared


def _bound(order, train, test, start, length, upper: bool) -> np.ndarray:
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        sign, _ = _compare(train, order[mid], test, start[live], length[live])
        right = sign <= 0 if upper else sign < 0
        lo[live] = np.where(right, mid + 1, lo[live])
        hi[live] = np.where(right, hi[live], mid)
        live = live[lo[live] < hi[live]]
    return lo


def longest_matches(order: np.ndarray, train: np.ndarray, test: np.ndarray, start: np.ndarray, length: np.ndarray):
    """For every test suffix the words of its longest verbatim match, and a place of it."""
    if not len(order):
        return np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    at = _bound(order, train, test, start, length, upper=False)
    below, above = order[np.maximum(at - 1, 0)], order[np.minimum(at, len(order) - 1)]
    _, a = _compare(train, below, test, start, length)
    _, b = _compare(train, above, test, start, length)
    return np.maximum(a, b), np.where(a >= b, below, above)


def _same_bytes(a: Words, at: np.ndarray, b: Block, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the hashed matches are equal byte for byte."""
    left, right = ranges(at, length), ranges(start, length)
    owner = np.repeat(np.arange(len(at)), length)
    size, other = a.ends[left] - a.starts[left], b.ends[right] - b.starts[right]
    same = np.ones(len(at), bool)
    same[owner[size != other]] = False
    ok = size == other
    size, owner = size[ok], owner[ok]
    differ = a.data[ranges(a.starts[left[ok]], size)] != b.data[ranges(b.starts[right[ok]], size)]
    same[np.repeat(owner, size)[differ]] = False
    return same


def search_shard(texts: pa.Array, block: Block) -> list[pa.Array]:
    """FIELDS of each text: hit words, items, maximal verbatim matches and where they lie."""
    words = Words(texts, ALNUM)
    n_docs, count = len(texts), np.diff(words.first)
    doc_at = np.zeros(0, np.int64)
    window = np.zeros(0, np.int64)
    if len(words.starts) and len(block.window):
        vocabulary, ranks = np.unique(words.hashes(), return_inverse=True)
        # one end mark (rank 0) behind each text
        train = np.zeros(len(ranks) + n_docs, np.int64)
        word_of = np.arange(len(ranks)) + np.repeat(np.arange(n_docs), count)
        train[word_of] = ranks + 1
        back = np.cumsum(train > 0) - 1
        near = np.minimum(np.searchsorted(vocabulary, block.hashes), len(vocabulary) - 1)
        test = np.where(vocabulary[near] == block.hashes, near + 1, -1)
        order = suffix_array(train, int(block.left.max()))
        found, _ = longest_matches(order, train, test, np.arange(len(test)), block.left)
        hit = np.flatnonzero(found[block.window] >= block.length)
        lo = _bound(order, train, test, block.window[hit], block.length[hit], upper=False)
        hi = _bound(order, train, test, block.window[hit], block.length[hit], upper=True)
        doc_at = back[order[ranges(lo, hi - lo)]]
        window = np.repeat(hit, hi - lo)
        same = _same_bytes(words, doc_at, block, block.window[window], block.length[window])
        doc_at, window = doc_at[same], window[same]
    by = np.lexsort((block.length[window], doc_at)) if len(doc_at) else np.zeros(0, np.int64)
    doc_at, window = doc_at[by], window[by]
    doc = np.searchsorted(words.first, doc_at, "right") - 1
    start, stop = doc_at - words.first[doc], doc_at - words.first[doc] + block.length[window]

    def runs(joined: np.ndarray, stops: np.ndarray):
        """First rows of runs, and the largest stop of each."""
        heads = np.flatnonzero(~joined)
        return heads, np.maximum.reduceat(stops, heads) if len(heads) else stops[:0]

    reach = _running_max(stop, doc)
    joined = np.zeros(len(doc), bool)
    joined[1:] = (doc[1:] == doc[:-1]) & (start[1:] <= reach[:-1])
    heads, ends = runs(joined, stop)
    hits = np.bincount(doc[heads], weights=ends - start[heads], minlength=n_docs).astype(np.int64)
    spans = lists(pa.StructArray.from_arrays([pa.array(start[heads], pa.int32()), pa.array(ends, pa.int32())], ["start", "stop"]),
                  np.bincount(doc[heads], minlength=n_docs))
    # windows that move on together in text and item are one longer verbatim match
    word = block.window[window]
    by = np.lexsort((start, start - word, doc)) if len(doc) else np.zeros(0, np.int64)
    d, s, e, w = doc[by], start[by], stop[by], word[by]
    joined = np.zeros(len(by), bool)
    joined[1:] = (d[1:] == d[:-1]) & (s[1:] == s[:-1] + 1) & (w[1:] == w[:-1] + 1) & (block.item[w[1:]] == block.item[w[:-1]])
    heads, ends = runs(joined, e)
    d, s, w = d[heads], s[heads], w[heads]
    item = block.item[w]
    matches = lists(pa.StructArray.from_arrays([
        pa.array([block.ids[k] for k in item.tolist()], pa.string()), pa.array(w - block.first[item], pa.int32()),
        pa.array(s, pa.int32()), pa.array(ends - s, pa.int32())], ["item_id", "item_word", "word", "n_words"]),
        np.bincount(d, minlength=n_docs))
    pairs = np.unique(np.concatenate([doc[:, None], window[:, None]], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
    held: list[set] = [set() for _ in range(n_docs)]
    for d, w in pairs.tolist():
        held[d].update(block.holders[w].tolist())
    items = pa.array([sorted({block.ids[k] for k in h}) for h in held], pa.list_(pa.string()))
    return [pa.array(count, pa.int64()), pa.array(hits), items, matches, spans]


def _running_max(value: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Largest value so far within each (sorted) group."""
    top = int(value.max(initial=0)) + 1
    return np.maximum.accumulate(value + group * top) - group * top


def blocks(benchmark: DataFrame, item: str, text: str, window: int, limit: int):
    """The benchmark in pieces of at most ``limit`` bytes, read one partition at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        if ids and size + len(r[1].encode()) > limit:
            yield make_block(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1].encode())
    yield make_block(ids, texts, window)


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  benchmark_text: str = "text", window: int = WINDOW, share: int = SHARE,
                  keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (the ``keep`` columns), ``n_words``, ``n_hit``, ``items``, ``matches``, ``contaminated``.

    A word is hit inside any occurrence of ``window`` consecutive benchmark words (of a whole shorter
    item); ``matches`` are the maximal verbatim matches with their places. Tasks hold one benchmark
    block of a bounded size; more blocks are searched in turn and their hits united.
    """
    spark = documents.sparkSession
    carry = list(documents.columns) if keep is None else list(keep)
    held = [spark.sparkContext.broadcast(b) for b in blocks(benchmark, item, benchmark_text, window, block_bytes)]

    def searcher(shared):
        return lambda: lambda texts: search_shard(texts, shared.value)

    if len(held) == 1:
        found = map_texts(documents, text, FIELDS, searcher(held[0]), keep=carry)
    else:
        found = map_texts(documents, text, FIELDS, searcher(held[0]), keep=list(dict.fromkeys([*carry, text])))
        for shared in held[1:]:
            before = stage(found.select("row", F.struct(*FIELDS.names).alias("found"), F.col(f"row.`{text}`").alias("text")))
            found = _unite(map_texts(before, "text", FIELDS, searcher(shared), keep=["row", "found"]))
        found = found.withColumn("row", F.struct(*(F.col(f"row.`{c}`") for c in carry)))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _unite(both: DataFrame) -> DataFrame:
    """The findings of one more block joined to the earlier ones of the same row."""
    hits = F.array_sort(F.concat("row.found.hits", "hits"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    total = F.aggregate(hits, none, lambda a, s: F.struct(
        (a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["reach"]), F.lit(0))).alias("n"),
        F.greatest(a["reach"], s["stop"]).alias("reach")), lambda a: a["n"])
    return both.select(
        F.col("row.row").alias("row"), "n_words", total.alias("n_hit"),
        F.array_union("row.found.items", "items").alias("items"),
        F.concat("row.found.matches", "matches").alias("matches"), hits.alias("hits"))
