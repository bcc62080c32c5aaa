"""N-gram Jaccard join by prefix trees.

A document's set holds the 64-bit hashes of its distinct word n-grams. Equal sets are one. Two sets link
when their Jaccard similarity reaches ``NUMERATOR / DENOMINATOR`` (exact, in whole numbers).

1. Candidates: linked sets differ in a bounded number of n-grams. Cut into more parts (ranges of hashes)
   than that, they agree in at least one part; sets that agree in a part meet by its hash. All that meet by one
   hash are compared by sketches, parities of about a bit per n-gram: those of linked sets differ in no more bits
   than the sets in n-grams. Sets whose sketches allow a link, directly or over others, form a class; nothing
   outside a class can link with it. Without the sketches chance meetings would join ever more sets into one class
   as a table grows.
2. The sets of classes beyond one task's size order their n-grams by how many n-grams fall into the same
   range of hashes, rarest first: one order for all, from counters of a fixed size. Linked sets share one of
   their first few in this order, so these classes are split by them: a passage that many otherwise different
   documents share falls out.
3. Each class stores its sets in a trie, rarest n-grams of the class first. A set descends from the nodes
   where its own rare n-grams occur, adds up shared n-grams along common paths, and leaves a subtree when
   the lengths that remain cannot reach the bound any more, or when all sets below already belong to its
   component. A class beyond one task's size is dealt in blocks, each pair of blocks to one task.
4. Components of the links found are joined over all classes.

Defined results: NULL, empty and blank texts have an empty set, link with nothing and keep their own id as
component; texts of fewer words than ``n`` have one n-gram of all their words; repeated rows and copies
share a component; the component id is its smallest non-NULL document id; texts of any length count whole;
an empty table gives an empty result; input columns stay in ``row``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from cohortlens.llm.arrays import SHARD_BYTES, SPACED, Words, lists, map_texts, mix, ranges, slices
from cohortlens.llm.bits import narrowed, without
from cohortlens.llm.components import components
from cohortlens.session import stage, unstage

N = 4
NUMERATOR, DENOMINATOR = 85, 100
#: Sets and n-grams of a class that one task takes on.
BLOCK_SETS = 1 << 13
BLOCK_GRAMS = 1 << 23
_FACTORS = np.random.default_rng(4).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


# ---- sets ---------------------------------------------------------------------------------------------

def gram_sets(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text one after the other, and where each text's begin."""
    words = Words(texts, SPACED)
    h, first, count = words.hashes(), words.first[:-1], np.diff(words.first)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at, short = ranges(first, size), np.repeat(np.minimum(count, n), size)
    value = short.astype(np.uint64) * _FACTORS[n]
    for j in range(n):
        inside = j < short
        value += np.where(inside, h[np.minimum(at + j, len(h) - 1)] * _FACTORS[j], np.uint64(0)) if len(h) else 0
    value = mix(value)
    bounds = np.concatenate([[0], np.cumsum(size)])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        value[a:b].sort()
    fresh = np.ones(len(value), bool)
    fresh[1:] = value[1:] != value[:-1]
    fresh[bounds[:-1][size > 0]] = True
    return value[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def set_ids(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit identity of each set."""
    out = np.empty((len(bounds) - 1, 2), np.uint64)
    out[:, 0] = mix(_sums(mix(grams ^ _SALT[0]), bounds))
    out[:, 1] = mix(_sums(mix(grams ^ _SALT[1]), bounds))
    return out.view("V16").reshape(-1)


def _keys(ids: np.ndarray) -> np.ndarray:
    """Half of each identity. Candidates go by it: should two sets share it, their classes are one."""
    return ids.view(np.int64)[::2]


#: Least bits of a sketch.
SKETCH_BITS = 128


def sketches(grams: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set, of each place of its sketch (low bits of a hash) whether an odd number of n-grams falls there. A sketch
    has a power of two of places, at least one for each n-gram; folded in two it is the set's sketch of half the places."""
    size = np.diff(bounds)
    bits = np.maximum(SKETCH_BITS, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(bits)])
    own = np.repeat(np.arange(len(size)), size)
    at = (grams & np.uint64(2**32 - 1)).astype(np.int64) & (bits[own] - 1)
    odd = np.packbits((np.bincount(at + begin[own], minlength=begin[-1]) & 1).astype(bool), bitorder="little").tobytes()
    return [odd[a // 8:b // 8] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


def _identify(texts: pa.Array) -> list[pa.Array]:
    grams, bounds = gram_sets(texts)
    size = np.diff(bounds)
    ids = set_ids(grams, bounds)
    full = size.tolist()
    return [pa.array(size, pa.int64()), pa.array([x.tobytes() if n else None for x, n in zip(ids, full)], pa.binary()),
            pa.array(_keys(ids), pa.int64()),
            pa.array([x if n else None for x, n in zip(sketches(grams, bounds), full)], pa.binary())]


# ---- candidates ---------------------------------------------------------------------------------------

def _classes(top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size classes up to ``top``: where they begin, into how many parts their sets are cut, and how many
    parts may be empty. Class of a pair: that of its smaller set."""
    begin = [1]
    while begin[-1] <= top:
        begin.append(max(begin[-1] + 1, begin[-1] * 3 // 2))
    largest = np.array(begin[1:]) - 1
    partner = largest * DENOMINATOR // NUMERATOR
    differ = (largest + partner) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
    spare = 2 + differ // 16
    return np.array(begin[:-1]), differ + 1 + spare, spare


def signatures(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set and hash of each part that another set must agree with in one place to be linked."""
    size = np.diff(bounds)
    begin, parts, spare = _classes(int(size.max(initial=1)))
    own = np.searchsorted(begin, size, "right") - 1
    lowest = np.searchsorted(begin, -(-size * NUMERATOR // DENOMINATOR), "right") - 1
    hashed = mix(grams ^ _SALT[2])
    who, out = [], []
    for down in range(4):
        chosen = np.flatnonzero((size > 0) & (own - down >= lowest) & (own - down >= 0))
        if not len(chosen):
            break
        kind = own[chosen] - down
        at = ranges(bounds[chosen], size[chosen])
        owner = np.repeat(np.arange(len(chosen)), size[chosen])
        part = ((grams[at] >> np.uint64(32)) * parts[kind][owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        head = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])))
        label = (kind[owner[head]].astype(np.uint64) << np.uint64(40)) + part[head].astype(np.uint64)
        total = _sums(hashed[at], np.append(head, len(at)))
        who.append(chosen[owner[head]])
        out.append(mix(total + mix(label ^ _SALT[3])))
        empty = parts[kind] - np.bincount(owner[head], minlength=len(chosen))
        for k in np.flatnonzero(empty > spare[kind]).tolist():  # these may agree in empty parts only
            lacks = np.setdiff1d(np.arange(parts[kind[k]]), part[head[owner[head] == k]])
            label = (np.uint64(kind[k]) << np.uint64(40)) + lacks.astype(np.uint64)
            who.append(np.full(len(lacks), chosen[k]))
            out.append(mix(label ^ _SALT[0]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(who), np.concatenate(out)


_INDEX = (np.uint16, np.int32)
_BLOCKS = "bucket int, keys binary, who binary, ids binary"


def _stars(keys: np.ndarray, who: np.ndarray, ids: np.ndarray):
    """Sets that share a key with another, each with the first holder; and the first rows of the keys."""
    by = np.lexsort((who, keys))
    keys, who = keys[by], who[by]
    head = np.append(True, keys[1:] != keys[:-1])[:len(keys)]
    lead = who[np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))] if len(keys) else who
    apart = np.flatnonzero(ids[who] != ids[lead]) if len(keys) else []
    pairs = np.unique(who[apart] * len(ids) + lead[apart]) if len(apart) else np.zeros(0, np.int64)
    return keys, who, head, np.stack([pairs // max(len(ids), 1), pairs % max(len(ids), 1)], 1)


def _text_parts(batch: pa.RecordBatch):
    """Keys of a batch's sets (column ``text``), and set and hash of each part."""
    ids, who, keys, n = [], [], [], 0
    for i, j in slices(batch.column(0), SHARD_BYTES):
        grams, bounds = gram_sets(batch.column(0).slice(i, j - i))
        a, b = signatures(grams, bounds)
        ids.append(_keys(set_ids(grams, bounds)))
        who.append(a + n)
        keys.append(b)
        n += j - i
    return np.concatenate(ids), np.concatenate(who), np.concatenate(keys)


def _blocks(rows: DataFrame, signed, buckets: int, whole: bool = False) -> DataFrame:
    """Hashes that ``signed`` finds in each batch, in blocks by bucket (``ids``: keys of the sets). Unless ``whole``, sets of one
    batch that share a hash are paired with the first of them at once (a row without keys), which alone is sent on."""
    names = [x.split()[0] for x in _BLOCKS.split(", ")]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, who, keys = signed(batch)
            _, own = np.unique(ids, return_index=True)
            first = np.zeros(len(ids), bool)
            first[own] = True
            who, keys = who[first[who]], keys[first[who]]
            out = []
            if not whole:
                keys, who, head, pairs = _stars(keys, who, ids)
                if len(pairs):
                    out.append((int(pairs[0, 0]) % buckets, None, None, ids[pairs.reshape(-1)].tobytes()))
                keys, who = keys[head], who[head]
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1])[:len(by)])
            for a, b in zip(cuts, np.append(cuts[1:], len(by))):
                part = by[a:b]
                used, mine = np.unique(who[part], return_inverse=True)
                out.append((int(bucket[by[a]]), keys[part].tobytes(), mine.astype(_INDEX[len(used) > 65535]).tobytes(), ids[used].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), [pa.int32()] + [pa.binary()] * 3)], names)

    return rows.mapInArrow(run, _BLOCKS)


def _pairs(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["a", "b"])


def _meetings(blocks: DataFrame, buckets: int) -> DataFrame:
    """Pairs ``a``, ``b`` of sets that meet: each with one holder of a common hash."""
    def run(batches):
        keys, who, ids, n = [], [], [], 0
        for batch in batches:
            for _, key, mine, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = np.frombuffer(own, np.int64)
                if key is None:
                    yield _pairs(own.reshape(-1, 2))
                    continue
                keys.append(np.frombuffer(key, np.uint64))
                who.append(np.frombuffer(mine, _INDEX[len(own) > 65535]).astype(np.int64) + n)
                ids.append(own)
                n += len(own)
        if keys:
            ids = np.concatenate(ids)
            # one number per set, as copies come from several batches
            ids, same = np.unique(ids, return_inverse=True)
            _, _, _, pairs = _stars(np.concatenate(keys), same[np.concatenate(who)], ids)
            for i in range(0, len(pairs), 1 << 16):
                yield _pairs(ids[pairs[i:i + (1 << 16)]])

    return blocks.repartition(buckets, "bucket").mapInArrow(run, "a long, b long").distinct()


def _groups(blocks: DataFrame, buckets: int) -> DataFrame:
    """``members`` (keys of sets) that have a hash in common, equal groups once, with their identity ``group``."""
    def run(batches):
        keys, who, ids, n = [], [], [], 0
        for batch in batches:
            for _, key, mine, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = np.frombuffer(own, np.int64)
                keys.append(np.frombuffer(key, np.uint64))
                who.append(np.frombuffer(mine, _INDEX[len(own) > 65535]).astype(np.int64) + n)
                ids.append(own)
                n += len(own)
        if not keys:
            return
        ids, same = np.unique(np.concatenate(ids), return_inverse=True)
        keys, who = np.concatenate(keys), same[np.concatenate(who)]
        by = np.lexsort((who, keys))
        keys, who = keys[by], who[by]
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (who[1:] != who[:-1]))
        keys, who = keys[fresh], who[fresh]
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(begin, len(keys)))
        begin, size = begin[size > 1], size[size > 1]
        if not len(begin):
            return
        members, bounds = ids[who[ranges(begin, size)]], np.concatenate([[0], np.cumsum(size)])
        names, some = np.unique(set_ids(members.view(np.uint64), bounds), return_index=True)
        for i in range(0, len(some), 1 << 12):
            part = some[i:i + (1 << 12)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in names[i:i + (1 << 12)]], pa.binary()),
                 lists(pa.array(members[ranges(bounds[part], size[part])]), size[part].tolist())], ["group", "members"])

    return (blocks.repartition(buckets, "bucket").mapInArrow(run, "group binary, members array<long>")
            .groupBy("group").agg(F.first("members").alias("members")))


def alike(sizes: np.ndarray, drawn: list[bytes | None]) -> list[tuple[int, int]]:
    """For sets whose sketches allow links over others of them, each with one set of all that hang together. A set without
    a sketch may link with all."""
    n, out = len(sizes), []
    places = np.array([8 * len(x) if x is not None else 0 for x in drawn])
    words: dict[int, np.ndarray] = {}  # by number of places, a row for each set; sets with fewer places have none
    for b in np.unique(places[places > 0]).tolist():
        words[b] = np.zeros((n, b // 64), np.uint64)
    for k, x in enumerate(drawn):
        if x is None:
            continue
        row, b = np.frombuffer(x, np.uint64), int(places[k])
        while True:
            if b in words:
                words[b][k] = row
            if b == SKETCH_BITS:
                break
            row, b = row[:len(row) // 2] ^ row[len(row) // 2:], b // 2
    left = np.arange(n)
    while len(left):
        root, queue, left = int(left[0]), [int(left[0])], left[1:]
        while queue and len(left):
            k = queue.pop()
            able = np.maximum(sizes[left], sizes[k]) * NUMERATOR <= np.minimum(sizes[left], sizes[k]) * DENOMINATOR
            able |= (places[left] == 0) | (places[k] == 0)
            far = np.zeros(len(left), np.int64)
            common = np.minimum(places[left], places[k])
            for b in np.unique(common[able & (common > 0)]).tolist():
                at = np.flatnonzero(able & (common == b))
                far[at] = np.bitwise_count(words[b][left[at]] ^ words[b][k]).sum(axis=1)
            # sets that differ in more n-grams share too few
            able &= far <= (sizes[left] + sizes[k]) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
            able |= (places[left] == 0) | (places[k] == 0)
            found = left[able].tolist()
            out.extend((x, root) for x in found)
            queue.extend(found)
            left = left[~able]
    return out


def _allowed(groups: DataFrame, drawn: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` that hold together what may link in each group. ``drawn``: ``key``, ``n`` and ``sketch``."""
    def run(batches):
        group, keys, sizes, held = None, [], [], []

        def done():
            pairs = alike(np.array(sizes), held) if len(keys) > 1 else []
            if pairs:
                yield _pairs(np.array(keys, np.int64)[np.array(pairs)])

        for batch in batches:
            for g, key, n, sketch in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if g != group:
                    yield from done()
                    group, keys, sizes, held = g, [], [], []
                keys.append(key)
                sizes.append(n)
                held.append(sketch)
        yield from done()

    rows = groups.select("group", F.explode("members").alias("key")).join(drawn, "key").select("group", "key", "n", "sketch")
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long").distinct()


# ---- the trie -----------------------------------------------------------------------------------------

def _least_common(a: int, b: int) -> int:
    """Shared n-grams that sets of these sizes need to link."""
    return -(-(a + b) * NUMERATOR // (NUMERATOR + DENOMINATOR))


class Trie:
    """Sets as sorted rank arrays; equal beginnings share a path. Edges keep runs of ranks."""

    def __init__(self, sets: list[np.ndarray], frequent: np.ndarray):
        """``frequent``: whether another set holds the rank, too."""
        self.sets, self.frequent = sets, frequent
        n = len(sets)
        keyed = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(n), key=keyed.__getitem__)
        shared = np.zeros(n, np.int64)
        for k in range(1, n):
            a, b = sets[self.order[k - 1]], sets[self.order[k]]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            shared[k] = np.argmax(differ) if differ.any() else m
        size = np.array([len(sets[k]) for k in self.order])
        self.parent, self.lo, self.hi, self.one, self.small, self.large, self.alive = [], [], [], [], [], [], []
        self.children: list[list[int]] = []
        self.leaf = [0] * n
        self.entries: dict[int, list[tuple[int, int]]] = {}
        todo = [(0, n, 0, -1)]
        while todo:
            left, right, depth, parent = todo.pop()
            inner = shared[left + 1:right]
            end = int(inner.min()) if right - left > 1 else int(size[left])
            node = len(self.parent)
            largest = int(size[left:right].max())
            for column, value in zip(
                    (self.parent, self.lo, self.hi, self.one, self.small, self.large, self.alive, self.children),
                    (parent, depth, end, self.order[left], int(size[left:right].min()), largest, right - left, [])):
                column.append(value)
            if parent >= 0:
                self.children[parent].append(node)
            prefix = largest - -(-largest * NUMERATOR // DENOMINATOR) + 1
            ranks = sets[self.order[left]][depth:min(end, prefix)]
            for k in np.flatnonzero(frequent[ranks]).tolist():
                self.entries.setdefault(int(ranks[k]), []).append((node, depth + k))
            if right - left == 1:
                self.leaf[self.order[left]] = node
                continue
            cuts = [left, *(left + 1 + np.flatnonzero(inner == end)).tolist(), right]
            todo.extend((a, b, end, node) for a, b in zip(cuts, cuts[1:]))

    def take(self, k: int) -> None:
        """Set ``k`` belongs to a component: no probe needs to find it again."""
        node = self.leaf[k]
        while node >= 0:
            self.alive[node] -= 1
            node = self.parent[node]

    def probe(self, k: int, flags: np.ndarray) -> list[int]:
        """Sets not yet taken that link with set ``k``."""
        x = self.sets[k]
        n = len(x)
        flags[x] = 1
        found = []
        prefix = x[:n - -(-n * NUMERATOR // DENOMINATOR) + 1]
        for rank in prefix[self.frequent[prefix]].tolist():
            entries = self.entries.get(rank)
            if not entries:
                continue
            live = [e for e in entries if self.alive[e[0]]]
            self.entries[rank] = live
            for node, depth in live:
                if flags[self.sets[self.one[node]][:depth]].any():
                    continue  # reached from the first common n-gram already
                stack = [(node, depth, 0)]
                while stack:
                    at, begin, common = stack.pop()
                    if not self.alive[at] or self.large[at] * DENOMINATOR < n * NUMERATOR or n * DENOMINATOR < self.small[at] * NUMERATOR:
                        continue
                    edge = self.sets[self.one[at]][begin:self.hi[at]]
                    if len(edge):
                        common += int(flags[edge].sum())
                    if not self.children[at]:
                        y = self.one[at]
                        if common * DENOMINATOR >= NUMERATOR * (n + len(self.sets[y]) - common):
                            found.append(y)
                        continue
                    last = self.sets[self.one[at]][self.hi[at] - 1] if self.hi[at] else -1
                    rest = min(n - int(np.searchsorted(x, last, "right")), self.large[at] - self.hi[at])
                    if common + rest >= _least_common(n, self.small[at]):
                        stack.extend((c, self.hi[at], common) for c in self.children[at])
        flags[x] = 0
        return found


def link_sets(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """For each set that links with others, itself and the root of its component."""
    size = np.array([len(s) for s in sets])
    grams, rank, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((grams, count))
    place = np.empty(len(grams), np.int64)
    place[order] = np.arange(len(grams))
    rank = place[rank]
    ends = np.cumsum(size)
    ranked = [np.sort(rank[e - n:e]) for e, n in zip(ends.tolist(), size.tolist())]
    trie = Trie(ranked, count[order] > 1)
    flags = np.zeros(len(grams), np.uint8)
    taken = np.zeros(len(sets), bool)
    out = []
    for root in range(len(sets)):
        if taken[root]:
            continue
        taken[root] = True
        trie.take(root)
        queue = [root]
        while queue:
            for k in trie.probe(queue.pop(), flags):
                if not taken[k]:
                    taken[k] = True
                    trie.take(k)
                    queue.append(k)
                    out.append((k, root))
    return out


# ---- the join -----------------------------------------------------------------------------------------

def _link_groups(rows: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` of each ``task``'s sets (``id``, ``grams``); rows are sorted by task."""
    def run(batches):
        task, ids, sets = None, [], []

        def done():
            links = link_sets(sets) if len(sets) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k, _ in links], pa.binary()),
                                                  pa.array([ids[r] for _, r in links], pa.binary())], ["a", "b"])

        for batch in batches:
            for t, one, grams in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if t != task:
                    yield from done()
                    task, ids, sets = t, [], []
                if not ids or one != ids[-1]:
                    ids.append(one)
                    sets.append(np.frombuffer(grams, np.uint64))
        yield from done()

    return rows.repartition("task").sortWithinPartitions("task", "id").mapInArrow(run, "a binary, b binary")


def _grams(rows: DataFrame) -> DataFrame:
    """``grams``: the sorted hashes of ``text``, as bytes."""
    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            grams, bounds = gram_sets(texts)
            return [pa.array([grams[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())]
        return work

    keep = [c for c in rows.columns if c != "text"]
    return map_texts(rows, "text", StructType().add("grams", BinaryType()), make, keep).select("row.*", "grams")


#: Counters of the one order that all sets of wide classes share: 4 MB in each task and on the driver, at any size.
BINS = 1 << 20
_SLICES = 64
_OFTEN = np.uint64(2**32 - 1)


def _bin(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(44)).astype(np.int64)


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many ``grams`` of ``sets`` fall into each of ``BINS`` ranges of hashes (saturated): never fewer than the
    sets that hold any one of them. Tasks send counts, which are added up slice by slice."""
    def count(batches):
        total = np.zeros(BINS, np.uint64)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                held = b"".join(batch.column(0).slice(k, 256).to_pylist())
                total += np.bincount(_bin(np.frombuffer(held, np.uint64)), minlength=BINS).astype(np.uint64)
        if total.any():
            packed = [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in np.split(np.minimum(total, _OFTEN), _SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(packed, pa.binary())], ["slice", "counts"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[k] = totals.get(k, np.uint64(0)) + np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.uint64)
        if totals:
            sums = [np.minimum(x, _OFTEN).astype(np.uint32).tobytes() for x in totals.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(sums, pa.binary())], ["slice", "counts"])

    kind = "slice int, counts binary"
    parts = sets.select("grams").mapInArrow(count, kind).repartition("slice").mapInArrow(add, kind).collect()
    out = np.zeros((_SLICES, BINS // _SLICES), np.uint32)
    for k, counts in parts:
        out[k] = np.frombuffer(counts, np.uint32)
    return out.reshape(-1)



def rare_parts(often: np.ndarray):
    """For a batch of ``id``, ``class``, ``grams``: keys of the sets, and set and hash (with the class) of each of a set's
    first ``n - needed + 1`` n-grams, rarest range first, then by hash. Ranges of one count are nobody else's."""
    def signed(batch: pa.RecordBatch):
        ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), "V16")
        label = mix(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _SALT[1])
        who, keys = [], []
        for k in range(0, batch.num_rows, 256):
            held = [np.frombuffer(x, np.uint64) for x in batch.column(2).slice(k, 256).to_pylist()]
            size = np.array([len(x) for x in held])
            grams, own = np.concatenate(held), np.repeat(np.arange(len(held)), size)
            count = often[_bin(grams)]
            by = np.lexsort((grams, count, own))
            prefix = size - -(-size * NUMERATOR // DENOMINATOR) + 1
            place = np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size)
            by = by[place < prefix[own]]
            by = by[count[by] > 1]
            who.append(own[by] + k)
            keys.append(mix(grams[by] + label[own[by] + k]))
        return _keys(ids), np.concatenate(who), np.concatenate(keys)
    return signed


def _refine(sets: DataFrame, buckets: int) -> DataFrame:
    """``key``, ``class`` of wide classes (``id``, ``class``, ``grams``) split by their rare n-grams: linked sets share one
    among the first ``n - needed + 1`` in one order of all, whatever else they share. Sets that share none are gone."""
    sets = sets.select("id", "class", "grams")
    met = _meetings(_blocks(sets, rare_parts(frequencies(sets)), buckets), buckets)
    return components(met).toDF("key", "class")


def _linked(documents: DataFrame, id: str, text: str, keep: list[str], block_sets: int, block_grams: int):
    """Staged rows (``row``, ``doc``, ``uid``, ``n_shingles``, ``id``), and ``id``, ``root`` of linked sets."""
    spark = documents.sparkSession
    fields = StructType().add("n_shingles", LongType()).add("id", BinaryType()).add("key", LongType()).add("sketch", BinaryType())
    packed = documents.select(
        F.struct(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{id}`").alias("doc"),
                 F.unhex(F.md5(F.col(f"`{text}`"))).alias("content")).alias("out"), F.col(f"`{text}`").alias("text"))
    rows = stage(map_texts(packed, "text", fields, lambda: _identify, keep=["out"])
                 .select("row.out.*", "n_shingles", "id", "key", "sketch", F.monotonically_increasing_id().alias("uid")),
                 compression="zstd")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (16 << 20))
    texts = documents.select(F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    groups = stage(_groups(_blocks(texts, _text_parts, buckets, whole=True), buckets))
    # should two sets share a key, it has no sketch, and meets all
    only = F.when(F.min("sketch") == F.max("sketch"), F.min("sketch")).alias("sketch")
    drawn = (narrowed(rows.where("id IS NOT NULL"), groups.select(F.explode("members").alias("key")), "key")
             .groupBy("key").agg(F.min("n_shingles").alias("n"), only))
    classes = stage(components(_allowed(groups, drawn)).toDF("key", "class"))
    unstage(groups)

    # only what meets another set is shuffled: identities first, then one text for each of them
    one = narrowed(rows.where("id IS NOT NULL"), classes, "key").groupBy("id").agg(
        F.min("content").alias("content"), F.first("n_shingles").alias("n"), F.first("key").alias("key"))
    blocks = F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_grams)).cast("int").alias("blocks")
    members = stage(classes.join(one, "key").select("id", "key", "content", "n", "class"))
    members = stage(members.join(members.groupBy("class").agg(blocks), "class"))
    held = documents.select(F.unhex(F.md5(F.col(f"`{text}`"))).alias("content"), F.col(f"`{text}`").alias("text"))
    distinct = narrowed(held, members, "content").groupBy("content").agg(F.first("text").alias("text"))
    wide = (F.col("blocks") > 1).alias("wide")
    sets = stage(_grams(distinct.join(members.select("content", "id", "class", wide), "content")
                        .select("id", "class", "wide", "text")))

    grouped = sets.where("NOT wide").select(F.hex("class").alias("task"), "id", "grams")
    large = members.where("blocks > 1")
    if not large.isEmpty():
        split = stage(large.select("id", "key", "n").join(_refine(sets.where("wide"), buckets), "key"))
        split = stage(split.join(split.groupBy("class").agg(blocks), "class").select("id", "class", "blocks"))
        # a class of more blocks goes to one task per pair of blocks
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        other = F.when(F.col("blocks") > 1, F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("block")))
        dealt = (split.withColumn("block", block)
                 .withColumn("other", F.explode(F.coalesce(other, F.array(F.lit(0)))))
                 .select("id", F.concat_ws(":", F.hex("class"), F.least("block", "other"), F.greatest("block", "other")).alias("task")))
        again = narrowed(sets.where("wide").select("id", "grams"), split, "id")
        grouped = grouped.unionByName(dealt.join(again, "id").select("task", "id", "grams"))
    links = _link_groups(grouped)
    linked = components(links)  # reads tables of its own
    for table in (sets, members, classes):
        unstage(table)
    return rows, linked


def join_sets(documents: DataFrame, id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
              block_sets: int = BLOCK_SETS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """``row`` (the ``keep`` columns), ``n_shingles``, ``component`` (identity of the component's set, NULL
    for empty sets) and ``component_id`` (its smallest document id)."""
    keep = list(documents.columns) if keep is None else keep
    rows, linked = _linked(documents, id, text, keep, block_sets, block_grams)
    named = stage(rows.join(linked, "id", "left")
                  .select("row", "doc", "n_shingles", F.coalesce("root", "id").alias("component")))
    smallest = named.where("component IS NOT NULL").groupBy("component").agg(F.min("doc").alias("smallest"))
    return named.join(smallest, "component", "left").select(
        "row", "n_shingles", "component",
        F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("smallest")).alias("component_id"))


def first_of_components(documents: DataFrame, id: str = "doc_id", text: str = "text",
                        block_sets: int = BLOCK_SETS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """The documents without those that link with one that stays: one row per component, the smallest
    non-NULL id, and of equal ids any one row. Documents with empty sets stay."""
    rows, linked = _linked(documents, id, text, list(documents.columns), block_sets, block_grams)
    held = rows.where("id IS NOT NULL").select("id", F.struct(F.col("doc").isNull(), "doc", "uid").alias("first"))
    held = stage(held.join(linked, "id", "left").select("first", F.coalesce("root", "id").alias("component")))
    kept = held.groupBy("component").agg(F.min("first").alias("kept"), F.count("*").alias("n")).where("n > 1")
    gone = stage(held.join(kept, "component").where("first <> kept").select("first.uid"))
    return without(rows.select("uid", "row"), gone, "uid").select("row.*")
