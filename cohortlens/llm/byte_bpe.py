"""Byte-level BPE: encode by a segment tree of pair ranks, decode back to bytes.

A tree over the byte positions of a piece keeps the leftmost smallest rank of any neighbouring pair;
a merge changes three leaves (the merged token and its live neighbours), each in logarithmic time.
Every distinct piece is encoded once per task and remembered within a bound of bytes.

Defined results: NULL and empty texts give no tokens; special tokens are ordinary text; repeated rows
and ids are encoded row by row; very long pieces cost n log n.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from cohortlens.llm.arrays import lists, map_texts, ranges

NONE = 1 << 62
#: Bytes of pieces remembered by a task before it starts anew.
REMEMBERED = 64 << 20
#: Pieces merged side by side.
BATCH = 1 << 15


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: merge the leftmost pair of the smallest rank until none is known."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = ranks[piece[i:i + 2]] * n + i if piece[i:i + 2] in ranks else NONE
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b  # rank * n + position: the leftmost of equal ranks is the smallest
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # live neighbours; n and -1 are the ends

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    def pair(i: int) -> int:
        j = after[i]
        if j >= n:
            return NONE
        rank = ranks.get(piece[i:after[j]])
        return NONE if rank is None else rank * n + i

    while tree[1] < NONE:
        i = tree[1] % n
        gone = after[i]
        after[i] = after[gone]
        if after[gone] < n:
            before[after[gone]] = i
        put(gone, NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class Merger:
    """The same merging for many short pieces at once: one row of arrays and one tree per piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.top = int(values.max(initial=0)) + 1
        # open addressing: two or more slots for each pair
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[slot[rest]] < 0
            self.keys[slot[rest[free]]] = keys[rest[free]]  # of equal slots the last one stays
            self.values[slot[rest[free]]] = values[rest[free]]
            rest = rest[self.keys[slot[rest]] != keys[rest]]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merged pair of token ids, -1 if there is none."""
        keys = (a.astype(np.int64) << 32) | b
        slot = self._slot(keys)
        out = self.values[slot]
        seen = self.keys[slot]
        rest = np.flatnonzero((seen != keys) & (seen >= 0))
        out[(seen != keys) & (seen < 0)] = -1
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[rest]]
            out[rest] = np.where(seen == keys[rest], self.values[slot[rest]], -1)
            rest = rest[(seen != keys[rest]) & (seen >= 0)]
        return out

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and the first of each piece (one longer than the pieces)."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        data, start = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(length) - length
        whole = np.fromiter(map(self.ranks.get, pieces, repeat(-1)), np.int64, n)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.flatnonzero(whole >= 0)
        found.append((single, whole[single].astype(np.int32), np.ones(len(single), np.int64)))
        rest = np.flatnonzero(whole < 0)
        for k in rest[length[rest] > 64].tolist():
            ids = merge(pieces[k], self.ranks)
            found.append((np.array([k]), np.array(ids, np.int32), np.array([len(ids)])))
        for size in (4, 8, 16, 32, 64):
            members = rest[(length[rest] <= size) & (length[rest] > (size // 2 if size > 4 else 0))]
            for i in range(0, len(members), BATCH):
                who = members[i:i + BATCH]
                found.append((who, *self._merge(size, data[ranges(start[who], length[who])], length[who])))
        who, ids, count = (np.concatenate(x) for x in zip(*found))
        at = np.empty(n, np.int64)
        at[who] = np.cumsum(count) - count
        counts = np.empty(n, np.int64)
        counts[who] = count
        return ids[ranges(at, counts)], np.concatenate([[0], np.cumsum(counts)])

    def _merge(self, size: int, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces (``data`` has their bytes) one after the other, and how many each has."""
        n = len(length)
        none = np.int32(2**31 - 1)
        live = np.arange(size + 1) < length[:, None]  # last column: what lies beyond a piece
        token = np.full((n, size + 1), -1, np.int32)
        token[live] = self.byte[data]
        after = np.minimum(np.arange(1, size + 2), length[:, None]).astype(np.int32)
        after[after == length[:, None]] = size
        before = np.broadcast_to(np.r_[size, np.arange(size)].astype(np.int32), (n, size + 1)).copy()
        tree = np.full((n, 2 * size), none, np.int32)
        row, at = np.nonzero(live[:, 1:])
        rank = self.rank(token[row, at], token[row, at + 1])
        tree[row, size + at] = np.where(rank >= 0, rank * size + at, none)
        level = size
        while level > 1:
            half = level >> 1
            tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level = half
        token, after, before, flat, alive = (x.reshape(-1) for x in (token, after, before, tree, live))
        rows = np.arange(n)
        while True:
            root = flat[rows * (2 * size) + 1]
            go = root < none
            rows, root = rows[go], root[go]
            if not len(rows):
                break
            base, trunk = rows * (size + 1), rows * (2 * size)
            i = root % size
            gone = after[base + i]
            then, first = after[base + gone], before[base + i]
            token[base + i] = root // size
            after[base + i] = then
            before[base + then] = i
            alive[base + gone] = False
            flat[trunk + size + gone] = none
            rank = self.rank(token[base + i], token[base + then])
            flat[trunk + size + i] = np.where((then < size) & (rank >= 0), rank * size + i, none)
            rank = self.rank(token[base + first], token[base + i])
            some = first < size
            flat[(trunk + size + first)[some]] = np.where(rank >= 0, rank * size + first, none)[some]
            for point in (gone, i, np.where(some, first, i)):
                up = (size + point) >> 1
                for _ in range(size.bit_length() - 1):
                    flat[trunk + up] = np.minimum(flat[trunk + 2 * up], flat[trunk + 2 * up + 1])
                    up = up >> 1
        live = alive.reshape(n, size + 1)
        return token.reshape(n, size + 1)[live], live.sum(1)


#: A blank may head a run of letters, of digits or of other signs; white space alone never holds on to them.
BLANK_HEADED = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Splits by the pattern and merges each distinct piece once.

    Where the pattern always breaks before a blank between two other characters (``BLANK_HEADED``), texts
    are cut at such blanks first and the ids of equal parts are remembered too.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        self.runs = re.compile(r"\s\s").search
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.merger = Merger(ranks)
        self.breaks = pattern.endswith(BLANK_HEADED)
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # ids of first and of later parts
        self.size = 0
        top = max(ranks.values(), default=0)
        tokens = [b""] * (top + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_size = np.fromiter(map(len, tokens), np.int64, top + 1)
        self.token_start = np.cumsum(self.token_size) - self.token_size

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as the bytes of 32-bit numbers."""
        parts = [self._parts(x) for x in texts]
        if self.size > REMEMBERED:
            self.known, self.size = ({}, {}), 0
        first, later = self.known
        self._learn(first, {x[0] for x in parts if x}, "")
        self._learn(later, set().union(*(x[1:] for x in parts)), " ")
        get = later.__getitem__
        return [first[x[0]] + b"".join(map(get, x[1:])) if x else b"" for x in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of these ids; an id outside the vocabulary raises."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token_size)):
            raise ValueError("an id is outside the vocabulary")
        return self.token_bytes[ranges(self.token_start[ids], self.token_size[ids])].tobytes()

    def _parts(self, text: str) -> list[str]:
        """Parts whose matches are those of the whole text; all but the first have lost a blank before them."""
        if not text:
            return []
        if not self.breaks:
            return [text]
        if text[0] == " " or text[-1] == " " or self.runs(text):
            return self.cut(text)
        return text.split(" ")

    def _learn(self, known: dict[str, bytes], parts: set[str], lead: str) -> None:
        new = [x for x in parts if x not in known]
        if not new:
            return
        if lead:  # each part begins with its blank: all can be split at once
            pieces = self.find(lead + lead.join(new))
            ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + len(lead))
        else:
            split = [self.find(x) for x in new]
            pieces = list(chain.from_iterable(split))
            ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        stops = np.searchsorted(np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), ends) + 1
        place: dict[str, int] = {}
        which = np.fromiter((place.setdefault(x, len(place)) for x in pieces), np.int64, len(pieces))
        ids, start = self.merger.merge_all(list(map(str.encode, place)))
        count = np.diff(start)[which]
        data = ids[ranges(start[which], count)].tobytes()
        at = (4 * np.cumsum(count)[stops - 1]).tolist()
        lo = 0
        for part, hi in zip(new, at):
            known[part] = data[lo:hi]
            lo = hi
        self.size += len(data) + 4 * int(ends[-1]) + 200 * len(new)


def decimal(ids: np.ndarray) -> bytes:
    """The ids in decimal, joined by one blank."""
    if not len(ids):
        return b""
    width = len(str(int(ids.max()))) + 1
    digits = np.empty((len(ids), width), np.uint8)
    digits[:, -1] = 32
    rest = ids.astype(np.int32)
    shown = np.ones((len(ids), width), bool)
    for k in range(width - 2, -1, -1):
        shown[:, k] = rest > 0
        digits[:, k] = 48 + rest % 10
        rest = rest // 10
    shown[:, -2] = True
    return digits[shown][:-1].tobytes()


_LOADED: dict[tuple[str, str], Encoder] = {}


def load(path: str, pattern: str) -> Encoder:
    """Once per Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(read_ranks(path), pattern)
    return _LOADED[path, pattern]


def _each(texts: pa.Array) -> list[str]:
    return [x or "" for x in texts.to_pylist()]


def encode(documents: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns) and ``ids`` (array<int>)."""
    def make():
        encoder = load(path, pattern)

        def work(texts: pa.Array) -> list[pa.Array]:
            found = encoder.ids(_each(texts))
            counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
            return [lists(pa.array(np.frombuffer(b"".join(found), np.int32)), counts)]
        return work

    return map_texts(documents, text, StructType().add("ids", ArrayType(IntegerType())), make, keep)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``row`` (all columns) and ``bytes``, what the ids stand for (NULL: none)."""
    packed = encoded.select(F.struct(*(F.col(f"`{c}`") for c in encoded.columns)).alias("row"),
                            F.col(f"`{ids}`").alias("ids"))

    def run(batches):
        encoder = load(path, pattern)
        for batch in batches:
            out = [encoder.decode(np.array(x or (), np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["row", "bytes"])

    return packed.mapInArrow(run, StructType([packed.schema["row"]]).add("bytes", BinaryType()))


def encode_digest(documents: DataFrame, path: str, pattern: str, text: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """``row``, ``n_tokens``, ``ids_sha256`` (decimal ids joined by blanks) and ``decoded_sha256`` (the bytes
    that these ids decode to): a round trip without moving the ids out of the task."""
    fields = StructType().add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())

    def make():
        encoder = load(path, pattern)

        def work(texts: pa.Array) -> list[pa.Array]:
            found = [np.frombuffer(x, np.int32) for x in encoder.ids(_each(texts))]
            return [pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(decimal(x)).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in found], pa.string())]
        return work

    return map_texts(documents, text, fields, make, keep)
