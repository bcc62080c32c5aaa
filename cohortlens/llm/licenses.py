"""License scans: MinHash bands over overlapping windows find templates, exact containment verifies them.

Texts are read as lower-cased words and five-word shingles. Templates of about the same length form a
class; its windows are long enough to hold any of them whole wherever they begin. A window and a template
that it contains to ``CONTAINMENT`` have a known least similarity, and the number of bands is set so that
they collide in one with a probability of ``CERTAINTY`` or more. Templates of up to four shingles must be
contained whole: there the window is as long as the template and one hash decides.

Every place is returned: of the windows that hold a template those with the most of its shingles come first, each is cut
to the shortest stretch that holds as many, and what overlaps a place already taken is the same place. Notices that differ
by a version alone contain each other to ``CONTAINMENT``: a place found in part goes if another licence covers more than
half of it and is found to a larger share. Templates that are found whole always stay.

Defined results: NULL, empty and short texts have no windows and no match; repeated rows are scanned row by
row; texts of any length are scanned whole; an empty table gives an empty result; columns stay in ``row``.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from cohortlens.llm.arrays import ALNUM, Words, lists, map_texts, mix, ranges
from cohortlens.llm.license_templates import TEMPLATES

SHINGLE = 5
#: Share of a template's shingles that a window must hold, in percent.
CONTAINMENT = 80
CERTAINTY = 0.999
ROWS = 2
#: Longest over shortest template of a class.
SPREAD = 1.25

FIELDS = StructType().add("matches", ArrayType(
    StructType().add("license", StringType()).add("template", IntegerType()).add("n_shingles", LongType())
    .add("n_found", LongType()).add("start", IntegerType()).add("stop", IntegerType())))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Five-word shingle hashes in text order, and where each text's begin."""
    words = Words(texts, ALNUM)
    h, count = words.hashes(), np.diff(words.first)
    size = np.maximum(count - SHINGLE + 1, 0)
    at = ranges(words.first[:-1], size)
    value = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        value += h[at + j] * _PLACE[j]
    value = mix(value)
    return value, np.concatenate([[0], np.cumsum(size)])


_RANDOM = np.random.default_rng(5)
_PLACE = _RANDOM.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_FACTORS = _RANDOM.integers(1, 2**32, (1 << 12, 2), dtype=np.uint32) | np.uint32(1)
_BEYOND = np.uint32(2**32 - 1)
_LOW = 1 << 16


def _short(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(32)).astype(np.uint32)


def _hash(values: np.ndarray, i: int) -> np.ndarray:
    """The ``i``-th order of 32-bit values."""
    h = (values ^ _FACTORS[i, 0]) * _FACTORS[i, 1]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def _key(least: list[np.ndarray]) -> np.ndarray:
    """A band's key from the smallest values of its rows."""
    key = np.zeros(len(least[0]), np.uint64)
    for row, value in enumerate(least):
        key = mix(key + value + np.uint64(row + 1))
    return key


def _slide(least: np.ndarray, span: int) -> np.ndarray:
    """Smallest of ``span`` neighbours, each place and those behind it."""
    reach = 1
    while reach < span:
        k = min(reach, span - reach)
        least = np.concatenate([np.minimum(least[:-k], least[k:]), least[-k:]])
        reach += k
    return least


class Class:
    """Templates of similar length: ``block`` shingles (a power of two) to a step, ``span`` steps to a
    window, and bands."""

    def __init__(self, members: list[tuple[int, np.ndarray]]):
        self.members = members
        short, long = min(len(s) for _, s in members), max(len(s) for _, s in members)
        if long <= 4:
            self.block, self.span, self.rows, self.bands = 1, long, 1, 1
        else:
            self.block = 1 << (max(2, long // 4).bit_length() - 1)
            self.span = -(-long // self.block) + 1
            part = CONTAINMENT / 100
            least = part * short / (self.span * self.block + (1 - part) * short)
            self.rows = ROWS
            self.bands = math.ceil(math.log(1 - CERTAINTY) / math.log(1 - least ** ROWS))
        self.keyed: list[dict[int, list[int]]] = [{} for _ in range(self.bands)]
        self.maybe = [np.zeros(_LOW, bool) for _ in range(self.bands)]
        for k, (_, own) in enumerate(members):
            for band in range(self.bands):
                least = [_hash(_short(own), band * ROWS + row).min(keepdims=True) for row in range(self.rows)]
                self.keyed[band].setdefault(int(_key(least)[0]), []).append(k)
                self.maybe[band][least[0] % _LOW] = True

    def meet(self, band: int, least: list[dict[int, np.ndarray]]):
        """Windows and templates that share this band's key. ``least``: per row and block length, the
        smallest values of all blocks. Only windows whose first row may fit need their other rows."""
        first = _slide(least[0][self.block], self.span)
        at = np.flatnonzero(self.maybe[band][first.astype(np.uint16)])
        if not len(at):
            return
        rows = [first[at]]
        for row in range(1, self.rows):
            every = least[row][self.block]
            rows.append(every[np.minimum(at[:, None] + np.arange(self.span), len(every) - 1)].min(axis=1))
        for window, key in zip(at.tolist(), _key(rows).tolist()):
            for k in self.keyed[band].get(key, ()):
                yield window, k


def _shortest(ids: list[int], places: list[int], count: int) -> tuple[int, int]:
    """First and last of the shortest run of ``places``, the first such, whose ``ids`` hold ``count`` different ones."""
    held: Counter = Counter()
    best, left = (places[0], places[-1]), 0
    for right, k in enumerate(ids):
        held[k] += 1
        while len(held) == count:
            if places[right] - places[left] < best[1] - best[0]:
                best = places[left], places[right]
            held[ids[left]] -= 1
            if not held[ids[left]]:
                del held[ids[left]]
            left += 1
    return best


def _apart(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of one template's (shingles, start, stop) those that lie apart: most shingles first, then the shortest, then the first."""
    taken: list[tuple[int, int, int]] = []
    for count, start, stop in sorted(found, key=lambda e: (-e[0], e[2] - e[1], e[1])):
        k = bisect_left(taken, (start,))
        if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= stop):
            insort(taken, (start, stop, count))
    return taken


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        named = [(name, text) for name, texts in templates.items() for text in texts]
        value, bounds = shingles(pa.array([t for _, t in named], pa.large_string()))
        self.names = [n for n, _ in named]
        sets = [(k, np.unique(value[bounds[k]:bounds[k + 1]])) for k in range(len(named))]
        if any(not len(s) for _, s in sets):
            raise ValueError(f"a template needs {SHINGLE} words or more")
        self.sets = dict(sets)
        self.classes, rest = [], sorted(sets, key=lambda x: len(x[1]))
        while rest:
            least = len(rest[0][1])
            limit = least if least <= 4 else int(least * SPREAD)
            self.classes.append(Class([x for x in rest if len(x[1]) <= limit]))
            rest = [x for x in rest if len(x[1]) > limit]

        self.bands = max(c.bands for c in self.classes)
        self.largest = max(c.block for c in self.classes)
        margin = max((c.span - 1) * c.block for c in self.classes)
        self.margin = -(-margin // self.largest) * self.largest

    def _blocks(self, values: np.ndarray, beyond: np.ndarray, i: int) -> dict[int, np.ndarray]:
        """Smallest values in the ``i``-th order of blocks of 1, 2, 4, ... places."""
        least, block = _hash(values, i) | beyond, 1
        out = {1: least}
        while block < self.largest:
            least, block = np.minimum(least[::2], least[1::2]), 2 * block
            out[block] = least
        return out

    def scan(self, texts: pa.Array) -> list[pa.Array]:
        value, bounds = shingles(texts)
        n_docs = len(texts)
        found: dict[tuple[int, int], set[tuple[int, int, int]]] = defaultdict(set)
        size = np.diff(bounds)
        # texts lie apart by so many empty places that no window reaches two of them
        place = np.concatenate([[0], np.cumsum(np.where(size, -(-size // self.largest) * self.largest + self.margin, 0))])
        at = ranges(place[:-1], size)
        flat, beyond = np.zeros(place[-1], np.uint32), np.full(place[-1], _BEYOND, np.uint32)
        flat[at], beyond[at] = _short(value), 0
        met: list[set[tuple[int, int]]] = [set() for _ in self.classes]
        for band in range(self.bands if len(value) else 0):
            least = [self._blocks(flat, beyond, band * ROWS + row) for row in range(ROWS)]
            for c, pairs in zip(self.classes, met):
                if band < c.bands:
                    pairs.update(c.meet(band, least))
        for c, pairs in zip(self.classes, met):
            for window, k in sorted(pairs):
                template, own = c.members[k]
                d = int(np.searchsorted(place, window * c.block, "right")) - 1
                first = int(bounds[d])
                a = first + window * c.block - int(place[d])
                held = value[a:min(a + c.block * c.span, int(bounds[d + 1]))]
                hit = np.flatnonzero(np.isin(held, own))
                ids = np.searchsorted(own, held[hit])
                count = len(np.unique(ids))
                if 100 * count >= CONTAINMENT * len(own):
                    start, last = _shortest(ids.tolist(), hit.tolist(), count)
                    found[d, template].add((count, a + start - first, a + last - first + SHINGLE))
        places = defaultdict(list)
        for (d, template), some in found.items():
            places[d] += [(start, stop, template, count) for start, stop, count in _apart(some)]
        rows = [(d, *place) for d in sorted(places) for place in self._told_apart(sorted(places[d]))]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        columns = [[self.names[t] for _, _, _, t, _ in rows], [t for _, _, _, t, _ in rows], [len(self.sets[t]) for _, _, _, t, _ in rows],
                   [n for *_, n in rows], [start for _, start, *_ in rows], [stop for _, _, stop, *_ in rows]]
        struct = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], FIELDS[0].dataType.elementType.names)
        return [lists(struct, np.bincount(np.array([d for d, *_ in rows], np.int64), minlength=n_docs))]

    def _told_apart(self, places: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Without those that another licence covers for more than half and is found to a larger share."""
        lost, open_ = set(), []
        for at in places:
            open_ = [o for o in open_ if o[1] > at[0]]
            for other in open_:
                shared = min(at[1], other[1]) - at[0]
                for a, b in ((at, other), (other, at)):
                    if (self.names[a[2]] != self.names[b[2]] and 2 * shared > a[1] - a[0]
                            and a[3] * len(self.sets[b[2]]) < b[3] * len(self.sets[a[2]])):
                        lost.add(a)
            open_.append(at)
        return [at for at in places if at not in lost]


def scan_licenses(documents: DataFrame, templates: dict[str, list[str]] | None = None, text: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns) and ``matches``: for each place of a template its licence and number, how many of its
    shingles were found there and the words from the first to behind the last of them, by start. ``templates`` (name to
    notices, a parameter of bounded size) travel with the task."""
    held = TEMPLATES if templates is None else templates
    return map_texts(documents, text, FIELDS, lambda: Scanner(held).scan, keep)
