"""Byte-level pre-tokenisation of many texts at once, as array work over their UTF-8 bytes.

The pieces are those of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
A piece is known by a rolling hash; pieces that have been encoded before lie in arrays sorted by it, and every hit is compared byte
by byte, so a merge table is asked once a piece.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
#: The code points of the White_Space property.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
MULTIPLIER = 0x9E3779B97F4A7C15


@cache
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    found = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    found[list(WHITE)] = SPACE
    return found


def kinds_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of the code point that each byte of UTF-8 belongs to, and where the code points of several bytes begin."""
    kind = classes()[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        wide = np.concatenate((data, np.zeros(3, np.uint8)))
        first, more = wide[lead].astype(np.int32), [(wide[lead + k] & 0x3F).astype(np.int32) for k in (1, 2, 3)]
        two, three = (first & 0x1F) << 6 | more[0], (first & 0x0F) << 12 | more[0] << 6 | more[1]
        four = (first & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        found = classes()[np.minimum(np.where(size == 2, two, np.where(size == 3, three, four)), 0x10FFFF)]
        for k in range(4):
            here = size > k
            at = lead[here] + k
            kind[at[at < len(kind)]] = found[here][at < len(kind)]
    return kind, lead


def piece_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces start in the bytes of texts laid end to end; text_starts: where (non-empty) texts start."""
    n = len(data)
    kind, lead = kinds_of(data)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[text_starts] = True
    runs = np.flatnonzero(start)
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    ends = np.append(runs[1:], n)
    white = (kind[runs] == SPACE) & ~first[ends]
    last = ends[white] - 1  # the last code point of a run of spaces
    inside = np.flatnonzero((data[last] & 0xC0) == 0x80)
    if len(inside):
        last[inside] = lead[np.searchsorted(lead, last[inside], "right") - 1]
    start[last] = True
    blank = data[last] == 0x20
    start[last[blank] + 1] = False
    # An apostrophe that begins a piece takes the letters of a contraction.
    lone = (data[runs] == 0x27) & (ends - runs == 1) & start[runs] & ~first[ends]
    quote = runs[lone]
    if len(quote):
        quote = quote[kind[quote + 1] == LETTER]
        run_end = ends[np.searchsorted(runs, quote + 1)]
        a = data[quote + 1]
        b = np.where(run_end - quote > 2, data[np.minimum(quote + 2, n - 1)], 0)
        is_ = lambda x, *letters: np.isin(x, [ord(c) for c in letters])
        taken = np.where(is_(a, "s", "t", "m", "d"), 1, np.where((is_(a, "r", "v") & is_(b, "e")) | (is_(a, "l") & is_(b, "l")), 2, 0))
        quote, taken, run_end = quote[taken > 0], taken[taken > 0], run_end[taken > 0]
        start[quote + 1] = False
        rest = quote + 1 + taken
        start[rest[rest < run_end]] = True
    return np.flatnonzero(start)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    up = np.cumprod(np.concatenate((one, np.full(n, MULTIPLIER, np.uint64))), dtype=np.uint64)
    down = np.cumprod(np.concatenate((one, np.full(n, pow(MULTIPLIER, -1, 1 << 64), np.uint64))), dtype=np.uint64)
    values = np.random.default_rng(7).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
    return up, down, values


def rolling(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums from which the hash of any run of bytes is found; which: one of two independent hashes."""
    up, _, values = _powers(1 << max(16, int(len(data)).bit_length()))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[which][data] * up[: len(data)], out=sums[1:])
    return sums


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where an example of each different key is, the number of every key's example)."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def piece_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of the bytes of each run, the same wherever the run stands."""
    sums, down = rolling(data), _powers(1 << max(16, int(len(data)).bit_length()))[1]
    return (sums[ends] - sums[starts]) * down[starts]


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, other: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the runs of a and b of equal sizes are the same, eight bytes a step; both arrays have eight bytes to spare."""
    out = np.ones(len(at), bool)
    x, y = (np.ndarray((len(v) - 7,), "<u8", v, 0, (1,)) for v in (a, b))  # eight bytes from each place on
    left, step = np.flatnonzero(sizes > 0), 0
    while len(left):
        bits = np.minimum(sizes[left] - step, 8).astype(np.uint64) * np.uint64(8)
        differ = (x[at[left] + step] ^ y[other[left] + step]) << (np.uint64(64) - bits)
        out[left[differ != 0]] = False
        step += 8
        left = left[(differ == 0) & (sizes[left] > step)]
    return out


class Known:
    """Pieces with their ids, as arrays sorted by key; of two pieces of one key the first stays."""

    #: Leading bits of a key that say where to look.
    BITS = 20
    ROWS = ("key", "id_at", "id_n", "at", "size", "used")

    def __init__(self) -> None:
        none = np.zeros(0, np.int64)
        self.key, self.ids, self.flat, self.used = none.astype(np.uint64), none.astype(np.uint32), np.zeros(8, np.uint8), none.astype(bool)
        self.id_at, self.id_n, self.at, self.size = none, none, none, none
        self.first = np.zeros((1 << self.BITS) + 1, np.int64)

    def __len__(self) -> int:
        return len(self.key)

    def index(self) -> None:
        np.cumsum(np.bincount((self.key >> np.uint64(64 - self.BITS)).astype(np.int64), minlength=1 << self.BITS), out=self.first[1:])

    def add(self, key: np.ndarray, found: list[bytes], ids: list) -> np.ndarray:
        """Add pieces with different keys, in order of key; the new numbers of those that were there."""
        sizes, counts = np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(map(len, ids), np.int64, len(ids))
        place = np.searchsorted(self.key, key)
        new = np.ones(len(key), bool) if not len(self) else self.key[np.minimum(place, len(self) - 1)] != key
        rows = {"key": key, "id_at": len(self.ids) + np.cumsum(counts) - counts, "id_n": counts, "at": len(self.flat) - 8 + np.cumsum(sizes) - sizes, "size": sizes, "used": np.zeros(len(key), bool)}
        self.flat = np.concatenate((self.flat[:-8], np.frombuffer(b"".join(found), np.uint8), np.zeros(8, np.uint8)))
        self.ids = np.concatenate((self.ids, np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))))
        moved = np.arange(len(self)) + np.cumsum(np.bincount(place[new], minlength=len(self) + 1))[:-1]
        for name in self.ROWS:
            setattr(self, name, np.insert(getattr(self, name), place[new], rows[name][new]))
        self.index()
        return moved

    def forget(self) -> None:
        """Drop the pieces that were not found since they came or since the last time; all, where that leaves too many."""
        keep = np.flatnonzero(self.used)
        if 4 * len(keep) > 3 * len(self):
            self.__init__()
            return
        for where, n, flat in (("at", "size", "flat"), ("id_at", "id_n", "ids")):
            sizes, starts, old = getattr(self, n)[keep], getattr(self, where)[keep], getattr(self, flat)
            total = np.cumsum(sizes)
            picked = old[np.repeat(starts - (total - sizes), sizes) + np.arange(int(total[-1]) if len(keep) else 0)]
            setattr(self, flat, np.concatenate((picked, np.zeros(8, np.uint8))) if flat == "flat" else picked)
            setattr(self, f"_{where}", total - sizes)
        self.key, self.size, self.id_n, self.at, self.id_at = self.key[keep], self.size[keep], self.id_n[keep], self._at, self._id_at
        self.used = np.zeros(len(keep), bool)
        self.index()

    def find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The number of each piece, or -1; data has eight bytes to spare."""
        out = np.full(len(key), -1)
        head = (key >> np.uint64(64 - self.BITS)).astype(np.int64)
        place, end = self.first[head], self.first[head + 1]
        left = np.flatnonzero(place < end)
        while len(left):
            hit = self.key[place[left]] == key[left]
            out[left[hit]] = place[left[hit]]
            left = left[~hit]
            place[left] += 1
            left = left[place[left] < end[left]]
        hit = np.flatnonzero(out >= 0)
        same = self.size[out[hit]] == sizes[hit]
        out[hit[~same]] = -1
        hit = hit[same]
        out[hit[~same_bytes(data, starts[hit], self.flat, self.at[out[hit]], sizes[hit])]] = -1
        self.used[out[out >= 0]] = True
        return out


class Memo:
    """Numbers that belong to runs of bytes; those of runs seen before are kept, up to a bound."""

    def __init__(self, of: Callable[[list[bytes]], list], most_kept: int = 500_000, most_bytes: int = 8_000_000) -> None:
        self.of, self.most_kept, self.most_bytes, self.known = of, most_kept, most_bytes, Known()

    def look(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray, fixed: dict[int, list] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All numbers, and for each run where its own begin and how many they are; fixed: the numbers of certain runs, by their place in at."""
        if len(self.known) > self.most_kept or len(self.known.flat) > self.most_bytes:
            self.known.forget()
        own = np.array(sorted(fixed or {}), np.int64)
        sizes, key = ends - at, piece_keys(data, at, ends)
        wide = np.concatenate((data, np.zeros(8, np.uint8)))
        number = self.known.find(wide, at, sizes, key)
        if len(missing := self.missing(number, own)):
            flat, example = wide.tobytes(), missing[numbered(key[missing])[0]]
            found = [flat[s : s + z] for s, z in zip(at[example].tolist(), sizes[example].tolist(), strict=True)]
            moved, hit = self.known.add(key[example], found, self.of(found)), number >= 0
            number[hit] = moved[number[hit]]
            number[missing] = self.known.find(wide, at[missing], sizes[missing], key[missing])
        # Fixed runs, and those whose key another run has, have numbers of their own.
        other = dict(fixed or {}) | {k: self.of([wide[at[k] : at[k] + sizes[k]].tobytes()])[0] for k in self.missing(number, own).tolist()}
        where, counts = np.array(list(other), np.int64), np.array([len(x) for x in other.values()], np.int64)
        values = np.concatenate((self.known.ids, np.array([i for x in other.values() for i in x], np.uint32)))
        first, many = np.append(self.known.id_at, 0)[number], np.append(self.known.id_n, 0)[number]
        first[where], many[where] = len(self.known.ids) + np.cumsum(counts) - counts, counts
        return values, first, many

    @staticmethod
    def missing(number: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Runs without a number that are not fixed."""
        left = np.flatnonzero(number < 0)
        return left[~np.isin(left, own)] if len(own) else left


def spread(values: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The values of all runs in a row."""
    total = np.cumsum(many)
    return values[np.repeat(first - (total - many), many) + np.arange(int(total[-1]) if len(total) else 0)]


class Encoder:
    """Ids of whole texts, from the ids of their different pieces."""

    def __init__(self, ids_of: Callable[[list[bytes]], list], specials: dict[str, int], **bounds: int) -> None:
        self.specials, self.memo = {k.encode(): v for k, v in specials.items()}, Memo(ids_of, **bounds)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [t.encode() for t in texts]
        return self.encode(np.frombuffer(b"".join(found), np.uint8), np.cumsum([0, *map(len, found)]))

    def fixed(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """Start, end and id of the special tokens in the texts, from the left."""
        flat, found = data.tobytes() if self.specials else b"", []
        for special, number in self.specials.items():
            at = flat.find(special)
            while at >= 0:
                end = at + len(special)
                whole = np.searchsorted(offsets, end) == np.searchsorted(offsets, at, "right")
                if whole:
                    found.append((at, end, number))
                at = flat.find(special, end if whole else at + 1)
        return sorted(found)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (unsigned 32-bit), and the offset of each text's in them, for the UTF-8 bytes of texts laid end to end."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        special = self.fixed(data, offsets)
        borders = np.unique(np.concatenate((offsets[:-1], np.array([x for s in special for x in s[:2]], np.int64))))
        at = piece_starts(data, borders[borders < n])
        begin, end = np.array([s[0] for s in special], np.int64), np.array([s[1] for s in special], np.int64)
        if special:  # a special token is one piece
            k = np.searchsorted(begin, at, "right") - 1
            at = at[(k < 0) | (at == begin[k]) | (at >= end[k])]
        own = dict(zip(np.searchsorted(at, begin).tolist(), ([s[2]] for s in special), strict=True))
        values, first, many = self.memo.look(data, at, np.append(at[1:], n), own)
        return spread(values, first, many), np.concatenate(([0], np.cumsum(many)))[np.searchsorted(at, offsets)]
