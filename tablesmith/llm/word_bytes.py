"""Words of plain texts straight from their bytes, and their ids, without a Python object for each word of a text."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

SPACE, LETTER, NUMBER, OTHER, INNER = range(5)
LONGEST = 32  # bytes of a word that its hashes see whole


def _kind(c: str) -> int:
    if c in "\t\n\x0b\x0c\r \x85\xa0":
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)


_KINDS = np.full(256, INNER, np.uint8)
_KINDS[:128] = [_kind(chr(c)) for c in range(128)]
_KINDS[[0xC3, 0xC4, 0xC5]] = LETTER
_KINDS[[0xC2, 0xE2]] = OTHER
_AFTER_C2 = np.full(256, OTHER, np.uint8)
_AFTER_C2[0x80:0xC0] = [_kind(chr(c)) for c in range(0x80, 0xC0)]
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], "<u8")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], "<u8")


def split(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of lower-cased plain texts: contractions, runs of letters, single numbers, runs of others."""
    kind = _KINDS[buf]
    at = np.flatnonzero(buf == 0xC2)
    kind[at] = _AFTER_C2[buf[at + 1]]
    at = np.flatnonzero(buf == 0xC3)
    at = at[(buf[at + 1] == 0x97) | (buf[at + 1] == 0xB7)]
    kind[at] = OTHER
    inner = np.flatnonzero(kind == INNER)
    for _ in range(2):
        kind[inner] = kind[inner - 1]
    fresh = np.ones(len(buf), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh |= kind == NUMBER
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    fresh |= first[:-1]
    fresh[inner] = False
    edges = np.append(np.flatnonzero(fresh), len(buf))
    words = np.flatnonzero(kind[edges[:-1]] != SPACE)
    starts, ends = edges[words], edges[words + 1]
    quotes = np.flatnonzero((ends - starts == 1) & (buf[starts] == 0x27))
    if len(quotes):
        quotes = quotes[quotes + 1 < len(starts)]
        p = starts[quotes] + 1
        quotes, p = (x[(starts[quotes + 1] == p) & ~first[p]] for x in (quotes, p))
        room = ends[quotes + 1] - p
        a, b = buf[p], buf[np.minimum(p + 1, len(buf) - 1)]
        one = np.isin(a, list(b"stmd"))
        two = (room >= 2) & (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C)))
        taken = np.where(one, 1, np.where(two, 2, 0))
        quotes, p, room, taken = (x[taken > 0] for x in (quotes, p, room, taken))
        ends[quotes] = p + taken
        starts[quotes + 1] = p + taken
        keep = np.ones(len(starts), bool)
        keep[quotes[room == taken] + 1] = False
        starts, ends = starts[keep], ends[keep]
    return starts, ends


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    return x ^ (x >> np.uint64(29))


def hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word of at most LONGEST bytes, from its first, second, last and last but one eight bytes."""
    at8 = np.ndarray((len(text) + 8,), "<u8", text + bytes(16), strides=(1,))
    size = ends - starts
    head = at8[starts] & _MASKS[np.minimum(size, 8)]
    tail = np.where(size > 8, at8[np.maximum(ends - 8, 0)], 0)
    one = _mixed(head * _ODD[1] + size.astype("<u8")) ^ (tail * _ODD[2])
    two = _mixed(tail * _ODD[3] + head) + size.astype("<u8") * _ODD[4]
    long = np.flatnonzero(size > 16)
    if len(long):
        more = at8[starts[long] + 8] * _ODD[3] + _mixed(at8[ends[long] - 16])
        one[long] += _mixed(more)
        two[long] ^= more * _ODD[0]
    return _mixed(one), two


class WordIds:
    """Remembers the ids of words by their hashes, up to a number of words."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.second, self.at, self.size = np.zeros(1024, "<u8"), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, "<u4"), 0

    def add(self, one: int, two: int, ids: list[int]) -> int:
        row = len(self.rows)
        if row == len(self.at):
            self.second, self.at, self.size = (np.append(x, np.zeros_like(x)) for x in (self.second, self.at, self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.rows[one], self.second[row], self.at[row], self.size[row] = row, two, self.used, len(ids)
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return row

    def encode(self, texts: list[bytes], tokens) -> list[np.ndarray | None]:
        """The ids of lower-cased plain texts; None for a text that has a word too long. tokens(word): a new word's ids."""
        text = b"".join(texts)
        offsets = np.append(0, np.cumsum([len(t) for t in texts]))
        buf = np.frombuffer(text, np.uint8)
        if not len(buf):
            return [np.zeros(0, "<u4") for _ in texts]
        starts, ends = split(buf, offsets)
        of = np.searchsorted(starts, offsets)
        # Words beyond LONGEST are neither looked up nor remembered: their hashes would be those of their first bytes.
        long = ends - starts > LONGEST
        one, two = hashes(text, starts, np.where(long, starts, ends))
        coded = pa.array(one).dictionary_encode()
        which, distinct = np.asarray(coded.indices), coded.dictionary.to_pylist()
        if len(self.rows) > self.most:
            self.clear()
        rows = list(map(self.rows.get, distinct))
        example = np.empty(len(distinct), np.int64)
        example[which[::-1]] = np.arange(len(which))[::-1]
        for i, row in enumerate(rows):
            if row is None:
                j = example[i]
                rows[i] = self.add(distinct[i], two[j], [] if long[j] else tokens(text[starts[j] : ends[j]]))
        row = np.array(rows, np.int64)[which] if len(which) else np.zeros(0, np.int64)
        # Texts with a word beyond LONGEST, or with two words of one hash, go the plain way.
        odd = np.flatnonzero(long | (self.second[row] != two))
        bad = set((np.searchsorted(of, odd, "right") - 1).tolist())
        size = self.size[row]
        total = np.append(0, np.cumsum(size))
        flat = self.ids[np.repeat(self.at[row] - total[:-1], size) + np.arange(total[-1])]
        cuts = total[of]
        return [None if i in bad else flat[a:z] for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]
