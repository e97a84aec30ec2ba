"""Counting quotient filters over permuted keys, without loss.

A key of ``bits`` bits is permuted invertibly, so that keys spread evenly
whatever they are. Its leading bits, the quotient, are not stored: they are
the rank of the key's run in a bit vector. The rest, the whole remainder, is
stored, so nothing is lost and permuting back gives the key. A count above
one lies in counter slots after its remainder.

A filter is built from sorted keys in one go and read in sorted order, which
is how filters are merged; ``count`` looks a single key up.
"""

from __future__ import annotations

import struct
from typing import Iterable, Iterator, List, Tuple

import numpy as np

U64 = np.uint64
_HEAD = struct.Struct("<BBBBqq")
#: Odd constants of the mixing rounds, one a round.
ROUNDS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


def _mask(bits: int) -> np.uint64:
    return U64((1 << bits) - 1)


def _mix(x: np.ndarray, constant: int) -> np.ndarray:
    x = (x + U64(constant & 0xFFFF)) * U64(constant)
    x ^= x >> U64(29)
    x *= U64(ROUNDS[2])
    return x ^ (x >> U64(32))


class Permutation:
    """An invertible map of pairs (high, low) of ``bits`` bits together, by
    rounds that add a function of one half to the other. Each half has up to
    64 bits."""

    def __init__(self, bits: int):
        self.low_bits = bits // 2
        self.high_bits = bits - self.low_bits
        self.low, self.high = _mask(self.low_bits), _mask(self.high_bits)

    def forward(self, high: np.ndarray, low: np.ndarray) -> Tuple[np.ndarray, np.ndarray]:
        for i, c in enumerate(ROUNDS):
            if i % 2:
                low = (low + _mix(high, c)) & self.low
            else:
                high = (high + _mix(low, c)) & self.high
        return high, low

    def back(self, high: np.ndarray, low: np.ndarray) -> Tuple[np.ndarray, np.ndarray]:
        for i, c in reversed(list(enumerate(ROUNDS))):
            if i % 2:
                low = (low - _mix(high, c)) & self.low
            else:
                high = (high - _mix(low, c)) & self.high
        return high, low


def added_up(keys: np.ndarray, counts: np.ndarray) -> Tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _set_bits(places: np.ndarray, n: int) -> bytes:
    flags = np.zeros(n, dtype=bool)
    flags[places] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").view(bool)


def _narrow(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, little-endian."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(U64)


def build(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of sorted distinct keys of at most 64 bits, with counts of
    one or more.

    Layout: header, occupied quotients (one bit each), ends of runs and
    counter marks (one bit a slot each), slots. Slots are whole bytes, so the
    quotient has the most bits, up to one above those of the number of keys,
    that leave a remainder of whole bytes."""
    n = len(keys)
    most = min(bits - 1, max(n, 1).bit_length())
    quotient = max([q for q in range(most + 1) if (bits - q) % 8 == 0], default=0)
    width = -(-(bits - quotient) // 8)
    slot_bits = 8 * width
    rest = U64(bits - quotient)
    q = (keys >> rest) if bits - quotient < 64 else np.zeros(n, U64)
    more = (counts - 1).astype(U64)
    digits: List[Tuple[np.ndarray, np.ndarray]] = []
    extra = np.zeros(n, dtype=np.int64)
    while True:
        at = np.flatnonzero(more)
        if not len(at):
            break
        digits.append((at, more[at] & _mask(slot_bits)))
        extra[at] += 1
        more = more >> U64(slot_bits) if slot_bits < 64 else np.zeros(n, U64)
    last = np.cumsum(extra + 1)
    start = last - extra - 1
    slots = np.zeros(int(last[-1]) if n else 0, dtype=U64)
    slots[start] = keys & _mask(bits - quotient)
    counters = []
    for i, (at, digit) in enumerate(digits):
        slots[start[at] + 1 + i] = digit
        counters.append(start[at] + 1 + i)
    run_end = np.append(q[1:] != q[:-1], True) if n else np.zeros(0, bool)
    marks = np.concatenate(counters) if counters else np.zeros(0, np.int64)
    head = _HEAD.pack(bits, quotient, width, 0, n, len(slots))
    return b"".join([head, _set_bits(q.astype(np.int64), 1 << quotient), _set_bits(last[run_end] - 1, len(slots)),
                     _set_bits(marks, len(slots)), _narrow(slots, width)])


def _parts(data: bytes):
    bits, quotient, width, _, n, n_slots = _HEAD.unpack_from(data)
    at = _HEAD.size
    out = []
    for size in (1 << quotient, n_slots, n_slots):
        out.append(_bits(data[at:at + -(-size // 8)], size))
        at += -(-size // 8)
    return bits, quotient, width, n, out, data[at:at + n_slots * width]


def read(data: bytes) -> Tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts) of a filter."""
    bits, quotient, width, n, (occupied, run_end, counter), slots = _parts(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    values = _wide(slots, width)
    start = np.flatnonzero(~counter)
    run = np.cumsum(run_end) - run_end
    keys = values[start]
    if quotient:
        keys = keys | (np.flatnonzero(occupied)[run[start]].astype(U64) << U64(bits - quotient))
    counts = np.ones(n, dtype=np.int64)
    digits = np.append(start[1:], len(values)) - start - 1
    for i in range(int(digits.max())):
        has = np.flatnonzero(digits > i)
        counts[has] += (values[start[has] + 1 + i] << U64(8 * width * i)).astype(np.int64)
    return keys, counts


def count(data: bytes, key: int) -> int:
    """The count of one key: its run by rank and select, then its remainder."""
    bits, quotient, width, n, (occupied, run_end, counter), slots = _parts(data)
    q = key >> (bits - quotient)
    if not n or not occupied[q]:
        return 0
    rank = int(occupied[:q].sum())
    ends = np.flatnonzero(run_end)
    lo, hi = (int(ends[rank - 1]) + 1 if rank else 0), int(ends[rank]) + 1
    run = _wide(slots[lo * width:hi * width], width)
    hit = np.flatnonzero((run == U64(key & ((1 << (bits - quotient)) - 1))) & ~counter[lo:hi])
    if not len(hit):
        return 0
    total, i = 1, int(hit[0]) + 1
    shift = 0
    while i < len(run) and counter[lo + i]:
        total += int(run[i]) << shift
        shift, i = shift + 8 * width, i + 1
    return total


def _in_pieces(parts: List[Tuple[np.ndarray, np.ndarray]], piece: int) -> Iterator[Tuple[np.ndarray, np.ndarray]]:
    """The sum of sorted (keys, counts), one range of the keys after the
    other: about ``piece`` entries are copied and sorted at once."""
    n = sum(len(k) for k, _ in parts) // piece + 1
    longest = max((k for k, _ in parts), key=len)
    edges = longest[np.arange(1, n) * len(longest) // n]
    cuts = [np.concatenate([[0], np.searchsorted(k, edges), [len(k)]]) for k, _ in parts]
    for i in range(n):
        yield added_up(np.concatenate([k[c[i]:c[i + 1]] for (k, _), c in zip(parts, cuts)]),
                       np.concatenate([x[c[i]:c[i + 1]] for (_, x), c in zip(parts, cuts)]))


class Merger:
    """Adds filters of one range up. What is held is the sum so far and at
    most ``waiting`` entries, or as many as the sum has, not yet added to it;
    little more is needed to add them or to go through the total in pieces."""

    def __init__(self, waiting: int = 1 << 20, piece: int = 1 << 18):
        self.waiting, self.piece, self.held, self.size = waiting, piece, [], 0
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys) + self.size

    def add(self, data: bytes) -> None:
        part = read(data)
        self.held.append(part)
        self.size += len(part[0])
        if self.size >= max(self.waiting, len(self.keys)):
            self._settle()

    def pieces(self) -> Iterator[Tuple[np.ndarray, np.ndarray]]:
        """The total, one range of the sorted keys after the other."""
        return _in_pieces([(self.keys, self.counts), *self.held], self.piece)

    def _settle(self) -> None:
        found = list(self.pieces())
        self.held, self.size, self.keys, self.counts = [], 0, None, None
        self.keys, self.counts = np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])

    def total(self) -> Tuple[np.ndarray, np.ndarray]:
        if self.held:
            self._settle()
        return self.keys, self.counts


def split(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray, bits: int, more: int) -> Iterator[Tuple[int, bytes]]:
    """(longer shard, filter) of entries sorted by shard and key: the first
    ``more`` of the ``bits`` bits of a key move to its shard."""
    if more:
        rest = U64(bits - more)
        shard = (shard << U64(more)) | (keys >> rest)
        keys = keys & _mask(bits - more)
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts, np.append(cuts[1:], len(shard))):
        yield int(shard[lo]), build(keys[lo:hi], counts[lo:hi], bits - more)


def merged(filters: Iterable[bytes]) -> Tuple[np.ndarray, np.ndarray]:
    """Sorted keys of several filters of one range, counts added up."""
    m = Merger()
    for f in filters:
        m.add(f)
    return m.total()
