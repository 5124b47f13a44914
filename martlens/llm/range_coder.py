"""Context-mixing range coder for token ids.

Order 1 predicts the latest two ids that followed the same id, order 2 the latest that
followed the same two ids. Order 0 predicts by adaptive histograms of the id's first
byte and of its second byte under the first. The orders are mixed into one
distribution, which a range coder is driven by: a predicted id has the odds that
predictions of its order, rank and count, with or without the consent of order 2, have
in the block, and the rest goes to order 0, which then codes the id byte by byte.

Blocks are independent: each begins with its odds, and model and coder start anew. So
blocks are coded in lockstep, one lane of numpy arrays to a block. The arithmetic is on
whole numbers alone, also where float32 holds them, so that any machine reads what
another wrote. Ids of more than 16 bits are coded in halves.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK_IDS = 2048
LANES = 1024  # most lanes of blocks of BLOCK_IDS; fewer if blocks are larger
CONTEXT_BITS = 11, 16  # remembered contexts of an order are one behind so many bits, as the block is large
LEVELS = 8  # counts of a prediction that are told apart; 0 is none
KINDS = 5 * LEVELS  # of predictions: two of order 1, where order 2 agrees or not, and one of order 2
BASE_BITS = 8  # weight of order 0 is a one behind so many bits
# Odds of a prediction, of 256 parts, that a block chooses from for each kind of prediction.
ODDS = np.array([0, 2, 4, 8, 16, 32, 64, 96, 128, 192, 256, 384, 768, 1536, 3072, 6144], np.uint64)
STEP, LIMIT = 48, 1 << 14  # growth of a count of a byte; sum at which counts are halved
FLATTEN = 150  # the first guess of an id's frequency is 1 / (id + FLATTEN)
HEAD = struct.Struct("<IIIBB")  # ids, bytes, CRC-32 of the ids, halves of an id, bits of a context

_U = np.uint64
_SETTLED, _LEAST = _U(1 << 48), _U(1 << 40)
_16, _48, _BASE = _U(16), _U(48), _U(BASE_BITS)
_ALL = _U((1 << 64) - 1)


_TOLD = np.flatnonzero(np.arange(KINDS) % LEVELS)  # kinds whose odds a block has
ODDS_BYTES = 18
_BORDERS = (ODDS[1:] + ODDS[:-1]).astype(np.int64)  # twice the middle of neighbours
# Sums of the 16 counts before each; they stay below 2 ** 24, where float32 is exact.
_BEFORE = np.triu(np.ones((16, 16), np.float32), 1)


def _next_levels() -> np.ndarray:
    """Levels of a context, both in one number, after its first, its second or another id came."""
    second, first = np.divmod(np.arange(LEVELS * LEVELS), LEVELS)
    up = lambda level: np.minimum(level + 1, LEVELS - 1)
    return np.concatenate([1 + LEVELS * first, up(second) + LEVELS * first, up(first) + LEVELS * second]) << 32


class Contexts:
    """What followed the latest ids in each of a run of blocks, all at the same position.

    A context has its latest id, for order 1 the one before that, and their levels in one number.
    """

    def __init__(self, lanes: int, bits: int) -> None:
        contexts = 1 << bits
        self.mask = contexts - 1
        self.table = np.zeros(2 * lanes * contexts, np.int64)
        self.one_of = np.arange(lanes) * contexts
        self.two_of = self.one_of + lanes * contexts
        self.one = self.two = np.zeros(lanes, np.int64)
        self.levels = _next_levels()

    def begin(self, n: int) -> None:
        """Look up the predictions for the next id of the first ``n`` lanes."""
        one, two = self.one[:n], self.two[:n]
        mixed = one * 40503
        self.at_one = (mixed >> 4 & self.mask) + self.one_of[:n]
        self.at_two = ((mixed + two * 30011) * 40507 >> 13 & self.mask) + self.two_of[:n]
        by_one, by_two = self.table.take(self.at_one), self.table.take(self.at_two)
        self.a, self.b, self.c = by_one & 65535, by_one >> 16 & 65535, by_two & 65535
        self.both = by_one >> 32
        self.third = by_two >> 32
        first, second = self.both & 7, self.both >> 3
        as_first, as_second = (self.c == self.a) & (first > 0), (self.c == self.b) & (second > 0)
        # Kinds of the predictions: level, and whether order 2 agrees; its own prediction counts if it does not.
        self.kinds = (
            first | as_first.view(np.int8) << 3, second | as_second.view(np.int8) << 3,
            np.where(as_first | as_second, 0, self.third),
        )

    def learn(self, ids: np.ndarray) -> None:
        hit = (ids == self.b).view(np.int8) | (ids == self.a).view(np.int8) << 1
        np.minimum(hit, 2, out=hit)
        levels = self.levels.take(self.both + (hit.astype(np.int64) << 6))
        other = np.where(hit == 2, self.b, self.a)
        self.table[self.at_one] = ids | other << 16 | levels
        level = np.where(ids == self.c, np.minimum(self.third + 1, LEVELS - 1), 1)
        self.table[self.at_two] = ids | level << 32
        self.two, self.one = self.one[: len(ids)], ids + 1


def _first_counts() -> tuple[np.ndarray, np.ndarray]:
    """Counts before any id is seen: of first bytes, and of second bytes under each first.

    Small ids are likelier. Every byte has a count of one at least.
    """
    mass = (1 << 24) // (np.arange(1 << 16) + FLATTEN)
    rows = mass.reshape(256, 256)
    first = 1 + rows.sum(axis=1) * 1024 // mass.sum()
    return first[None], 1 + rows * 128 // rows.sum(axis=1, keepdims=True)


class Bytes:
    """Rows of counts of bytes, and of their groups of 16 bytes; each lane has some rows."""

    def __init__(self, rows: np.ndarray, lanes: int) -> None:
        groups = rows.reshape(len(rows), 16, 16).sum(axis=2)
        self.counts = np.tile(rows.astype(np.int16), (lanes, 1)).reshape(-1, 16)
        self.groups = np.tile(groups.astype(np.int16), (lanes, 1))
        self.each = np.arange(lanes) * 16

    def begin(self, rows: np.ndarray) -> np.ndarray:
        """The sums of a row for each lane."""
        groups = self.groups.take(rows, axis=0).astype(np.float32)
        self.rows, self.before = rows, groups @ _BEFORE
        self.sums = (self.before[:, 15] + groups[:, 15]).astype(np.int64)
        return self.sums.view(_U)

    def interval(self, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of a byte in its row."""
        each, high, low = self.each[: len(byte)], byte >> 4, byte & 15
        self.group = self.rows * 16 + high
        within = self.counts.take(self.group, axis=0).astype(np.float32) @ _BEFORE
        return self._found(self.before.ravel().take(each + high), within.ravel().take(each + low), low)

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The byte that has a value below the sum, its start and its size."""
        each, value = self.each[: len(value)], value.astype(np.float32)
        high = _last(self.before, value)
        start = self.before.ravel().take(each + high)
        self.group = self.rows * 16 + high
        within = self.counts.take(self.group, axis=0).astype(np.float32) @ _BEFORE
        low = _last(within, value - start)
        return high << 4 | low, *self._found(start, within.ravel().take(each + low), low)

    def _found(self, start: np.ndarray, more: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.place = self.group * 16 + low
        size = self.counts.ravel().take(self.place).astype(_U)
        return (start + more).astype(np.int64).view(_U), size

    def learn(self, growth: np.ndarray) -> None:
        """Let the counts of the bytes grow; where they do, large counts are halved."""
        self.counts.ravel()[self.place] += growth
        self.groups.ravel()[self.group] += growth
        large = self.rows[(self.sums > LIMIT) & (growth > 0)]
        if len(large):
            rows = (self.counts.reshape(-1, 256)[large] + 1) >> 1
            self.counts.reshape(-1, 256)[large] = rows
            self.groups[large] = rows.reshape(-1, 16, 16).sum(axis=2)


def _last(starts: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The last of 16 rising starts that is not above the value."""
    below = np.bitwise_count((starts <= value[:, None]).view(_U))
    return (below[:, 0] + below[:, 1]).astype(np.int64) - 1


def _settle(low: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lanes and 16-bit words that are settled, until all widths are large enough.

    Where the interval is small but its ends still differ in their first word,
    it is cut back so that no carry can ever reach a word that is out.
    """
    go: np.ndarray | slice = slice(None)
    while True:
        a, w = low[go], width[go]
        settled = (a ^ (a + w)) < _SETTLED
        ready = np.flatnonzero(settled | (w < _LEAST))
        if not len(ready):
            return
        a, w, cut = a[ready], w[ready], ~settled[ready]
        go = ready if isinstance(go, slice) else go[ready]
        if cut.any():
            w = np.where(cut, (~a + _U(1)) & (_LEAST - _U(1)), w)
        yield go, a >> _48
        low[go], width[go] = a << _16, w << _16


def _lanes(block_ids: int) -> int:
    return max(1, LANES * BLOCK_IDS // max(block_ids, BLOCK_IDS))


def encode_blocks(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> list[bytes]:
    """Blocks with heads for all ids, in order; ids are unsigned 32-bit integers."""
    ids = np.ascontiguousarray(ids, "<u4")
    n_blocks = -(-len(ids) // block_ids)
    runs = -(-n_blocks // _lanes(block_ids))
    blocks: list[bytes] = []
    for run in range(runs):
        first, last = n_blocks * run // runs, n_blocks * (run + 1) // runs
        blocks += _encode_lanes(ids[first * block_ids : last * block_ids], block_ids)
    return blocks


def _encode_lanes(ids: np.ndarray, size: int) -> list[bytes]:
    lanes = -(-len(ids) // size)
    halves = 1 if int(ids.max(initial=0)) < 1 << 16 else 2
    units = ids.astype(np.uint16) if halves == 1 else ids.view("<u2")
    size *= halves
    last = len(units) - size * (lanes - 1)
    table = np.zeros(lanes * size, np.uint16)
    table[: len(units)] = units
    by_lane = table.reshape(lanes, size)
    table = np.ascontiguousarray(by_lane.T)
    bits = min(max(CONTEXT_BITS[0], (size - 1).bit_length()), CONTEXT_BITS[1])
    kinds = _predictions(table, lanes, last, bits)
    odds = _odds(kinds, last)
    weights = ODDS[odds].ravel()
    firsts, seconds = (Bytes(rows, lanes) for rows in _first_counts())
    all_low, all_width = np.zeros(lanes, _U), np.full(lanes, _ALL)
    out, filled = np.zeros((lanes, size // 2 + 64), "<u2"), np.zeros(lanes, np.int64)
    lane_of, kind_of, row_of = np.arange(lanes), np.arange(lanes) * KINDS, np.arange(lanes) * 256
    for place in range(size):
        n = lanes if place < last else lanes - 1
        low, width, at, kind = all_low[:n], all_width[:n], kind_of[:n], kinds[place, :n]
        values = table[place, :n].astype(np.int64)
        came = kind >> 11
        rest = came == 0
        total = firsts.begin(lane_of[:n])
        to_a = weights.take(at + (kind & 15)) * total
        to_b = to_a + weights.take(at + 16 + (kind >> 4 & 15)) * total
        to_c = to_b + weights.take(at + 32 + (kind >> 8 & 7)) * total
        start, part = firsts.interval(values >> 8)
        start = np.where(rest, to_c + (start << _BASE), np.where(came == 1, 0, np.where(came == 2, to_a, to_b)))
        part = np.where(rest, part << _BASE, np.where(came == 1, to_a, np.where(came == 2, to_b - to_a, to_c - to_b)))
        unit = width // (to_c + (total << _BASE))
        low += start * unit
        np.multiply(part, unit, out=width)
        for lane, word in _settle(low, width):
            out[lane, filled[lane]] = word
            filled[lane] += 1
        growth = np.where(rest, STEP, 0).astype(np.int16)
        firsts.learn(growth)
        total = seconds.begin(row_of[:n] + (values >> 8))
        start, part = seconds.interval(values & 255)
        unit = np.where(rest, width // total, width)
        low += np.where(rest, start, 0) * unit
        np.multiply(np.where(rest, part, 1), unit, out=width)
        for lane, word in _settle(low, width):
            out[lane, filled[lane]] = word
            filled[lane] += 1
        seconds.learn(growth)
        if place % 8 == 0 and filled.max() + 64 > out.shape[1]:
            out = np.hstack([out, np.zeros_like(out)])
    told = np.hstack([odds[:, _TOLD], np.zeros((lanes, 1), np.int64)])
    told = (told[:, ::2] << 4 | told[:, 1::2]).astype(np.uint8)
    blocks = []
    # One word more tells the interval from others, or two.
    ends = (all_low + (_SETTLED - _U(1))) >> _48
    short = (ends << _48) - all_low < all_width
    ends = np.where(short, ends, (all_low + _U((1 << 32) - 1)) >> _U(32)).tolist()
    for lane in range(lanes):
        part = ids[lane * size // halves : (lane + 1) * size // halves]
        end = (ends[lane],) if short[lane] else divmod(ends[lane], 1 << 16)
        data = told[lane].tobytes() + out[lane, : filled[lane]].tobytes() + np.array(end, "<u2").tobytes()
        blocks.append(HEAD.pack(len(part), len(data), zlib.crc32(part.tobytes()), halves, bits) + data)
    return blocks


def _predictions(table: np.ndarray, lanes: int, last: int, bits: int) -> np.ndarray:
    """By position and lane: kinds of the three predictions, and which one came (0: none)."""
    model = Contexts(lanes, bits)
    kinds = np.zeros(table.shape, np.uint16)
    for place, values in enumerate(table.astype(np.int64)):
        n = lanes if place < last else lanes - 1
        ids = values[:n]
        model.begin(n)
        a, b, c = model.kinds
        came = np.where(
            (ids == model.a) & (a & 7 > 0), 1 << 11,
            np.where((ids == model.b) & (b & 7 > 0), 2 << 11, np.where((ids == model.c) & (c > 0), 3 << 11, 0)),
        )
        kinds[place, :n] = a | b << 4 | c << 8 | came
        model.learn(ids)
    return kinds


def _odds(kinds: np.ndarray, last: int) -> np.ndarray:
    """For every lane and kind of prediction, the place in ODDS of what it earned in the block."""
    size, lanes = kinds.shape
    odds = np.zeros((lanes, KINDS), np.int64)
    for lane, column in enumerate(np.ascontiguousarray(kinds.T)):
        found = np.bincount(column[: size if lane < lanes - 1 else last], minlength=1 << 13).reshape(4, 8, 256)
        of_c, of_ab = found.sum(axis=2), found.sum(axis=1).reshape(4, 16, 16)
        of_a, of_b = of_ab.sum(axis=1), of_ab.sum(axis=2)
        hits = np.concatenate([of_a[1], of_b[2], of_c[3]])
        none = np.concatenate([of_a[0], of_b[0], of_c[0]])
        # A prediction that came true has odds, however small.
        near = np.searchsorted(_BORDERS, 1024 * hits // (2 * none + 1), "right")
        odds[lane] = np.where(hits > 0, np.maximum(near, 1), 0)
    odds[:, ::LEVELS] = 0  # there is no prediction
    return odds


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """Ids of blocks as written by :func:`encode_blocks`; checks every block."""
    heads = [HEAD.unpack_from(b) for b in blocks]
    out, first = [], 0
    while first < len(blocks):
        # Lanes of a run get no longer, and have as many halves and contexts.
        last, most = first + 1, _lanes(heads[first][0])
        while (
            last < min(first + most, len(blocks))
            and heads[last][0] <= heads[last - 1][0] and heads[last][3:] == heads[first][3:]
        ):
            last += 1
        out.append(_decode_lanes(blocks[first:last], heads[first:last]))
        first = last
    return np.concatenate(out) if out else np.array([], "<u4")


def _decode_lanes(blocks: list[bytes], heads: list[tuple]) -> np.ndarray:
    lanes, halves = len(blocks), heads[0][3]
    lengths = np.array([h[0] * halves for h in heads])
    size = int(lengths[0])
    odds, codes = [], []
    for block, head in zip(blocks, heads):
        body = block[HEAD.size : HEAD.size + head[1]]
        odds.append(np.frombuffer(body, np.uint8, ODDS_BYTES))
        codes.append(np.frombuffer(body, "<u2", offset=ODDS_BYTES))
    packed = np.stack(odds)
    weights = np.zeros((lanes, KINDS), _U)
    weights[:, _TOLD] = ODDS[np.stack([packed >> 4, packed & 15], axis=2).reshape(lanes, -1)[:, :-1]]
    weights = weights.ravel()
    lane_of, kind_of, row_of = np.arange(lanes), np.arange(lanes) * KINDS, np.arange(lanes) * 256
    # Beyond its end a lane reads zeros.
    longest = max(map(len, codes)) + 8
    data = np.zeros((lanes, longest), _U)
    for lane, code in enumerate(codes):
        data[lane, : len(code)] = code
    data = data.ravel()
    read = np.arange(lanes) * longest
    all_code = np.zeros(lanes, _U)
    for _ in range(4):
        all_code = all_code << _16 | data[read]
        read += 1
    all_low, all_width = np.zeros(lanes, _U), np.full(lanes, _ALL)
    model = Contexts(lanes, heads[0][4])
    firsts, seconds = (Bytes(rows, lanes) for rows in _first_counts())
    ids = np.zeros((size, lanes), "<u2")
    n = lanes
    for place in range(size):
        while lengths[n - 1] <= place:
            n -= 1
        low, width, code, at = all_low[:n], all_width[:n], all_code[:n], kind_of[:n]
        model.begin(n)
        a, b, c = model.kinds
        total = firsts.begin(lane_of[:n])
        to_a = weights.take(at + a) * total
        to_b = to_a + weights.take(at + 16 + b) * total
        to_c = to_b + weights.take(at + 32 + c) * total
        everything = to_c + (total << _BASE)
        unit = width // everything
        value = np.minimum((code - low) // unit, everything - _U(1))
        rest, past_a, past_b = value >= to_c, value >= to_a, value >= to_b
        byte, start, part = firsts.find(np.where(rest, (value - to_c) >> _BASE, 0))
        start = np.where(rest, to_c + (start << _BASE), np.where(past_b, to_b, np.where(past_a, to_a, 0)))
        part = np.where(rest, part << _BASE, np.where(past_b, to_c - to_b, np.where(past_a, to_b - to_a, to_a)))
        low += start * unit
        np.multiply(part, unit, out=width)
        for lane, _ in _settle(low, width):
            code[lane] = code[lane] << _16 | data.take(read[lane], mode="clip")
            read[lane] += 1
        growth = np.where(rest, STEP, 0).astype(np.int16)
        firsts.learn(growth)
        total = seconds.begin(row_of[:n] + byte)
        unit = np.where(rest, width // total, width)
        value = np.where(rest, np.minimum((code - low) // unit, total - _U(1)), 0)
        second, start, part = seconds.find(value)
        low += np.where(rest, start, 0) * unit
        np.multiply(np.where(rest, part, 1), unit, out=width)
        for lane, _ in _settle(low, width):
            code[lane] = code[lane] << _16 | data.take(read[lane], mode="clip")
            read[lane] += 1
        seconds.learn(growth)
        values = np.where(rest, byte << 8 | second, np.where(past_b, model.c, np.where(past_a, model.b, model.a)))
        model.learn(values)
        ids[place, :n] = values
    ids, parts = np.ascontiguousarray(ids.T), []
    for lane, head in enumerate(heads):
        units = ids[lane, : lengths[lane]]
        part = units.astype("<u4") if halves == 1 else units.view("<u4")
        if zlib.crc32(part.tobytes()) != head[2]:
            raise ValueError(f"block {lane} is damaged")
        parts.append(part)
    return np.concatenate(parts)
