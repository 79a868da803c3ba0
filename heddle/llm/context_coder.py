"""Adaptive context-mixing range coder for token ids, many blocks at a time.

A block of ids is coded on its own: all state starts anew and the payload has a checksum.  The blocks of a file are coded
in step, one id of each, so that numpy works on whole columns of blocks.

Four predictions of the next id are mixed, as probabilities, in proportion to weights that adapt:

- order 2: the id that followed the last two ids (hashed) when the block last had them;
- order 1, recent: the same of the last id alone;
- order 1, counted: a frequency table of the ids that often follow the last id;
- order 0: a frequency table of all ids, whose ranges grow and shrink with what the block has had.

Weights belong to a state: how often in a row either recent prediction has come true, whether both agree, and whether there
is a counted table.  After every id each weight moves towards the share that its prediction had in the probability of the
id.  A file's header holds the two tables and the weights from which every block starts.  All arithmetic of the coding is on
integers, so that encoder and decoder agree on every machine.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U = np.uint64
SLOTS = 1024  # recent contexts of a block, for either order
SURE = 3  # highest count of hits in a row
STATES = (SURE + 1) * (SURE + 2) * 2
ZERO, ONE = 1 << 16, 512  # total weights of the tables of order 0 and order 1
ROW = 127  # ids of a table of order 1
GROUPS, UNITS = 16, 256  # ranges of order 0, and what they weigh together
SPAN = 12
WIDE = 1 << SPAN  # ZERO // GROUPS
P_BITS = 20  # probabilities; WIDE * UNITS is their total
TO_P = P_BITS - 9  # from weights of an order-1 table
W_BITS = 11  # weights of predictions as they are used
BITS = P_BITS + W_BITS  # a mixture's total, so that 32 bits hold it
FINE = 16  # bits of weights as they are learnt
LOW, DIGIT = U(47), U(16)
RATE = 5
LEAST = 384
FITTED = 64  # blocks of a file by which first weights are chosen
INNER = (1 << 13) - 1  # a weight inside a range
# What a slot holds: the id it last had, hits in a row, weight and begin of the id in its order-1 table, and the context's last id.
HITS, WEIGHT, BEGIN, CONTEXT = 16, 18, 28, 38


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """Weights in proportion to the counts, 1 at least, that sum up to total; no more counts than total."""
    w = np.maximum(1, counts * (total - len(counts)) // max(1, int(counts.sum())) + 1)
    w[int(np.argmax(counts))] += total - int(w.sum())
    return w


class Tables:
    """Frequencies of order 0 and order 1 of the ids of a file, and the weights that its blocks start from."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, contexts: np.ndarray, sizes: np.ndarray, after: np.ndarray, after_weights: np.ndarray, mix: np.ndarray):
        self.parts = (ids, weights, contexts, sizes, after, after_weights)
        self.mix = mix
        # Order 0: an id lies in one range; per id its weight there, the weights before it, and the range, in 13, 13 and 4 bits.
        self.range_of = np.minimum((np.cumsum(weights) - weights) >> SPAN, GROUPS - 1)
        inner = weights.copy()
        self.units = np.ones(GROUPS, dtype=np.int64)
        for g in range(GROUPS):
            mine = self.range_of == g
            if mine.any():
                self.units[g] += int(weights[mine].sum()) * (UNITS - GROUPS) // ZERO
                inner[mine] = shares(weights[mine], WIDE)
        self.units[int(np.argmax(self.units))] += UNITS - int(self.units.sum())
        total = np.cumsum(inner)
        begin = total - inner - self.range_of_first(total - inner)
        self.zero = np.zeros(1 << 16, dtype=np.int32)
        self.zero[ids] = inner | begin << 13 | self.range_of << 26
        self.symbol = np.zeros(ZERO, dtype=np.int64)
        self.symbol[np.repeat(self.range_of * WIDE + begin, inner) + np.arange(int(inner.sum())) - np.repeat(total - inner, inner)] = np.repeat(ids, inner)
        # Order 1: row 0 is for ids without a table.
        self.row = np.zeros(1 << 16, dtype=np.int64)
        self.row[contexts] = np.arange(1, len(contexts) + 1)
        self.size = np.concatenate([[0], sizes]).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes) - sizes]).astype(np.int64)
        self.pairs = (np.repeat(contexts, sizes) << 16) | after  # sorted
        self.search = int(self.size.max()).bit_length()
        pad = np.zeros(1 << self.search, dtype=np.int64)  # a search looks at places past the end, and keeps off them
        self.after = np.concatenate([after, pad])
        self.slots = np.concatenate([[0], np.cumsum(after_weights)]).astype(np.int64)  # before each pair, over all rows
        self.pair_weight = np.concatenate([after_weights, pad])
        # per pair its begin in the row, and its id's begin and range of order 0, in 9, 13 and 4 bits
        self.pair = np.concatenate([self.slots[:-1] % ONE, pad]) << 17 | self.zero[self.after] >> 13
        self.pair = self.pair.astype(np.int32)
        self.entry = self.after | self.pair_weight << WEIGHT | (self.pair >> 17).astype(np.int64) << BEGIN  # as slots hold it

    def range_of_first(self, before: np.ndarray) -> np.ndarray:
        """Per id the weights before the first id of its range."""
        first = np.zeros(GROUPS, dtype=np.int64)
        some, at = np.unique(self.range_of, return_index=True)
        first[some] = before[at]
        return first[self.range_of]

    @classmethod
    def of(cls, x: np.ndarray, length: int, least: int = 3, context_least: int = 24) -> Tables:
        """Tables of the ids of a file: successors seen least times, of ids seen context_least times; blocks start after id 0."""
        blocks = x.reshape(-1, length)
        counts = np.bincount(x, minlength=1 << 16)
        ids = np.flatnonzero(counts)
        pairs = np.zeros(len(x), dtype=np.uint32)
        pairs[1:] = x[:-1]
        pairs[::length] = 0
        pairs <<= 16
        pairs |= x.astype(np.uint16)
        pairs, n = np.unique(pairs, return_counts=True)
        pairs = pairs.astype(np.int64)
        keep = (n >= least) & (counts[pairs >> 16] >= context_least)
        pairs, n = pairs[keep], n[keep]
        # The ROW most frequent of each context, with weights as shares() gives them.
        sizes = np.unique(pairs >> 16, return_counts=True)[1]
        order = np.lexsort((-n, pairs >> 16))
        best = np.zeros(len(pairs), dtype=bool)
        best[order[np.arange(len(pairs)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < ROW]] = True
        pairs, n = pairs[best], n[best]
        contexts, first, sizes = np.unique(pairs >> 16, return_index=True, return_counts=True)
        w = n
        if len(n):
            w = np.maximum(1, n * np.repeat(ONE - sizes, sizes) // np.repeat(np.add.reduceat(n, first), sizes) + 1)
            top = np.lexsort((-n, pairs >> 16))[first]
            w[top] += ONE - np.add.reduceat(w, first)
        mix = np.full((3, STATES), 1 << FINE - 2, dtype=np.int64)
        none = np.zeros(0, dtype=np.int64)
        tables = cls(ids, shares(counts[ids], ZERO) if len(ids) else none, contexts, sizes, pairs & 0xFFFF, w, mix)
        if len(blocks):
            tables.mix = first_weights(blocks[:: max(1, len(blocks) // FITTED)], tables)
        return tables

    def likely(self, x: np.ndarray) -> np.ndarray:
        """First probabilities of ids by order 0."""
        return (self.zero[x] & (1 << 13) - 1) * self.units[self.zero[x] >> 26] / (1 << P_BITS)

    def to_bytes(self) -> bytes:
        ids, weights, contexts, sizes, after, after_weights = self.parts
        step = np.diff(after, prepend=0)
        first = np.cumsum(sizes) - sizes
        step[first] = after[first]  # ids of a context are sorted
        sent = [np.diff(ids, prepend=0), weights - 1, np.diff(contexts, prepend=0), sizes, step, after_weights - 1, self.mix.reshape(-1)]
        # low and high bytes apart: the high ones are mostly 0
        planes = b"".join((a & 255).astype(np.uint8).tobytes() + (a >> 8).astype(np.uint8).tobytes() for a in sent)
        body = zlib.compress(planes, 9)
        return struct.pack("<4I", len(ids), len(contexts), len(after), len(body)) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[Tables, int]:
        """The tables at the start of data, and the bytes that they take."""
        n0, n1, n2, size = struct.unpack("<4I", data[:16])
        planes = np.frombuffer(zlib.decompress(data[16 : 16 + size]), dtype=np.uint8).astype(np.int64)
        out, at = [], 0
        for n in (n0, n0, n1, n1, n2, n2, 3 * STATES):
            out.append(planes[at : at + n] | (planes[at + n : at + 2 * n] << 8))
            at += 2 * n
        ids, weights, contexts, sizes, step, after_weights, mix = out
        total = np.cumsum(step)
        first = np.cumsum(sizes) - sizes
        after = total - np.repeat(total[first] - step[first], sizes) if n2 else step
        return cls(np.cumsum(ids), weights + 1, np.cumsum(contexts), sizes, after, after_weights + 1, mix.reshape(3, STATES)), 16 + size


def state_of(sure_two: np.ndarray, sure_one: np.ndarray, agree: np.ndarray, has: np.ndarray) -> np.ndarray:
    return (sure_two * (SURE + 2) + sure_one * ~agree + (SURE + 1) * agree) * 2 + has


def first_weights(blocks: np.ndarray, tables: Tables) -> np.ndarray:
    """Weights by state under which the blocks' ids are likely, after a few rounds of expectation and maximisation."""
    x, two, one, sure_two, sure_one, has, _, weight = (a.astype(np.int64).reshape(-1) for a in prepared(blocks, tables))
    agree = (two == one) & (sure_two > 0) & (sure_one > 0)
    state = state_of(sure_two, sure_one, agree, has)
    p = np.array([(x == two) & (sure_two > 0), (x == one) & (sure_one > 0) & ~agree, weight / ONE, tables.likely(x)])
    n = np.maximum(1, np.bincount(state, minlength=STATES))
    w = np.full((4, STATES), 0.25)
    for _ in range(6):
        part = w[:, state] * p
        part /= part.sum(axis=0)
        w = np.array([np.bincount(state, weights=part[j], minlength=STATES) + 1 for j in range(4)]) / (n + 4)
    return np.clip((w[:3] * (1 << FINE)).astype(np.int64), LEAST, (1 << FINE) - 1)


class Mixer:
    """Weights of the predictions and ranges of order 0, in n blocks; everything of a step is a column over the blocks.

    The interval of a step begins with the id of order 2, then that of order 1, if these are predictions; what the other
    orders give them is in these parts too.  All other ids follow by number.
    """

    def __init__(self, n: int, tables: Tables):
        self.n, self.tables = n, tables
        self.lane = np.arange(n)
        self.base = self.lane * STATES
        w = tables.mix
        self.weights = np.tile(w[0] | w[1] << FINE | w[2] << 2 * FINE, n)
        # By range and block: units of the range (1 to 241), and of those before it.
        units = tables.units.astype(np.uint8)
        self.units, self.before_units = np.repeat(units, n), np.repeat(np.cumsum(units, dtype=np.uint8) - units, n)
        self.ranges = np.arange(GROUPS, dtype=np.uint8)[:, None]
        self.seen_two, self.seen_one = np.zeros(n * SLOTS, dtype=np.int64), np.zeros(n * SLOTS, dtype=np.int64)
        self.before = self.earlier = np.zeros(n, dtype=np.int64)

    def zero_share(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of ids in order 0, of 2 ** P_BITS."""
        z = self.tables.zero[x]
        at = (z >> 26) * self.n + self.lane
        z = z.view(np.uint32)
        units = self.units[at].astype(np.uint32)
        return (self.before_units[at].astype(np.uint32) << SPAN) + units * (z >> 13 & INNER), units * (z & INNER)

    def guess(self, seen: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What slots hold of this context, 0 if it is another's; and its hits in a row."""
        held = seen[at]
        held *= held >> CONTEXT == self.before
        return held, held >> HITS & SURE

    def share(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id of a slot; its begin and width in the mixture of orders 1 (counted) and 0."""
        x = held & 0xFFFF
        begin, width = self.zero_share(x)
        return x, (held >> BEGIN & 2 * ONE - 1).astype(np.uint32) * self.e_table + self.e_zero * begin, (held >> WEIGHT & 2 * ONE - 1).astype(np.uint32) * self.e_table + self.e_zero * width

    def begin(self, has: np.ndarray) -> None:
        """The predictions of a step and their weights."""
        # A slot's blocks lie side by side, so that those of common contexts stay in the processor's cache.
        self.at_two, self.at_one = slot(self.before, self.earlier) * self.n + self.lane, slot(self.before, 0) * self.n + self.lane
        two, sure_two = self.guess(self.seen_two, self.at_two)
        one, sure_one = self.guess(self.seen_one, self.at_one)
        can_two, can_one = sure_two > 0, sure_one > 0
        agree = ((two ^ one) & 0xFFFF == 0) & can_two & can_one
        can_one &= ~agree
        self.held_two, self.held_one = two, one
        self.at = self.base + state_of(sure_two, sure_one, agree, has)
        w = self.weights[self.at]
        self.w = [(w >> k * FINE & 0xFFFF).astype(np.int32) for k in range(3)]
        e_two, e_one, e_table = ((x * 2000 >> FINE).astype(np.uint32) for x in self.w)
        e_two *= can_two
        e_one *= can_one
        e_table *= has.astype(bool)
        self.e_zero = (1 << W_BITS) - e_two - e_one - e_table
        self.e_two, self.e_one, self.e_table = e_two << P_BITS, e_one << P_BITS, e_table << TO_P
        self.can_two, self.can_one = can_two, can_one
        self.two, self.two_begin, self.two_rest = self.share(two)
        self.one, self.one_begin, self.one_rest = self.share(one)
        self.two_rest *= can_two
        self.one_rest *= can_one
        self.two_width, self.one_width = self.two_rest + self.e_two, self.one_rest + self.e_one
        self.singles = self.two_width + self.one_width

    def interval(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of an id, given as slots hold it, under the mixture, of 2 ** BITS."""
        x, begin, width = self.share(held)
        self.x = x
        self.is_two, self.is_one = (x == self.two) & self.can_two, (x == self.one) & self.can_one
        left = self.singles + begin - self.two_rest * (x > self.two) - self.one_rest * (x > self.one)
        left *= ~(self.is_two | self.is_one)
        left += self.two_width * self.is_one
        self.width = width + self.e_two * self.is_two + self.e_one * self.is_one
        return left, self.width

    def learn(self, step: int, held: np.ndarray) -> None:
        """Moves the weights, the ranges and the slots after an id, given as slots hold it."""
        scale = np.float32((1 << FINE) - 1) / self.width.astype(np.float32)
        parts = self.e_two * self.is_two, self.e_one * self.is_one, (held >> WEIGHT & 2 * ONE - 1).astype(np.uint32) * self.e_table
        moved = [np.maximum(LEAST, w + ((part.astype(np.float32) * scale).astype(np.int32) - w >> RATE)).astype(np.int64) for w, part in zip(self.w, parts)]
        self.weights[self.at] = moved[0] | moved[1] << FINE | moved[2] << 2 * FINE
        # The range of the id takes a unit from one of the others, each of which gives in turn.
        n, giver = self.n, step % GROUPS
        taker = self.tables.zero[self.x] >> 26
        units, before = self.units.reshape(GROUPS, n), self.before_units.reshape(GROUPS, n)
        moved = ((units[giver] > 1) & (taker != giver)).view(np.uint8)
        units[giver] -= moved
        self.units[taker * n + self.lane] += moved
        before[giver + 1 :] -= moved
        before += (self.ranges > taker.astype(np.uint8)).view(np.uint8) * moved
        for seen, at, old in ((self.seen_two, self.at_two, self.held_two), (self.seen_one, self.at_one, self.held_one)):
            sure = old >> HITS & SURE
            again = (sure > 0) & ((old ^ held) & 0xFFFF == 0)
            seen[at] = held | np.minimum(sure, SURE - 1) * again + 1 << HITS
        self.earlier, self.before = self.before, self.x

    def find(self, s: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The id whose interval holds s, as slots hold it."""
        held = np.where(s < self.two_width, self.held_two, self.held_one)
        other = np.flatnonzero(s >= self.singles)
        if len(other):
            held[other] = self.find_other(s[other] - self.singles[other], row[other], other)
        return held & ~(SURE << HITS)

    def find_other(self, s: np.ndarray, row: np.ndarray, lane: np.ndarray) -> np.ndarray:
        """The same for ids that neither recent prediction gives; s counts from the first of these ids."""
        t, n = self.tables, self.n
        e_zero, e_table = self.e_zero[lane], self.e_table[lane]
        # Leave room again for the two single ids, the lower one first.
        a, b, a_rest, b_rest = self.two_begin[lane], self.one_begin[lane], self.two_rest[lane], self.one_rest[lane]
        swap = (a_rest - b_rest) * (b < a)
        s += (a_rest - swap) * (s >= np.minimum(a, b))
        s += (b_rest + swap) * (s >= np.maximum(a, b))
        first = t.first[row]
        end = first + t.size[row]
        last = first - 1  # the last entry that begins at s or before
        for k in range(t.search - 1, -1, -1):
            mid = last + (1 << k)
            pair = t.pair[mid]
            at = (pair >> 13 & GROUPS - 1) * n + lane
            pair = pair.view(np.uint32)
            begin = (pair >> 17) * e_table + e_zero * ((self.before_units[at].astype(np.uint32) << SPAN) + self.units[at] * (pair & INNER))
            last += ((begin <= s) & (mid < end)).astype(np.int64) << k
        some = last >= first
        held = t.entry[last] * some
        x, weight, start = held & 0xFFFF, held >> WEIGHT & 2 * ONE - 1, held >> BEGIN
        z = t.zero[x]
        at = (z >> 26) * n + lane
        z, units = z.view(np.uint32), self.units[at].astype(np.uint32)
        width = weight.astype(np.uint32) * e_table + e_zero * (units * (z & INNER))
        begin = start.astype(np.uint32) * e_table + e_zero * ((self.before_units[at].astype(np.uint32) << SPAN) + units * (z >> 13 & INNER))
        listed = some & (s - begin < width)
        rare = np.flatnonzero(~listed)
        if len(rare):
            # Between two entries the table of order 1 stands still: only order 0 is left.
            start = (start + weight)[rare]
            y = (s[rare] - start.astype(np.uint32) * e_table[rare]) // e_zero[rare]
            i = lane[rare]
            unit, group = y >> SPAN, np.zeros(len(rare), dtype=np.int64)
            for k in (8, 4, 2, 1):
                group += k * (self.before_units[(group + k) * n + i] <= unit)
            at = group * n + i
            x = t.symbol[(group << SPAN) + (y - (self.before_units[at].astype(np.uint32) << SPAN)) // self.units[at]]
            held[rare] = x | start << BEGIN
        return held | self.before[lane] << CONTEXT


def slot(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one * 40503 + two * 60493) >> 4 & SLOTS - 1


def recent(blocks: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every id of the blocks (n x length): what its slot last had, and how often that came true in a row (0: nothing)."""
    n, length = blocks.shape
    key = (np.arange(n)[:, None] * SLOTS + slots).reshape(-1)
    order = np.argsort(key, kind="stable")
    x, same = blocks.reshape(-1)[order], np.zeros(n * length, dtype=bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    guess = np.zeros(n * length, dtype=np.int64)
    guess[1:] = np.where(same[1:], x[:-1], 0)
    # A visit of a slot adds 1 to the row if the guess was right, else starts it anew with 1.
    right = same & (guess == x)
    place = np.arange(n * length)
    begun = np.maximum.accumulate(np.where(right, 0, place))
    row = np.minimum(place - begun + 1, SURE)
    sure = np.zeros(n * length, dtype=np.int64)
    sure[1:] = np.where(same[1:], row[:-1], 0)
    out = np.empty((2, n * length), dtype=np.int64)
    out[:, order] = guess, sure
    return out[0].reshape(n, length), out[1].reshape(n, length)


def prepared(blocks: np.ndarray, tables: Tables) -> list[np.ndarray]:
    """By step and block: the id, both recent predictions, their hits in a row, whether order 1 has a table, begin and width there."""
    blocks = blocks.astype(np.int64)
    before, earlier = np.zeros_like(blocks), np.zeros_like(blocks)
    before[:, 1:], earlier[:, 2:] = blocks[:, :-1], blocks[:, :-2]
    two, sure_two = recent(blocks, slot(before, earlier))
    one, sure_one = recent(blocks, slot(before, 0))
    row = tables.row[before]
    pair = (before << 16) | blocks
    at = np.searchsorted(tables.pairs, pair)
    known = np.minimum(at, max(0, len(tables.pairs) - 1))
    listed = tables.pairs[known] == pair if len(tables.pairs) else np.zeros(pair.shape, dtype=bool)
    begin = np.where(row > 0, tables.slots[at] - ONE * (row - 1), 0)
    width = np.where(listed, tables.pair_weight[at], 0)
    types = (np.uint16, np.uint16, np.uint16, np.uint8, np.uint8, np.uint8, np.uint16, np.uint16)
    return [np.ascontiguousarray(x.T.astype(t)) for x, t in zip((blocks, two, one, sure_two, sure_one, row > 0, begin, width), types, strict=True)]


def placed(columns: np.ndarray, tables: Tables) -> np.ndarray:
    """Every id of the columns (length x n) as slots hold it, with begin and weight in the table of the id before it."""
    length, n = columns.shape
    pair = np.zeros((length, n), dtype=np.int64)
    pair[1:] = columns[:-1]
    pair <<= 16
    pair |= columns
    pair = pair.reshape(-1)
    bits = max(1, int(pair.size - 1).bit_length())
    order = pair << bits
    order |= np.arange(pair.size, dtype=np.int32)
    order.sort()
    np.right_shift(order, bits, out=pair)
    begun = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    some = pair[begun]
    at = np.searchsorted(tables.pairs, some)
    row = tables.row[some >> 16]
    begin = np.where(row > 0, tables.slots[at] - ONE * (row - 1), 0)
    known = np.minimum(at, max(0, len(tables.pairs) - 1))
    weight = np.where(tables.pairs[known] == some, tables.pair_weight[at], 0) if len(tables.pairs) else np.zeros_like(some)
    held = some & 0xFFFF | weight << WEIGHT | begin << BEGIN | some >> 16 << CONTEXT
    order &= (1 << bits) - 1
    pair[order] = np.repeat(held, np.diff(begun, append=pair.size))
    return pair.reshape(length, n)


def encode_blocks(blocks: np.ndarray, tables: Tables) -> list[bytes]:
    """Payloads of blocks (n x length, ids below 65536)."""
    n, length = blocks.shape
    held = placed(np.ascontiguousarray(blocks.T), tables)
    mixer = Mixer(n, tables)
    low, size = np.zeros(n, dtype=U), np.full(n, (1 << 63) - 1, dtype=U)
    out = np.zeros((2 * length + 6, n), dtype=np.uint32)
    at = np.zeros(n, dtype=np.int64)

    def emit(i: np.ndarray) -> None:
        # 16 bits go out; a carry stays above them and is added to the digit before at the end
        out[at[i], i] = low[i] >> LOW
        low[i] = (low[i] & U((1 << 47) - 1)) << DIGIT
        at[i] += 1

    for t in range(length):
        mixer.begin(tables.row[mixer.before] > 0)
        left, wide = mixer.interval(held[t])
        r = size >> U(BITS)
        low += r * left
        size = r * wide
        while len(full := np.flatnonzero(size < U(1 << 47))):
            emit(full)
            size[full] <<= DIGIT
        mixer.learn(t, held[t])
    everyone = np.arange(n)
    for _ in range(4):
        emit(everyone)
    carry = np.zeros(n, dtype=np.uint32)
    for t in range(int(at.max()) - 1, -1, -1):
        d = out[t] + carry
        out[t], carry = d & 0xFFFF, d >> 16
    digits = np.ascontiguousarray(out.T.astype("<u2"))
    return [digits[i, : at[i]].tobytes() for i in range(n)]


def decode_blocks(payloads: list[bytes], length: int, tables: Tables) -> np.ndarray:
    """Blocks of so many ids each from their payloads."""
    n = len(payloads)
    mixer = Mixer(n, tables)
    digits = np.zeros((max(len(p) for p in payloads) // 2 + 8, n), dtype=U)
    for i, p in enumerate(payloads):
        digits[: len(p) // 2, i] = np.frombuffer(p, dtype="<u2")
    # The first digits fill the window of 63 bits; one bit of the fourth is not in it yet.
    v = (digits[0] << U(47)) | (digits[1] << U(31)) | (digits[2] << U(15)) | (digits[3] >> U(1))
    rest = digits[3] & U(1)
    at = np.full(n, 4, dtype=np.int64)
    size = np.full(n, (1 << 63) - 1, dtype=U)
    out = np.zeros((length, n), dtype=np.uint16)
    most = U((1 << BITS) - 1)
    for t in range(length):
        row = tables.row[mixer.before]
        mixer.begin(row > 0)
        r = size >> U(BITS)
        held = mixer.find(np.minimum(v // r, most).astype(np.uint32), row)
        left, wide = mixer.interval(held)
        v -= r * left
        size = r * wide
        while len(full := np.flatnonzero(size < U(1 << 47))):
            d = digits[at[full], full]
            v[full] = (v[full] << DIGIT) | (rest[full] << U(15)) | (d >> U(1))
            rest[full] = d & U(1)
            size[full] <<= DIGIT
            at[full] += 1
        out[t] = mixer.x
        mixer.learn(t, held)
    return np.ascontiguousarray(out.T)


def checksum(payload: bytes) -> int:
    return zlib.crc32(payload)
