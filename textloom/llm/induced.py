"""Suffix order and common prefixes of a text by recursive induced sorting with disk-backed queues.

The suffixes that start a descent (S*) are named by the substrings up to the
next of them. The string of names is ordered by the same method, which names
and orders again until all names differ. From the order of S* suffixes all L
suffixes follow in one ascending pass and all S suffixes in one descending
pass: a suffix taken from the queue puts its left neighbour into the queue,
under that neighbour's symbol.

Bytes have a first-in first-out queue for each symbol, which serves as priority
queue, as neighbours arrive in the order of what follows them. An entry carries
the suffix and the length of the prefix it shares with the entry before, which
is one more than the least such length between what follows the two. Names are
too many for that: they have one priority queue by (symbol, arrival), which is
emptied in blocks of whole symbols. Queues beyond `memory` bytes go to disk,
and are read back in order; so do arrays as long as the text, as mapped files.
"""

from __future__ import annotations

import os
import shutil
import uuid

import numpy as np

CUT, LAST = 1, 0
BLOCK = 1 << 19
#: Names that leave the priority queue at once, and sorted runs that it holds in memory.
NAMES, RUNS = 1 << 15, 12
#: Symbols of a text in one number, their bits; numbers from which a difference lies one symbol further to the left; of PACK symbols the first ones, and the mark of an end behind them.
PACK, BITS = 7, 9
PLACES = np.array([1 << BITS * i for i in range(PACK)])
WITHIN = np.array([(1 << BITS * PACK) - (1 << BITS * (PACK - i)) for i in range(PACK + 1)])
END = np.array([((1 << BITS) - 1) << BITS * (PACK - 1 - i) for i in range(PACK)] + [0])


class Space:
    """Arrays in memory, or in mapped files below a folder of their own where they are large."""

    def __init__(self, folder: str | None, memory: int):
        self.folder, self.memory, self.own = folder, memory, ""

    def path(self) -> str:
        if not self.own:
            self.own = os.path.join(self.folder, f"arrays-{uuid.uuid4().hex}")
            os.makedirs(self.own)
        return os.path.join(self.own, uuid.uuid4().hex)

    def array(self, n: int, dtype) -> np.ndarray:
        if not self.folder or n * np.dtype(dtype).itemsize <= self.memory // 16:
            return np.zeros(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def close(self) -> None:
        if self.own:
            shutil.rmtree(self.own, ignore_errors=True)


class Heap:
    """A priority queue of (symbol, arrival, position) that takes and gives many entries at once, in sorted runs; beyond memory a run is a file."""

    def __init__(self, space: Space):
        self.space, self.new, self.runs = space, [], []
        self.held = 0

    def push(self, symbol: np.ndarray, arrival: np.ndarray, position: np.ndarray) -> None:
        if len(symbol):
            self.new.append(np.stack([symbol, arrival, position]))

    @staticmethod
    def _merged(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts, axis=1) if len(parts) > 1 else parts[0]
        return rows[:, np.lexsort((rows[1], rows[0]))]

    def _settle(self) -> None:
        """Sorts what is new into a run; joins runs in memory where they are many, and writes them where they are large."""
        if self.new:
            self.runs.append(self._merged(self.new))
            self.new = []
        self.runs = [r for r in self.runs if r.shape[1]]
        inside = [r for r in self.runs if not isinstance(r, np.memmap)]
        size = sum(r.nbytes for r in inside)
        large = bool(self.space.folder) and size > self.space.memory // 4
        if len(inside) > RUNS or large:
            one = self._merged(inside)
            if large:
                path = self.space.path()
                one.tofile(path)
                one = np.memmap(path, np.int64, "r", shape=one.shape)
            self.runs = [*[r for r in self.runs if isinstance(r, np.memmap)], one]

    def bound(self, n: int) -> tuple[int, int] | None:
        """The least symbol, and one that about n entries of each run lie below; none if the queue is empty."""
        self._settle()
        if not self.runs:
            return None
        return min(int(r[0, 0]) for r in self.runs), min((int(r[0, n]) for r in self.runs if r.shape[1] > n), default=1 << 62)

    def pop(self, below: int) -> np.ndarray:
        """All entries of symbols under `below`, in order."""
        self._settle()
        out = []
        for i, r in enumerate(self.runs):
            if k := int(np.searchsorted(r[0], below)):
                out.append(np.asarray(r[:, :k]))
                self.runs[i] = r[:, k:]
        return self._merged(out) if out else np.zeros((3, 0), np.int64)


class Queues:
    """A first-in first-out queue of (position, common prefix) for every symbol."""

    def __init__(self, symbols: int, folder: str | None, memory: int):
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(symbols)]
        self.files: dict[int, str] = {}
        self.folder, self.memory, self.used = folder, memory, 0
        self.own = ""

    def push(self, symbol: int, position: np.ndarray, common: np.ndarray) -> None:
        self.held[symbol].append((position, common))
        self.used += position.nbytes + common.nbytes
        if self.used > self.memory and self.folder:
            self._spill()

    def _spill(self) -> None:
        if not self.own:
            self.own = os.path.join(self.folder, f"queues-{uuid.uuid4().hex}")
            os.makedirs(self.own)
        for symbol, parts in enumerate(self.held):
            if parts:
                with open(os.path.join(self.own, str(symbol)), "ab") as f:
                    for position, common in parts:
                        f.write(len(position).to_bytes(8, "little") + position.tobytes() + common.tobytes())
                self.files[symbol] = os.path.join(self.own, str(symbol))
                self.held[symbol] = []
        self.used = 0

    def pop(self, symbol: int):
        """All entries of a symbol so far, in order, in blocks of about BLOCK entries."""
        some, n = [], 0
        for part in self._parts(symbol):
            some.append(part)
            n += len(part[0])
            if n >= BLOCK:
                yield tuple(np.concatenate(x) for x in zip(*some, strict=True))
                some, n = [], 0
        if some:
            yield tuple(np.concatenate(x) for x in zip(*some, strict=True))

    def _parts(self, symbol: int):
        parts, self.held[symbol] = self.held[symbol], []
        self.used -= sum(x.nbytes for part in parts for x in part)
        if path := self.files.pop(symbol, None):  # under another name, as entries of the next round may be written meanwhile
            os.rename(path, path := f"{path}.{uuid.uuid4().hex}")
            with open(path, "rb") as f:
                while head := f.read(8):
                    n = int.from_bytes(head, "little")
                    yield np.frombuffer(f.read(8 * n), np.int64), np.frombuffer(f.read(2 * n), np.uint16)
            os.remove(path)
        yield from parts

    def close(self) -> None:
        if self.own:
            shutil.rmtree(self.own, ignore_errors=True)


class Carry:
    """For every symbol, the least common prefix seen since its last entry; and those between entries of one block."""

    def __init__(self, symbols: int, cap: int):
        self.least = np.zeros(symbols, np.uint16)  # nothing before the first entry
        self.cap = cap

    def split(self, symbol: np.ndarray, common: np.ndarray, chosen: np.ndarray):
        """Yields (symbol, indices into the block, common prefixes of the new entries) for the chosen entries of a block in order."""
        at = np.flatnonzero(chosen)
        n = len(common)
        order = at[np.argsort(symbol[at], kind="stable")]
        if len(order):
            table = [common]
            while 2 << (len(table) - 1) <= n:
                half = 1 << (len(table) - 1)
                table.append(np.minimum(table[-1][:-half], table[-1][half:]))
            kind = symbol[order]
            turn = np.empty(len(kind), bool)
            turn[0] = True
            np.not_equal(kind[1:], kind[:-1], out=turn[1:])
            starts = np.flatnonzero(turn)
            before = np.empty(len(order), np.int64)
            before[1:] = order[:-1]
            before[starts] = -1
            first, size = before + 1, order - before
            level = np.frexp(size.astype(np.float64))[1] - 1
            least = np.empty(len(order), np.uint16)
            for k in range(len(table)):
                i = np.flatnonzero(level == k)
                if len(i):
                    least[i] = np.minimum(table[k][first[i]], table[k][order[i] + 1 - (1 << k)])
            least[starts] = np.minimum(least[starts], self.least[kind[starts]])
            least = np.minimum(least + 1, self.cap).astype(np.uint16)
            ends = np.append(starts[1:], len(order))
            rest = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint16(65535))
            whole = rest[0]
            np.minimum(self.least, whole, out=self.least)
            self.least[kind[starts]] = rest[order[ends - 1] + 1]
            for a, b in zip(starts, ends, strict=True):
                yield int(kind[a]), order[a:b], least[a:b]
        elif n:
            np.minimum(self.least, common.min(), out=self.least)


def types(t: np.ndarray, space: Space) -> np.ndarray:
    """True for S: a suffix smaller than the one after it. The last symbol is S, and the only one of its kind. From right to left in blocks."""
    out = space.array(len(t), bool)
    out[-1], after = True, True
    for b in range(len(t) - 1, 0, -BLOCK):
        a = max(0, b - BLOCK)
        x = np.asarray(t[a : b + 1]).astype(np.int64)
        step = np.sign(np.diff(x))  # 1: S, -1: L, 0: as the next
        at = np.where(step != 0, np.arange(b - a), b - a)
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[a:b] = np.append(step > 0, after)[at]
        after = bool(out[a])
    return out


def stars(small: np.ndarray) -> np.ndarray:
    """The S suffixes behind an L suffix."""
    return np.concatenate([np.zeros(0, np.int64), *[np.flatnonzero(small[a + 1 : a + BLOCK + 1] & ~small[a : a + BLOCK][: len(small) - 1 - a]) + a + 1 for a in range(0, len(small) - 1, BLOCK)]])


def names(t: np.ndarray, star: np.ndarray, symbols: int) -> np.ndarray:
    """The rank of each S* substring (up to and with the next S* symbol), equal for equal ones."""
    bits = max(2, int(symbols + 1).bit_length())
    per_key, end = max(1, 62 // bits), (1 << bits) - 1
    size = np.diff(star, append=len(t) - 1) + 1
    rank, todo, k = np.zeros(len(star), np.int64), np.arange(len(star)), 0
    while len(todo):
        key = np.zeros(len(todo), np.int64)
        for j in range(k, k + per_key):
            x = np.asarray(t[np.minimum(star[todo] + j, len(t) - 1)]).astype(np.int64)
            key = key << bits | np.where(j < size[todo], x, np.where(j == size[todo], end, 0))
        todo = refine(rank, todo, key)
        k += per_key
        todo = todo[size[todo] >= k]
    return rank


def refine(rank: np.ndarray, todo: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Orders `todo` by (rank, key) and gives each the place of the first equal; returns those that are not alone."""
    order = np.lexsort((key, rank[todo]))
    r, x = rank[todo][order], key[order]
    group = np.ones(len(r), bool)
    group[1:] = r[1:] != r[:-1]
    new = group.copy()
    new[1:] |= x[1:] != x[:-1]
    place = np.arange(len(r))
    offset = place - np.maximum.accumulate(np.where(group, place, 0))
    rank[todo[order]] = r + offset[np.maximum.accumulate(np.where(new, place, 0))]
    alone = new & np.append(new[1:], True)
    return todo[order[~alone]]


def induce(key: np.ndarray, seeds: np.ndarray, chosen: np.ndarray, space: Space):
    """Yields, in the order of key and of what follows, blocks of (position, whether induced): the seeds, and what they induce to their left.

    `seeds` are in order; an induced position is one of `chosen`, and comes
    before the seeds of its symbol and behind what was induced there earlier.
    """
    heap, at, arrived = Heap(space), 0, 0

    def children(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the positions induce their left neighbour, and its symbol."""
        left = np.maximum(position - 1, 0)
        return (position > 0) & chosen[left], np.asarray(key[left]).astype(np.int64)

    while True:
        found = heap.bound(NAMES)
        seed = int(key[seeds[at]]) if at < len(seeds) else None
        if found is None and seed is None:
            return
        least = min(x for x in (found and found[0], seed) if x is not None)
        below = min(found[1] if found else 1 << 62, int(key[seeds[at + NAMES]]) if at + NAMES < len(seeds) else 1 << 62)
        below = max(below, least + 1)
        own, to = heap.pop(below), at
        while to < len(seeds):  # seeds ascend by key, so those of the block are a stretch
            step = np.asarray(key[seeds[to : to + NAMES]])
            k = int(np.searchsorted(step, below))
            to += k
            if k < len(step):
                break
        mine = np.asarray(seeds[at:to])
        position, induced = _settle(own, mine, np.asarray(key[mine]).astype(np.int64), below, children)
        good, symbol = children(position)
        good &= symbol >= below
        i = np.flatnonzero(good)
        heap.push(symbol[i], arrived + i, position[i] - 1)
        at, arrived = to, arrived + len(position)
        yield position, induced


def _settle(own: np.ndarray, seeds: np.ndarray, seed_keys: np.ndarray, below: int, children) -> tuple[np.ndarray, np.ndarray]:
    """A block of symbols in order: what is queued, what is induced within the block, and the seeds.

    What is induced within the block stands behind what was queued under its
    symbol, in the order of what it was induced by. As that may be of the block
    too, ties are broken by the place of the one it comes from, then of that
    one's, twice as far back each time.
    """
    symbol, position = [own[0], seed_keys], [own[2], seeds]
    n = roots = len(own[0]) + len(seeds)
    source, now, first = [np.arange(n)], np.concatenate(position), 0
    while len(now):
        good, s = children(now)
        i = np.flatnonzero(good & (s < below))
        symbol.append(s[i]), position.append(now[i] - 1), source.append(first + i)
        first, now = n, now[i] - 1
        n += len(i)
    symbol, position, source = np.concatenate(symbol), np.concatenate(position), np.concatenate(source)
    kind = np.concatenate([np.zeros(len(own[0]), np.int8), np.full(len(seeds), 2, np.int8), np.ones(n - roots, np.int8)])
    arrival = np.concatenate([own[1], np.arange(len(seeds)), np.zeros(n - roots, np.int64)])
    order = np.lexsort((arrival, kind, symbol))
    if n > roots:
        k, s = kind[order], symbol[order]
        tied = np.append(False, (k[1:] == 1) & (k[:-1] == 1) & (s[1:] == s[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(tied, 0, np.arange(n)))
        todo = order[tied | np.append(tied[1:], False)]
        while len(todo):
            todo = refine(rank, todo, rank[source[todo]])
            source = source[source]
        order = np.argsort(rank, kind="stable")
    return position[order], kind[order] < 2


def order_of(r: np.ndarray, space: Space) -> np.ndarray:
    """The positions of a string of numbers in the order of its suffixes, the shorter of two first where one starts the other."""
    n = len(r)
    kinds, t = np.unique(r, return_inverse=True)
    if len(kinds) == n:
        return np.argsort(t, kind="stable")
    string = space.array(n + 1, np.int64)
    string[:n] = t + 1
    del t
    small = types(string, space)
    star = stars(small)
    star = star[order_of(names(string, star, len(kinds) + 1), space)]
    large = space.array(n + 1, np.int64)
    size = 0
    for position, induced in induce(string, star, ~small, space):
        found = position[induced]
        large[size : size + len(found)] = found
        size += len(found)
    out, end = space.array(n + 1, np.int64), n + 1
    np.subtract(len(kinds) + 1, string, out=string)  # from the largest down
    for position, _ in induce(string, large[:size][::-1], small, space):
        out[end - len(position) : end] = position[::-1]
        end -= len(position)
    return out[1:]  # without the last symbol's


def packed(t: np.ndarray, space: Space) -> np.ndarray:
    """PACK symbols of t from each place on, in one number; zeros behind the end."""
    out = space.array(len(t), np.int64)
    for a in range(0, len(t), BLOCK):
        x = np.zeros(min(BLOCK, len(t) - a) + PACK - 1, np.int64)
        some = t[a : a + len(x)]
        x[: len(some)] = some
        two = x[:-1] << BITS | x[1:]
        four = two[:-2] << 2 * BITS | two[2:]
        out[a : a + BLOCK] = four[:-3] << 3 * BITS | four[3:] & (1 << 3 * BITS) - 1
    return out


def byte_names(sevens: np.ndarray, star: np.ndarray) -> np.ndarray:
    """As names(), of packed symbols."""
    size = np.diff(star, append=len(sevens) - 1) + 1
    rank, todo, k = np.zeros(len(star), np.int64), np.arange(len(star)), 0
    while len(todo):
        left = np.minimum(size[todo] - k, PACK)
        todo = refine(rank, todo, sevens[np.minimum(star[todo] + k, len(sevens) - 1)] & WITHIN[left] | END[left])
        k += PACK
        todo = todo[size[todo] >= k]
    return rank


def star_order(t: np.ndarray, star: np.ndarray, cap: int, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Indices of S* suffixes in order, and what each shares with the one before, as deep as cap symbols."""
    sevens = packed(t, space)
    order = order_of(byte_names(sevens, star), space)
    common = space.array(len(order), np.uint16)
    for a in range(1, len(order), BLOCK):
        x, y = star[order[a : a + BLOCK]], star[order[a - 1 : a - 1 + BLOCK][: len(order[a : a + BLOCK])]]
        i, k, deep = np.arange(len(x)), 0, np.full(len(x), cap)
        while len(i) and k < cap:
            differ = sevens[x] ^ sevens[y]  # two that hold the last symbol differ
            same = differ == 0
            if not same.all():
                deep[i[~same]] = k + PACK - np.searchsorted(PLACES, differ[~same], "right")
                i, x, y = i[same], x[same], y[same]
            x, y, k = x + PACK, y + PACK, k + PACK
        common[a : a + len(deep)] = np.minimum(deep, cap)
    return order, common


def suffixes(t: np.ndarray, cap: int, folder: str | None = None, memory: int = 256 << 20):
    """Yields blocks of (position, common prefix with the one before, at most cap) over all suffixes of t in descending order.

    t holds symbols under 511 and ends with LAST, its only one and the least.
    Order and prefixes hold as deep as cap symbols. The common prefix of an
    entry is that with the entry before it in this descending order.
    """
    symbols, n = int(t.max()) + 1, len(t)
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.uint16)
        return
    space = Space(folder, memory)
    try:
        yield from _suffixes(t, cap, folder, memory, symbols, n, space)
    finally:
        space.close()


def _suffixes(t: np.ndarray, cap: int, folder: str | None, memory: int, symbols: int, n: int, space: Space):
    small = types(t, space)
    star = stars(small)
    order, shared = star_order(t, star, cap, space)
    seeds = star[order]
    bounds = np.searchsorted(t[seeds], np.arange(symbols + 1))
    up, down = Queues(symbols, folder, memory // 2), Queues(symbols, folder, memory // 2)
    kept = Queues(symbols, folder, memory // 2)
    rounds_up = np.zeros(symbols, np.int64)
    carry = Carry(symbols, cap)

    def take(queue: Queues, carry: Carry, position: np.ndarray, common: np.ndarray, large: bool) -> None:
        left = np.maximum(position - 1, 0)
        good = (position > 0) & (small[left] != large)
        for symbol, i, shares in carry.split(t[left], common, good):
            queue.push(symbol, left[i], shares)

    for c in range(symbols):
        fresh = True
        while True:
            found = False
            for position, common in up.pop(c):
                found = True
                if fresh:
                    common = np.concatenate([np.zeros(1, np.uint16), common[1:]])
                    fresh = False
                kept.push(c, position, common)
                take(up, carry, position, common, True)
            if not found:
                break
            rounds_up[c] += 1
        a, b = bounds[c], bounds[c + 1]
        if a < b:
            common = shared[a:b].copy()
            run = 1
            while run < cap and seeds[a] + run < n and t[seeds[a] + run] == c:
                run += 1
            common[0] = min(int(rounds_up[c]), run, cap)
            take(up, carry, seeds[a:b], common, True)
    up.close()

    carry = Carry(symbols, cap)
    for c in reversed(range(symbols)):
        fresh, rounds = True, 0
        while True:
            found = False
            for position, common in down.pop(c):
                found = True
                if fresh:
                    common = np.concatenate([np.zeros(1, np.uint16), common[1:]])
                    fresh = False
                take(down, carry, position, common, False)
                yield position, common
            if not found:
                break
            rounds += 1
        if c == LAST:  # the last symbol follows nothing
            yield np.array([n - 1]), np.zeros(1, np.uint16)
            continue
        larger = min(rounds, int(rounds_up[c]), cap)  # with the entry above
        for position, common in reversed(list(kept.pop(c))):
            own = common[::-1]
            common = np.concatenate([np.array([larger], np.uint16), own[:-1]])
            larger = own[-1]
            position = position[::-1]
            take(down, carry, position, common, False)
            yield position, common
    down.close()
    kept.close()
