"""External induced sorting of the suffixes of a shard, with their common-prefix values up to a limit."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

ALPHABET = 256


class BucketQueue:
    """A monotone priority queue of suffix tuples (position, common prefix with the tuple before it), backed by disk.

    Its key is (first character, rank of the following suffix). Tuples of one character arrive in the order of that rank,
    so each character has a queue of blocks. Blocks over the budget go to one unlinked temporary file, which lives as long
    as the queue; nothing is left for later tasks.
    """

    def __init__(self, budget: int):
        self.budget, self.held = budget, 0
        self.spilled, self.most = 0, 0  # blocks that went to the file; bytes of positions popped at once
        self.blocks: list[list] = [[] for _ in range(ALPHABET)]
        self.file = None

    def push(self, char: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        size = pos.nbytes + lcp.nbytes
        if self.held + size > self.budget:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # noqa: SIM115
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(pos.tobytes())
            self.file.write(lcp.tobytes())
            self.blocks[char].append((at, len(pos), pos.dtype))
            self.spilled += 1
        else:
            self.held += size
            self.blocks[char].append((pos, lcp))

    def pop(self, char: int, last_first: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The tuples of a character in their order, those that are pushed meanwhile included, up to the budget at once.

        last_first: the latest ones come first; inside a block they keep their order.
        """
        queue = self.blocks[char]
        while queue:
            n, size = 0, 0
            while n < len(queue) and (not n or size < self.budget):
                block = queue[-1 - n] if last_first else queue[n]
                size += block[0].nbytes if len(block) == 2 else block[1] * block[2].itemsize
                n += 1
            if last_first:
                taken, queue[-n:] = queue[-n:], []
            else:
                taken, queue[:n] = queue[:n], []
            read = [self._read(b) for b in taken]
            self.most = max(self.most, size)
            yield np.concatenate([p for p, _ in read]), np.concatenate([v for _, v in read])

    def _read(self, block) -> tuple[np.ndarray, np.ndarray]:
        if len(block) == 2:
            self.held -= block[0].nbytes + block[1].nbytes
            return block
        at, n, kind = block
        self.file.seek(at)
        pos = np.frombuffer(self.file.read(n * kind.itemsize), dtype=kind)
        return pos, np.frombuffer(self.file.read(n), dtype=np.uint8)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Inducer:
    """Pushes the suffix before each popped one, if it has the wanted type, with the common prefix it inherits.

    Two suffixes pushed to one character have 1 plus the least common prefix of all suffixes popped between their
    successors. least[d] is that minimum since the last push to d.
    """

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queue: BucketQueue, limit: int):
        self.text, self.wanted, self.queue, self.limit = text, wanted, queue, limit
        self.least = np.zeros(ALPHABET, dtype=np.uint8)
        self.begun = np.zeros(ALPHABET, dtype=bool)

    def feed(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        before = pos - 1
        ok = (pos > 0) & self.wanted[before]
        at = np.flatnonzero(ok)
        chars = self.text[before[at]]
        low = lcp.min()
        if not len(at):
            np.minimum(self.least, low, out=self.least)
            return
        order = np.argsort(chars, kind="stable")
        chars = chars[order]
        cut = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
        ends = np.append(cut[1:], len(chars))
        present = chars[cut]
        absent = np.ones(ALPHABET, dtype=bool)
        absent[present] = False
        self.least[absent] = np.minimum(self.least[absent], low)
        for c, a, b in zip(present.tolist(), cut.tolist(), ends.tolist()):
            t = at[order[a:b]]
            own = np.empty(len(t), dtype=np.uint8)
            own[0] = min(self.least[c], lcp[: t[0] + 1].min())
            if len(t) > 1:
                own[1:] = np.minimum.reduceat(lcp[: t[-1] + 1], t[:-1] + 1)
            rest = lcp[t[-1] + 1 :]
            self.least[c] = rest.min() if len(rest) else self.limit
            own = np.minimum(own, self.limit - 1) + 1
            if not self.begun[c]:
                own[0], self.begun[c] = 0, True
            self.queue.push(c, before[t], own.astype(np.uint8))


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); the last one counts as S."""
    n = len(text)
    differs = text[:-1] != text[1:]
    index = np.where(differs, np.arange(n - 1), n - 1)
    after = np.minimum.accumulate(index[::-1])[::-1]
    out = np.ones(n, dtype=bool)
    inside = after < n - 1
    out[:-1][inside] = text[after[inside]] < text[after[inside] + 1]
    return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to limit; text is padded beyond its end by a character it does not hold."""
    out = np.full(len(a), limit, dtype=np.uint8)
    words = np.ndarray((len(text) - 7,), dtype="<u8", buffer=text.data, strides=(1,))
    open_ = np.arange(len(a))
    for step in range(0, limit, 8):
        x = words[a[open_] + step] ^ words[b[open_] + step]
        ended = x != 0
        if ended.any():
            y = x[ended]
            first = np.bitwise_count((y & (~y + np.uint64(1))) - np.uint64(1)) // 8  # whole zero bytes below the lowest bit
            out[open_[ended]] = np.minimum(limit, step + first)
            open_ = open_[~ended]
            if not len(open_):
                break
    return out


def _named(text: np.ndarray, small: np.ndarray, stars: np.ndarray, limit: int) -> np.ndarray:
    """Order-preserving names of the S* substrings (each up to and with the next S*), by characters and types.

    Substrings are compared seven characters at a time, and only those still tied are looked at again. Beyond limit
    characters they count as equal.
    """
    n = len(stars)
    ends = np.append(stars[1:], stars[-1])
    coded = np.zeros(len(text) + 8, dtype=np.uint16)
    coded[: len(text)] = text.astype(np.uint16) * 2 + 1 + small
    names = np.zeros(n, dtype=np.int64)
    open_ = np.arange(n)
    for step in range(0, limit, 6):
        key = np.zeros(len(open_), dtype=np.uint64)
        for k in range(6):
            at = stars[open_] + step + k
            part = np.where(at <= ends[open_], coded[np.minimum(at, len(coded) - 1)], np.uint16(0)).astype(np.uint64)
            key = (key << np.uint64(10)) | part
        order = np.argsort(key) if step == 0 else np.lexsort((key, names[open_]))
        group, k2 = names[open_][order], key[order]
        new = np.append(True, (group[1:] != group[:-1]) | (k2[1:] != k2[:-1]))
        fresh = np.append(True, group[1:] != group[:-1])
        # a name is the number of substrings before its first one, so refining a group never disturbs the others
        start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        base = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        names[open_[order]] = group + start - base
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        tied = np.repeat(size > 1, size)
        longer = stars[open_[order]] + step + 6 <= ends[open_[order]]
        open_ = np.sort(open_[order][tied & longer])
        if not len(open_):
            break
    return names


def _ranked(names: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes of the reduced string, by doubling, until all differ or limit names are compared.

    A rank is the number of suffixes before a group of equal ones; only groups that are still tied are sorted again.
    """
    n, width = len(names), 1
    rank = names.copy()
    open_ = np.arange(n)
    while len(open_) and width < min(limit, n):
        after = np.where(open_ + width < n, rank[np.minimum(open_ + width, n - 1)] + 1, 0)
        order = np.argsort(rank[open_] * (n + 1) + after)
        group, tail = rank[open_][order], after[order]
        fresh = np.append(True, group[1:] != group[:-1])
        new = np.append(True, tail[1:] != tail[:-1]) | fresh
        places = np.arange(len(order))
        start = np.maximum.accumulate(np.where(new, places, 0))
        base = np.maximum.accumulate(np.where(fresh, places, 0))
        rank[open_[order]] = group + start - base
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        open_ = np.sort(open_[order][np.repeat(size > 1, size)])
        width *= 2
    return np.argsort(rank, kind="stable")


def sorted_suffixes(
    text: bytes | np.ndarray, limit: int, budget: int = 256 << 20, seen: list[BucketQueue] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (positions, common prefixes with the suffix before, at most limit) of all suffixes of text, largest suffix first.

    Suffixes that agree on limit characters may stand in any order. text ends with one character 0 (not with two) and holds
    no 255. Blocks hold about budget bytes of positions at most; nothing of a whole character is brought into memory.
    seen: takes the queues, for who wants to know how much they spilled.

    S* suffixes (smaller than their successor, after a larger one) are named by their substrings and ranked on the reduced
    string; L suffixes are induced from them over ascending characters, S suffixes from the L ones over descending
    characters. Both passes carry tuples of position and common prefix through a disk-backed bucket queue.
    """
    text = np.frombuffer(text, dtype=np.uint8) if isinstance(text, bytes) else text
    n = len(text)
    if n < 2 or text[-1] != 0 or text[-2] == 0:
        raise ValueError("the text must end with one character 0")
    kind = np.int32 if n < 1 << 31 else np.int64
    padded = np.concatenate([text, np.full(limit + 16, 255, dtype=np.uint8)])
    small = _types(text)
    stars = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int64) + 1
    if not len(stars):
        stars = np.array([n - 1])
    order = _ranked(_named(text, small, stars, limit), limit)
    stars = stars[order].astype(kind)
    star_lcp = np.zeros(len(stars), dtype=np.uint8)
    star_lcp[1:] = _common(padded, stars[:-1].astype(np.int64), stars[1:].astype(np.int64), limit)
    heads = np.searchsorted(text[stars], np.arange(ALPHABET + 1))

    def meet(a: int, b: int) -> int:
        return int(_common(padded, np.array([a]), np.array([b]), limit)[0])

    queue, done = BucketQueue(budget), BucketQueue(budget)
    again = BucketQueue(budget)
    if seen is not None:
        seen += [queue, done, again]
    grow = _Inducer(text, ~small, queue, limit)
    for c in range(ALPHABET):
        last = None
        for pos, lcp in queue.pop(c):
            grow.feed(pos, lcp)
            done.push(c, pos, lcp)
            last = pos[-1]
        lo, hi = heads[c], heads[c + 1]
        if hi > lo:
            lcp = star_lcp[lo:hi].copy()
            lcp[0] = 0 if last is None else meet(last, stars[lo])
            grow.feed(stars[lo:hi], lcp)
    queue.close()

    shrink = _Inducer(text, small, again, limit)
    for c in reversed(range(ALPHABET)):
        last = None
        for pos, lcp in again.pop(c):
            shrink.feed(pos, lcp)
            yield pos, lcp
            last = pos[-1]
        if c == text[-1]:  # the last suffix has no successor to be induced from; it is the smallest S suffix of its character
            end, edge = np.array([n - 1], dtype=kind), np.array([0 if last is None else meet(last, n - 1)], dtype=np.uint8)
            shrink.feed(end, edge)
            yield end, edge
            last = n - 1
        above = None  # the common prefix of the smallest suffix given so far with the one below it, once that is an L suffix
        for pos, lcp in done.pop(c, last_first=True):
            down = np.empty(len(pos), dtype=np.uint8)
            down[0] = above if above is not None else 0 if last is None else meet(last, pos[-1])
            down[1:] = lcp[1:][::-1]
            above = lcp[0]
            pos = pos[::-1]
            shrink.feed(pos, down)
            yield pos, down
    again.close()
    done.close()
