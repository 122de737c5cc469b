"""External induced suffix sorting with common prefixes.

Suffixes are typed as larger (L) or smaller (S) than their right neighbour. The leftmost S suffixes of their runs (LMS) cut the
text into substrings; these are named by rank, and the names form a shorter text whose suffixes are sorted first: by the same
reduction again while it does not fit in memory, else by doubling. From the sorted LMS suffixes one ascending scan induces the L suffixes
and one descending scan the S suffixes: a scanned suffix hands its left neighbour to a queue keyed by that neighbour's first symbol. Keys
leave the queue in the order of the scan, so the queue is one list for each key; lists beyond its memory lie on disk. Each entry carries
the common prefix with the entry before it, one more than the least common prefix between the two suffixes that induced them.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Entries that a queue holds in memory before it moves lists to disk; names that are sorted in memory.
QUEUE_ENTRIES, NAMES_IN_MEMORY = 131_072, 16_000_000


class SuffixQueue:
    """A monotone priority queue of (position, common prefix) tuples, keyed by symbol, with first-in first-out order within a key.

    When it holds more than `most` entries, all its lists go to one unlinked scratch file in Spark's own local folder, which ends with
    the task, and are read back when their key is popped.
    """

    def __init__(self, most: int = QUEUE_ENTRIES):
        self.most, self.held, self.lists, self.spilled, self.file = most, 0, {}, {}, None

    def push(self, key: int, positions: np.ndarray, common: np.ndarray) -> None:
        self.lists.setdefault(key, []).append((positions, common))
        self.held += len(positions)
        if self.held > self.most:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
            self.file = tempfile.TemporaryFile(dir=scratch)
        for key, parts in self.lists.items():
            for positions, common in parts:
                self.spilled.setdefault(key, []).append((self.file.seek(0, 2), len(positions)))
                self.file.write(positions.tobytes())
                self.file.write(common.tobytes())
        self.lists, self.held = {}, 0

    def keys(self) -> set[int]:
        return self.lists.keys() | self.spilled.keys()

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for at, n in self.spilled.pop(key, ()):
            self.file.seek(at)
            parts.append((np.frombuffer(self.file.read(8 * n), "i8"), np.frombuffer(self.file.read(2 * n), "i2")))
        held = self.lists.pop(key, [])
        self.held -= sum(len(p) for p, _ in held)
        parts += held
        if not parts:
            return np.empty(0, "i8"), np.empty(0, "i2")
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol, the unique smallest, counts as S."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    up = text[change] < text[change + 1]
    out = np.ones(n, bool)
    out[: n - 1] = up[np.searchsorted(change, np.arange(n - 1))]
    return out


def _dense(order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rank of each item: the place at which its group starts in the order."""
    places = np.flatnonzero(starts)
    rank = np.empty(len(order), "i8")
    rank[order] = np.repeat(places, np.diff(np.append(places, len(order))))
    return rank


def _names(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings (each up to and with the next LMS symbol) by symbols and types; none is a prefix of another."""
    symbols = text.astype("u8") * np.uint64(2) + small
    bits = int(symbols.max()).bit_length()
    each = max(1, 63 // bits)
    ends = np.append(lms[1:], len(text) - 1)
    rank, todo, shift = np.zeros(len(lms), "i8"), np.arange(len(lms)), 0
    padded = np.concatenate([symbols, np.zeros(each, "u8")])
    while len(todo):
        key = np.zeros(len(todo), "u8")
        at, stop = lms[todo] + shift, ends[todo]
        for k in range(each):
            here = np.minimum(at + k, len(text))
            key = key << np.uint64(bits) | np.where(at + k <= stop, padded[here], np.uint64(0))
        base = rank[todo]
        order = np.lexsort((key, base)) if shift else np.argsort(key)
        sorted_base, sorted_key = base[order], key[order]
        fresh = np.ones(len(todo), bool)
        fresh[1:] = (sorted_base[1:] != sorted_base[:-1]) | (sorted_key[1:] != sorted_key[:-1])
        group = np.ones(len(todo), bool)
        group[1:] = sorted_base[1:] != sorted_base[:-1]
        # a rank is the number of smaller items: what the group had, plus those before it within the group
        place = np.arange(len(todo))
        first = np.maximum.accumulate(np.where(fresh, place, 0))
        rank[todo[order]] = sorted_base + first - np.maximum.accumulate(np.where(group, place, 0))
        same = np.zeros(len(todo), bool)
        same[1:] |= ~fresh[1:]
        same[:-1] |= ~fresh[1:]
        again = todo[order][same]
        shift += each
        todo = np.sort(again[lms[again] + shift <= ends[again]])
    return rank


def _double(names: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of the names in order, by their first `depth` names at least."""
    n = len(names)
    order = np.argsort(names)
    fresh = np.ones(n, bool)
    fresh[1:] = names[order[1:]] != names[order[:-1]]
    rank, h = _dense(order, fresh), 1
    while h < depth:
        tied = np.zeros(n, bool)
        tied[1:] |= ~fresh[1:]
        tied[:-1] |= ~fresh[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        items = order[places]
        beyond = np.where(items + h < n, rank[np.minimum(items + h, n - 1)] + 1, 0)
        key = rank[items] * (n + 1) + beyond
        by = np.argsort(key)
        order[places] = items[by]
        key = key[by]
        new = np.ones(len(places), bool)
        new[1:] = key[1:] != key[:-1]
        fresh[places] = new
        rank = _dense(order, fresh)
        h *= 2
    return order


def _common_prefix(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, up to cap; eight symbols at a time."""
    padded = np.concatenate([text, np.zeros(16, "u1")])
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(text) + 8,), (1,))
    out = np.zeros(len(order), "i2")
    last, live = len(text) + 7, np.arange(1, len(order))
    a, b = order[:-1].copy(), order[1:].copy()
    done = 0
    while len(live) and done < cap:
        differ = words[np.minimum(a + done, last)] ^ words[np.minimum(b + done, last)]
        stop = differ != 0
        x = differ[stop]
        lead = np.zeros(len(x), "i2")
        for k in range(1, 8):
            lead += (x & np.uint64((1 << 8 * k) - 1)) == 0
        out[live[stop]] = done + lead
        go = ~stop
        live, a, b, done = live[go], a[go], b[go], done + 8
    out[live] = cap
    return np.minimum(out, cap)


def _range_least(common: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least value of common[left..right] for each pair of places, by tables of doubled widths."""
    out = np.empty(len(left), "i2")
    level = np.frexp((right - left + 1).astype(float))[1] - 1
    table, k = common, 0
    for wanted in range(int(level.max(initial=-1)) + 1):
        while k < wanted:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
            k += 1
        at = np.flatnonzero(level == wanted)
        out[at] = np.minimum(table[left[at]], table[right[at] - (1 << wanted) + 1])
    return out


def _left(text: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the suffixes have a left neighbour, and its symbol (0 for none)."""
    has = positions > 0
    return has, np.where(has, text[positions - 1], 0)


def _hand_on(queue: SuffixQueue, positions: np.ndarray, common: np.ndarray, chosen: np.ndarray, symbols: np.ndarray, cap: int) -> None:
    """Pushes the left neighbours of the chosen suffixes, keyed by symbol, with their common prefixes."""
    places = np.flatnonzero(chosen)
    if not len(places):
        return
    key = symbols[places]
    by = np.argsort(key, kind="stable")
    places, key = places[by], key[by]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    new = np.ones(len(key), "i2")  # sources in other buckets share nothing
    inner = np.flatnonzero(~fresh)
    if len(inner):
        new[inner] = np.minimum(_range_least(common, places[inner - 1] + 1, places[inner]) + 1, cap)
    starts = np.append(np.flatnonzero(fresh), len(key))
    items = positions[places] - 1
    for i, j in zip(starts[:-1], starts[1:]):
        queue.push(int(key[i]), items[i:j], new[i:j])


def _bucket(queue: SuffixQueue, text: np.ndarray, c: int, cap: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The suffixes of a bucket as induced: those from other buckets, then round by round those from the bucket's own runs of c."""
    positions, common = queue.pop(c)
    all_p, all_c, run = [positions], [common], 1
    while len(positions):
        has, left = _left(text, positions)
        places = np.flatnonzero(has & (left == c))
        if not len(places):
            break
        new = np.full(len(places), min(run, cap), "i2")  # a longer run shares the shorter one
        if len(places) > 1:
            new[1:] = np.minimum(_range_least(common, places[:-1] + 1, places[1:]) + 1, cap)
        positions, common = positions[places] - 1, new
        all_p.append(positions)
        all_c.append(common)
        run += 1
    return all_p, all_c


def _run_length(text: np.ndarray, at: int, cap: int) -> int:
    k = 1
    while k < cap and at + k < len(text) and text[at + k] == text[at]:
        k += 1
    return k


def _induce(text: np.ndarray, seeds: np.ndarray, seed_common: np.ndarray, cap: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order with common prefixes, from the LMS suffixes in order with theirs."""
    symbols = np.unique(text)
    seed_symbols = text[seeds]
    edges = np.searchsorted(seed_symbols, np.append(symbols, symbols[-1] + 1 if symbols.dtype.itemsize > 1 else 256).astype("i8"))
    larger: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    queue = SuffixQueue(most)
    for k, c in enumerate(symbols.tolist()):
        parts, commons = _bucket(queue, text, c, cap)
        positions, common = np.concatenate(parts), np.concatenate(commons)
        if len(common):
            common[0] = 0
        larger[c] = (positions, common)
        own, own_common = seeds[edges[k] : edges[k + 1]], seed_common[edges[k] : edges[k + 1]].copy()
        if len(own):
            own_common[0] = min(_run_length(text, int(positions[-1]), cap), _run_length(text, int(own[0]), cap), cap) if len(positions) else 0
        scanned, common = np.concatenate([positions, own]), np.concatenate([common, own_common])
        has, left = _left(text, scanned)
        # an L suffix hands on larger symbols here (its own symbol came round by round above), an LMS suffix always does
        _hand_on(queue, scanned, common, has & (left > c), left, cap)
    queue.close()
    queue = SuffixQueue(most)
    out_p, out_c = [], []
    for c in reversed(symbols.tolist()):
        if c == symbols[0]:
            out_p.append(np.array([len(text) - 1]))  # the last symbol is alone in its bucket
            out_c.append(np.zeros(1, "i2"))
            continue
        parts, commons = _bucket(queue, text, c, cap)
        positions, common = np.concatenate(parts), np.concatenate(commons)
        l_positions, l_common = larger.pop(c)
        between = 0
        if len(positions) and len(l_positions):
            between = min(_run_length(text, int(l_positions[-1]), cap), _run_length(text, int(positions[-1]), cap))
        down_common = np.append(between, l_common[:0:-1]).astype("i2") if len(l_positions) else np.empty(0, "i2")
        scanned = np.concatenate([positions, l_positions[::-1]])
        merged = np.concatenate([common, down_common])
        has, left = _left(text, scanned)
        # symbols below c; c itself was taken round by round from S suffixes, and an L suffix's equal left neighbour is L too
        _hand_on(queue, scanned, merged, has & (left < c), left, cap)
        ascending = np.append(between, common[:0:-1]).astype("i2") if len(positions) else np.empty(0, "i2")
        out_p += [positions[::-1], l_positions]
        out_c += [ascending, l_common]
    queue.close()
    out_p.reverse()
    out_c.reverse()
    return np.concatenate(out_p), np.concatenate(out_c)


def _order(text: np.ndarray, depth: int, in_memory: int, most: int) -> np.ndarray:
    """The suffixes of a text of names in order, by at least depth names; the text ends with its unique least name."""
    if len(text) <= in_memory:
        return _double(text, depth)
    return suffix_sort(text, depth, in_memory, most, with_common=False)[0]


def suffix_sort(text: np.ndarray, cap: int, in_memory: int = NAMES_IN_MEMORY, most: int = QUEUE_ENTRIES, with_common: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first cap symbols at least, common prefix of each with the one before, up to cap).

    The text's last symbol must be its unique least one. Common prefixes need one-byte symbols.
    """
    if len(text) == 1:
        return np.zeros(1, "i8"), np.zeros(1, "i2")
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names = _names(text, small, lms)
    # an LMS substring spans two symbols at least, so half as many names reach as deep
    order = np.argsort(names) if len(np.unique(names)) == len(names) else _order(names, cap // 2 + 2, in_memory, most)
    seeds = lms[order]
    common = _common_prefix(text, seeds, cap) if with_common else np.zeros(len(seeds), "i2")
    return _induce(text, seeds, common, cap if with_common else 1, most)
