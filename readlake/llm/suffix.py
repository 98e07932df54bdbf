"""Suffix arrays with common prefixes by external induced sorting.

Suffixes are of type S if less than the one after them and L if greater; an S suffix after an L suffix is an LMS suffix. LMS
suffixes are sorted by recursion on the string of the names of their LMS substrings. Each sorted suffix then induces the one before it: all L
suffixes in ascending order from the LMS suffixes, all S suffixes in descending order from the L suffixes. What is induced waits in a
monotone priority queue, keyed by first symbol and type; ties leave in the order of arrival, which is that of the suffixes that
induced them.

The queue's tuples carry the length of the common prefix with the tuple of the same key that arrived before: one more than the least of the
lengths between the two suffixes that induced them, as these left the queue. Where the key changes within a symbol both suffixes are followed
through its run, and suffixes of different symbols share nothing. The recursion returns common prefixes counted in names; whole names are
turned into symbols by their places, and only what two different names share at last is read from the text. Lengths count up to ``cap``.

Nothing of the size of the text need be in memory: text, types, names, orders and lengths above ``memory`` items are files that are mapped,
worked on in blocks of ``memory`` items, and the queue's runs above a quarter of that are files too, of which the heads are read.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Items of an array that stay in memory at most.
MEMORY = 1 << 23


class Space:
    """Arrays: in memory up to ``memory`` items, else files in ``folder``, which are gone with their last user."""

    def __init__(self, folder: str | None = None, memory: int = MEMORY):
        self.folder, self.memory = folder, memory

    def array(self, n: int, kind) -> np.ndarray:
        return np.empty(n, kind) if self.folder is None or n <= self.memory else self.file(n, kind)

    def file(self, n: int, kind) -> np.ndarray:
        f, path = tempfile.mkstemp(prefix="array-", dir=self.folder)
        try:
            os.ftruncate(f, n * np.dtype(kind).itemsize)
            return np.memmap(path, kind, "r+", shape=(n,))
        finally:
            os.close(f)
            os.unlink(path)  # the mapping holds it

    def blocks(self, n: int):
        return ((a, min(a + self.memory, n)) for a in range(0, n, self.memory))


class Queue:
    """(rank, item) tuples, least rank first; ranks are unique. Sorted runs, merged when alike in size; long ones are files."""

    def __init__(self, space: Space):
        self.space, self.runs = space, []

    def push(self, rank: np.ndarray, item: np.ndarray) -> None:
        """Tuples in order of their ranks."""
        if not len(rank):
            return
        run, most = (rank, item), self.space.memory // 4 if self.space.folder else 1 << 62
        while self.runs and len(run[0]) <= most and (left := len(self.runs[-1][0]) - self.runs[-1][2]) < 3 * len(run[0]) and left <= most:
            old, value, at = self.runs.pop()
            both = np.concatenate([old[at:], run[0]])
            o = np.argsort(both, kind="stable")  # merges sorted runs
            run = both[o], np.concatenate([value[at:], run[1]])[o]
        if len(run[0]) > most:
            kept = self.space.file(len(run[0]), np.int64), self.space.file(len(run[0]), np.int64)
            kept[0][:], kept[1][:] = run
            run = kept
        self.runs.append([*run, 0])

    def pop(self, about: int) -> tuple[np.ndarray, np.ndarray]:
        """The least tuples: ``about`` of them, or, if there are fewer, all."""
        about = max(8, about // len(self.runs))
        ends = [r[at + about - 1] for r, _, at in self.runs if at + about < len(r)]
        upto = min(ends) if ends else max(r[-1] for r, _, _ in self.runs)
        got, self.taken = [], [(x, x[2]) for x in self.runs]
        for x in self.runs:
            end = x[2] + int(np.searchsorted(x[0][x[2] : x[2] + about], upto, "right"))
            got.append((np.asarray(x[0][x[2] : end]), np.asarray(x[1][x[2] : end])))
            x[2] = end
        self.runs = [x for x in self.runs if x[2] < len(x[0])]
        if len(got) == 1:
            return got[0]
        rank = np.concatenate([r for r, _ in got])
        o = np.argsort(rank, kind="stable")
        return rank[o], np.concatenate([v for _, v in got])[o]

    def put_back(self, rank: int) -> None:
        """What the last ``pop`` took from ``rank`` on is as if it had not been taken."""
        for x, start in self.taken:
            x[2] = start + int(np.searchsorted(x[0][start : x[2]], rank))
        self.runs = [x for x, _ in self.taken if x[2] < len(x[0])]


def types(text: np.ndarray, space: Space) -> np.ndarray:
    """True at S suffixes; the last is S."""
    n = len(text)
    s = space.array(n, bool)
    s[n - 1] = after = True
    for a, b in reversed(list(space.blocks(n - 1))):
        x = np.asarray(text[a : b + 1]).astype(np.int64)
        step = np.sign(x[1:] - x[:-1])
        at = np.where(step != 0, np.arange(b - a), b - a)
        at = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal symbols ends
        s[a:b] = np.append(step > 0, after)[at]
        after = bool(s[a])
    return s


def leftmost(s: np.ndarray, space: Space) -> np.ndarray:
    """Places of LMS suffixes."""
    found = lambda a, b: np.flatnonzero(s[a + 1 : b + 1] & ~s[a:b]) + a + 1
    out, at = space.array(sum(len(found(a, b)) for a, b in space.blocks(len(s) - 1)), np.int64), 0
    for a, b in space.blocks(len(s) - 1):
        x = found(a, b)
        out[at : at + len(x)] = x
        at += len(x)
    return out


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, at most ``cap``, of which ``known`` symbols are known to agree."""
    out, on, last = np.minimum(known, cap), np.arange(len(a)), len(text) - 1
    on = on[out < cap]
    while len(on):
        x, y = a[on] + out[on], b[on] + out[on]
        on = on[(np.maximum(x, y) <= last) & (text[np.minimum(x, last)] == text[np.minimum(y, last)])]
        out[on] += 1
        on = on[out[on] < cap]
    return out


def range_min(e: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of e[lo..hi], ends included, by tables of doubling width."""
    out, level, width = np.empty(len(lo), e.dtype), e, 1
    k = np.frexp(hi - lo + 1)[1] - 1
    for step in range(int(k.max()) + 1 if len(k) else 0):
        some = np.flatnonzero(k == step)
        out[some] = np.minimum(level[lo[some]], level[hi[some] - width + 1])
        level, width = np.minimum(level[:-width], level[width:]), width * 2
    return out


def run_rounds(kind: np.ndarray, p: np.ndarray, e: np.ndarray | None, open_: int, cap: int, most: int) -> tuple[np.ndarray, np.ndarray | None] | None:
    """What the suffixes ``p`` of one key, all that wait for it, bring to that same key: those one symbol longer, those two symbols longer and so on,
    each in the order of ``p``; and their common prefixes, from ``e`` and, for the first, what is shared since the last of ``p`` was induced
    (``open_``). None above ``most`` of them."""
    places, lengths, n = [], [], 0
    while True:
        before = np.maximum(p - 1, 0)
        on = np.flatnonzero((p > 0) & (kind[before] == kind[p[0]]))
        if not len(on):
            break
        if e is not None:
            least = np.minimum.reduceat(e[: on[-1] + 1], np.append(0, on[:-1] + 1))
            least[0] = min(int(least[0]), open_)
            open_ = int(e[on[-1] + 1 :].min(initial=cap))
            e = np.minimum(least + 1, cap)
            lengths.append(e)
        p = before[on]
        places.append(p)
        n += len(p)
        if n > most:
            return None
    return np.concatenate(places), np.concatenate(lengths) if e is not None else None


def induce(text: np.ndarray, kind: np.ndarray, down: bool, seeds: np.ndarray, shared: np.ndarray | None, total: int, cap: int, space: Space) -> tuple[np.ndarray, np.ndarray | None]:
    """The ``total`` suffixes that ``seeds`` (in order, with their common prefixes) are and bring, in order: ascending with L suffixes
    induced, or ``down`` with S suffixes (``kind``: twice the symbol, plus 1 at S suffixes); and what each shares with the one before it (nothing is carried where ``shared`` is None)."""
    n, bits = len(text), (len(text) + len(seeds)).bit_length()
    carry, wide = shared is not None, max(1, cap).bit_length()
    sign = -1 if down else 1
    q, seq, about = Queue(space), 0, 4096
    for a, b in space.blocks(len(seeds)):
        p = np.asarray(seeds[a:b])
        rank, item = sign * kind[p].astype(np.int64) << bits | np.arange(seq, seq + b - a), p << wide | (shared[a:b] if carry else 0)
        o = np.argsort(rank, kind="stable")
        q.push(rank[o], item[o])
        seq += b - a
    out, common_ = space.array(total, np.int64), space.array(total, np.int32) if carry else None
    done, last, last_key, too_long = 0, -1, None, None
    open_keys, open_least = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while q.runs:
        rank, item = q.pop(min(about, space.memory))
        p = item >> wide
        before = np.maximum(p - 1, 0)
        own = kind[before].astype(np.int64)
        ok = (p > 0) & (own & 1 == down)
        own *= sign
        made = np.where(ok, own << bits | (seq + np.cumsum(ok) - 1), np.iinfo(np.int64).max)
        early = np.minimum.accumulate(made) < rank
        cut = int(early.argmax()) if early.any() else len(rank)
        about = min(1 << 20, about * 2) if cut == len(rank) else max(2048, min(about, cut * 2))
        if cut < len(rank):
            q.put_back(rank[cut])
            rank, item, p, ok, own, made = rank[:cut], item[:cut], p[:cut], ok[:cut], own[:cut], made[:cut]
        key = rank >> bits
        if carry:
            old, old_key = np.append(last, p[:-1]), np.append(key[0] - 4 if last_key is None else last_key, key[:-1])
            e = np.where(key == old_key, item & ((1 << wide) - 1), 0)
            turn = np.flatnonzero((key != old_key) & ((sign * key) >> 1 == (sign * old_key) >> 1))
            e[turn] = common(text, old[turn], p[turn], np.ones(len(turn), np.int64), cap)
        # A run of equal symbols would leave the queue one symbol at a time: where all tuples of the last key are at hand, its runs are followed here.
        own = own[:cut]
        again = np.flatnonzero(ok & (own == key[-1]))
        if len(again) and key[-1] != too_long and key[again[0]] == key[-1] and not any(x[0][x[2]] >> bits == key[-1] for x in q.runs):
            from_ = int(np.searchsorted(key, key[-1]))
            k = np.searchsorted(open_keys, key[-1])
            least = open_least[k] if k < len(open_keys) and open_keys[k] == key[-1] else 0
            rounds = run_rounds(kind, p[from_:], e[from_:] if carry else None, min(int(least), int(e[:from_].min(initial=cap))) if carry else 0, cap, space.memory)
            if rounds is None:
                too_long = key[-1]
            else:
                ok[again] = False
                more = rounds[0]
                before_more = np.maximum(more - 1, 0)
                own_more = sign * kind[before_more].astype(np.int64)
                ok_more = (more > 0) & (own_more & 1 == down) & (own_more != key[-1])
                p, key, own = np.append(p, more), np.append(key, np.full(len(more), key[-1])), np.append(own, own_more)
                ok, before = np.append(ok, ok_more), np.append(before[:cut], before_more)
                if carry:
                    e = np.append(e, rounds[1])
                cut += len(more)
                made = np.where(ok, own << bits | (seq + np.cumsum(ok) - 1), np.iinfo(np.int64).max)
        out[done : done + cut] = p
        pushed = np.flatnonzero(ok)
        o = np.argsort(made[pushed])
        to, at = own[pushed[o]], pushed[o]
        lengths: np.ndarray | int = 0
        if carry:
            common_[done : done + cut] = e
            last, last_key = p[-1], key[-1]
            # What an induced suffix shares with the one of its key before it.
            head = np.append(True, to[1:] != to[:-1]) if len(to) else np.zeros(0, bool)
            least = np.zeros(len(to), np.int64)
            mid = np.flatnonzero(~head)
            least[mid] = range_min(e, at[mid - 1] + 1, at[mid])
            first = np.flatnonzero(head)
            ahead, behind = np.minimum.accumulate(e), np.append(np.minimum.accumulate(e[::-1])[::-1], np.iinfo(np.int64).max)
            if len(open_keys) and len(first):
                k = np.minimum(np.searchsorted(open_keys, to[first]), len(open_keys) - 1)
                least[first] = np.where(open_keys[k] == to[first], np.minimum(open_least[k], ahead[at[first]]), 0)
            lengths = np.minimum(least + 1, cap)
            # Keys whose next tuple may share more than a symbol with their last one: the suffixes since then share some.
            ends = np.append(first[1:], len(to)) - 1 if len(first) else first
            k = np.searchsorted(to[first], open_keys)
            stay = np.append(to[first], np.iinfo(np.int64).max)[k] != open_keys
            keys = np.concatenate([open_keys[stay], to[first]])
            low = np.concatenate([np.minimum(open_least[stay], ahead[-1]), behind[at[ends] + 1]])
            keys, low = keys[low > 0], low[low > 0]
            o = np.argsort(keys, kind="stable")
            open_keys, open_least = keys[o], low[o]
        q.push(made[at], before[at] << wide | lengths)
        seq += len(pushed)
        done += cut
    return out, common_


def names(text: np.ndarray, lms: np.ndarray, s: np.ndarray, space: Space) -> tuple[np.ndarray, int]:
    """Dense ranks of the LMS substrings in the order of their places, and how many there are: the suffixes are induced from unsorted LMS suffixes,
    which sorts them by LMS substrings, and neighbours are compared."""
    n = len(lms)
    if space.folder is None or len(text) <= space.memory:
        rank = packed_names(np.asarray(text), np.asarray(lms))
        return rank, int(rank.max()) + 1
    order = _sorted(text, s, lms, None, 0, space)[0]
    out, place, at = space.array(n, np.int64), space.array(n, np.int64), 0
    for a, b in space.blocks(len(text)):
        p = np.asarray(order[a:b])
        p = p[(p > 0) & s[p] & ~s[np.maximum(p - 1, 0)]]
        place[at : at + len(p)] = p
        at += len(p)
    del order
    many, last = 0, -1
    for a, b in space.blocks(n):
        p = np.asarray(place[a:b])
        old = np.append(last, p[:-1])
        k, j = np.searchsorted(lms, p), np.searchsorted(lms, old)
        end = lambda i: np.where(i + 1 < n, lms[np.minimum(i + 1, n - 1)], lms[np.minimum(i, n - 1)])
        size, with_ = end(k) - p, end(j) - old
        same = (size == with_) & (size > 0) & (old >= 0)
        on = np.flatnonzero(same)
        step = 0
        while len(on):
            differ = text[p[on] + step] != text[old[on] + step]
            same[on[differ]] = False
            step += 1
            on = on[~differ]
            on = on[size[on] >= step]  # the first symbol of the next LMS substring counts
        rank = np.cumsum(~same) + many
        out[k] = rank - 1
        many, last = int(rank[-1]), p[-1]
    for a, b in space.blocks(n):  # the greatest came first
        out[a:b] = many - 1 - out[a:b]
    return out, many


def packed_names(text: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same in memory: several symbols at a time, of which each round sorts what is still equal. A substring that ends where another
    goes on is the greater, as its last symbol is of type S."""
    n = len(lms)
    size = np.append(np.diff(lms) + 1, 1)
    high = int(text.max()) + 1
    bits = (high + 1).bit_length()
    per = max(1, 62 // bits)
    rank, active, done, last = np.zeros(n, np.int64), np.arange(n), 0, len(text) - 1
    while len(active):
        at, left = lms[active], size[active] - done
        packed = np.zeros(len(active), np.int64)
        for k in range(per):
            c = text[np.minimum(at + (done + k), last)].astype(np.int64)
            packed = (packed << bits) | np.where(left > k, c, high)
        done += per
        o = np.lexsort((packed, rank[active])) if done > per else np.argsort(packed)
        r, p = rank[active][o], packed[o]
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])))
        group = np.concatenate(([True], r[1:] != r[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
        base = np.maximum.accumulate(np.where(group, np.arange(len(o)), 0))
        rank[active[o]] = r + start - base
        edge = np.append(np.flatnonzero(new), len(o))
        many = np.repeat(np.diff(edge) > 1, np.diff(edge))
        more = np.maximum.reduceat(size[active[o]], edge[:-1]) > done
        active = np.sort(active[o[many & np.repeat(more, np.diff(edge))]])
    used = np.zeros(n, np.int64)
    used[rank] = 1
    return (np.cumsum(used) - 1)[rank]


def _sorted(text: np.ndarray, s: np.ndarray, lms: np.ndarray, shared: np.ndarray | None, cap: int, space: Space) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes from LMS suffixes in order (with what each shares with the one before): greatest first, with what each shares with the one before it."""
    n, carry = len(text), shared is not None
    kind = space.array(n, text.dtype)
    for a, b in space.blocks(n):
        kind[a:b] = 2 * text[a:b] + s[a:b]
    up, up_shared = induce(text, kind, False, lms, shared, len(lms) + sum(int((~s[a:b]).sum()) for a, b in space.blocks(n)), cap, space)
    left, left_shared = space.array(n - sum(int(s[a:b].sum()) for a, b in space.blocks(n)) + 1, np.int64), space.array(len(up) + 1, np.int32) if carry else None
    # L suffixes, greatest first. Those of a symbol follow each other, so what a suffix shares with the next greater one is what came with that one.
    at, after = 0, 0
    for a, b in reversed(list(space.blocks(len(up)))):
        p = np.asarray(up[a:b])[::-1]
        large = ~s[p]
        left[at : at + int(large.sum())] = p[large]
        if carry:
            with_ = np.append(after, up_shared[a:b][::-1][:-1])
            left_shared[at : at + int(large.sum())] = with_[large]
            after = up_shared[a]
        at += int(large.sum())
    left[at] = n - 1  # of type S and no one's predecessor: the last of all
    if carry:
        left_shared[at] = 0
        left_shared = left_shared[: at + 1]
    return induce(text, kind, True, left, left_shared, n, cap, space)


def suffix_array(text: np.ndarray, cap: int, space: Space | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of all suffixes of ``text`` (integers; the last is the only least one) in order, and what each shares with the one before it."""
    space = space or Space()
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int32)
    s = types(text, space)
    lms = leftmost(s, space)
    name, many = names(text, lms, s, space)
    if many == len(lms):
        turn, shared = space.array(many, np.int64), space.array(many, np.int32)
        for a, b in space.blocks(many):
            turn[name[a:b]] = np.arange(a, b)
            shared[a:b] = 0
    else:
        turn, shared = suffix_array(name, cap, space)
    del name
    # From names to symbols, and on to where two names differ.
    seeds, seed_shared, last = space.array(len(lms), np.int64), space.array(len(lms), np.int32), len(lms) - 1
    for a, b in space.blocks(len(lms)):
        r, m = np.asarray(turn[a:b]), np.asarray(shared[a:b]).astype(np.int64)
        p = lms[r]
        old = np.append(lms[turn[a - 1]] if a else p[0], p[:-1])
        seeds[a:b] = p
        seed_shared[a:b] = common(text, old, p, lms[np.minimum(r + m, last)] - p, cap)
    if len(lms):
        seed_shared[0] = 0
    down, with_ = _sorted(text, s, seeds, seed_shared, cap, space)
    order, out = space.array(n, np.int64), space.array(n, np.int32)
    for a, b in space.blocks(n):
        order[a:b] = down[n - b : n - a][::-1]
        out[a + (a == 0) : b] = with_[n - b + 1 : n - a + (a > 0)][::-1]
    out[0] = 0
    return order, out


def repeated(order: np.ndarray, shared: np.ndarray, starts: np.ndarray, length: int, space: Space | None = None) -> np.ndarray:
    """True at the places of ``starts`` (a mask) whose ``length`` symbols are those of another such place: neighbours among them in suffix order
    share as much as the least that is shared between them."""
    space = space or Space()
    out = space.array(len(order), bool)
    for a, b in space.blocks(len(order)):
        out[a:b] = False
    last, least = -1, 0  # the start before, and what has been shared since
    for a, b in space.blocks(len(order)):
        p, e = np.asarray(order[a:b]), np.asarray(shared[a:b])
        at = np.flatnonzero(starts[p])
        if not len(at):
            least = min(least, int(e.min()))
            continue
        low = np.minimum.reduceat(e[: at[-1] + 1], np.append(0, at[:-1] + 1))
        low[0] = min(int(low[0]), least) if last >= 0 else 0
        mine = p[at]
        old = np.append(last, mine[:-1])
        both = low >= length
        out[mine[both]] = True
        out[old[both]] = True
        last, least = int(mine[-1]), int(e[at[-1] + 1 :].min(initial=np.iinfo(np.int32).max))
    return out
