"""Matching of one block: greedy with one step of look-ahead.

All positions before the current one are candidates as soon as they are passed, so
the chain of a position (earlier positions with the same bucket, latest first) and
its best match do not depend on how the block is parsed. Best matches of all positions
are found together: sorts by three, four and up to eight bytes tell the nearest
candidate for each length, and only positions with eight bytes in common go back in a
chain, that of their eight bytes. The parse is then a walk over arrays.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np

from bytegrain.functions.kernels import bucket

WINDOW, LONGEST, SHORTEST, LAZY_BELOW = 32768, 258, 3, 8
#: The index keeps so many of the last positions of a bucket in an entry.
INDEX_DEPTH = 96


@dataclass
class Tokens:
    """length[i] is 0 for a literal (value[i] its byte), else a match at distance value[i]."""

    length: np.ndarray
    value: np.ndarray
    from_window: int = 0
    from_index: int = 0

    def __len__(self) -> int:
        return len(self.length)


def indexed_positions(data: np.ndarray, stride: int) -> np.ndarray:
    """Which positions of an entry its pattern index holds: every stride-th, the last INDEX_DEPTH of each bucket."""
    held = np.zeros(len(data), bool)
    keys = bucket(data)[::stride]
    order = np.argsort(keys, kind="stable")[::-1]
    sorted_keys = keys[order]
    begins = np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1)) if len(keys) else np.zeros(0, np.int64)
    rank = np.arange(len(keys)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(keys)]))))
    held[order[rank < INDEX_DEPTH] * stride] = True
    return held


@dataclass
class Candidates:
    """Positions grouped by their three bytes, in order inside a group.

    A bucket has positions of several groups. Only those of a position's own group can
    match, but all of its bucket count as tried: rank tells how many there are before.
    """

    order: np.ndarray  # all positions, grouped
    positions: np.ndarray  # those that may be matched, grouped
    before: np.ndarray  # for each position how many of `positions` lie before it,
    own: np.ndarray  # how many of these are in its group,
    rank: np.ndarray  # and how many in its bucket
    adjacent: np.ndarray  # whether the position just before is the latest of its bucket


def _passed(order: np.ndarray, new: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position of groups in order (new: where one begins): how many held ones lie before it, in all and in its group."""
    passed = np.cumsum(held) - held
    before, own = np.empty((2, len(order)), np.int64)
    before[order] = passed
    own[order] = passed - passed[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return before, own


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in groups of equal keys (of 16 bits), in order inside a group; and where one begins."""
    order = np.argsort(keys[0], kind="stable")
    for k in keys[1:]:
        order = order[np.argsort(k[order], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, new


def _candidates(data: np.ndarray, block: np.ndarray, member: np.ndarray) -> Candidates:
    """Candidates (of the members, in its own block) for all positions but the last two."""
    keys, rest, block = bucket(data).astype(np.uint16), data[:-2] | (data[1:-1] >> 7).astype(np.uint16) << 8, block[: len(data) - 2]
    many = [block] if len(block) and block[-1] else []
    order, new = _grouped(keys, *many)
    _, rank = _passed(order, new, member[order])
    order, new = _grouped(rest, keys, *many)
    held = member[order]
    before, own = _passed(order, new, held)
    return Candidates(order, order[held], before, own, rank, np.concatenate(([False], member[:-1] & (keys[1:] == keys[:-1]))))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number, the first byte lowest."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,)).astype(np.uint64)


def _first_difference(x: np.ndarray) -> np.ndarray:
    """Equal bytes before the first that differs, of numbers of eight bytes that aren't 0."""
    return np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3


def _common(eights: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal bytes from a and from b, up to most."""
    out, at = most.copy(), None
    for done in range(0, LONGEST, 8):
        x = eights[a + done] ^ eights[b + done]
        differ = np.flatnonzero(x)
        if len(differ):
            out[differ if at is None else at[differ]] = done + _first_difference(x[differ])
        more = np.flatnonzero((x == 0) & (most > done + 8))
        if not len(more):
            break
        at = more if at is None else at[more]
        a, b, most = a[more], b[more], most[more]
    return out


#: By a known length (up to seven): the bytes that a longer match has in common, as bits of a number of eight bytes.
_LONGER = np.array([(1 << 8 * (k + 1)) - 1 for k in range(8)], np.uint64)


def _best(data: np.ndarray, eights: np.ndarray, room: np.ndarray, found: Candidates, wanted: np.ndarray, budget: np.ndarray, enough: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the wanted positions: length and distance of the best match among `budget` candidates (the longest, the nearest of equals; 0 if none), and
    its length if the position just before isn't a candidate yet and another may be tried instead. room: the longest match that fits.

    Positions are held grouped as the candidates are, so a step back in all chains reads one array nearly in
    order, and a candidate that isn't better mostly fails on its first eight bytes.
    """
    length, distance = np.full(len(wanted), SHORTEST - 1), np.zeros(len(wanted), np.int64)
    ahead = np.zeros(len(wanted), np.int64)
    at = found.order[wanted[found.order] & (found.own[found.order] > 0)]
    c, left = found.before[at] - 1, found.own[at]
    others = eights[found.positions]
    mine, longer = eights[at], np.full(len(at), _LONGER[SHORTEST - 1])
    limit = np.minimum(enough[at], room[at])
    # a match at distance 1 has one byte, so leaving that candidate out only makes room for one more
    last = found.rank[at] - budget[at]
    furthest = last - found.adjacent[at]
    for step in itertools.count():
        if step % 4 == 0 or step < 3:
            b = found.positions.take(c, mode="clip")
            keep = (left > step) & (length[at] < limit) & (at - b <= WINDOW) & (found.rank[b] >= furthest)
            if not keep.all():
                at, c, left, mine, longer, limit, last, furthest = (x[keep] for x in (at, c, left, mine, longer, limit, last, furthest))
            if not len(at):
                break
        i = np.flatnonzero(((others.take(c, mode="clip") ^ mine) & longer) == 0)
        if len(i):
            a, b = at[i], found.positions.take(c[i], mode="clip")
            apart, known, rank = a - b, length[a], found.rank[b]
            most = np.minimum(room[a], apart)
            may = (most > known) & (known < limit[i]) & (apart <= WINDOW) & (rank >= furthest[i])
            may[may] = data[b[may] + known[may]] == data[a[may] + known[may]]
            i, a, b, apart, known, most, rank = (x[may] for x in (i, a, b, apart, known, most, rank))
            got = np.minimum(_common(eights, b, a, most), most)
            better = got > known
            i, a, apart, got = i[better], a[better], apart[better], got[better]
            tried = rank[better] >= last[i]
            ahead[a[~tried]] = got[~tried]
            i, a, apart, got = i[tried], a[tried], apart[tried], got[tried]
            length[a], distance[a] = got, apart
            longer[i] = _LONGER[np.minimum(got, 7)]
        c -= 1
    length = np.where(distance > 0, length, 0)
    return length, distance, np.maximum(length, ahead)


#: Up to this length sorts find the nearest candidate; beyond it, chains of positions with so many equal bytes are walked.
SORTED = 8


class _Search:
    """One of several searches over the same candidates: its bounds, and what it has found where it ended before the widest one."""

    def __init__(self, oldest: np.ndarray, limit: np.ndarray, widest: np.ndarray) -> None:
        self.oldest, self.limit, self.ended = oldest, limit, np.zeros(len(limit), bool)
        self.length, self.source = np.zeros((2, len(limit)), np.int32)
        self.shorter = (limit < widest) & (limit <= SORTED)
        self.any_shorter = bool(self.shorter.any())

    def end(self, at: np.ndarray, length: np.ndarray, source: np.ndarray) -> None:
        self.length[at], self.source[at], self.ended[at] = length[at], source[at], True


def _nearest_each(data: np.ndarray, eights: np.ndarray, room: np.ndarray, first: np.ndarray, whole: np.ndarray, wanted: np.ndarray, bounds: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What _best() finds where every whole position is a candidate, for each search (budget, enough). first: where a position's data begin.

    A match of a length needs a candidate so far away and with so many equal bytes. The nearest such one is also the first to be within the
    window and the budget, so a length is possible if it is, and a greater length is possible only if a smaller one is.

    So a search finds what one with wider bounds finds, up to the first candidate beyond its own. The widest is run, and each search keeps
    what is found where it ends.
    """
    m = len(data) - 2
    bits = m.bit_length() + 1
    place = (1 << bits) - 1
    every, buckets = np.flatnonzero(whole), bucket(data)
    by_bucket = np.sort(buckets[every] << bits | every)
    new = np.ones(len(every), bool)
    new[1:] = (by_bucket[1:] >> bits) != (by_bucket[:-1] >> bits)
    by_bucket &= place
    # a position's candidates: those of its bucket from `oldest` on
    row = np.arange(len(every))
    begin = np.maximum.accumulate(np.where(new, row, 0))
    least = np.maximum(first[:m], np.arange(m) - WINDOW)
    room = room[:m].astype(np.int32)

    def oldest_of(budget: np.ndarray) -> np.ndarray:
        reach, out = row - budget[by_bucket], np.zeros(m, np.int64)
        out[by_bucket] = np.where(reach > begin, by_bucket[np.maximum(reach, 0)], 0)
        return np.maximum(out, least).astype(np.int32)

    def limit_of(enough: np.ndarray) -> np.ndarray:
        return np.minimum(enough[:m], room).astype(np.int32)

    if len(bounds) == 1:
        oldest, limit, searches = oldest_of(bounds[0][0]), limit_of(bounds[0][1]), []
    else:
        olds, limits = [oldest_of(budget) for budget, _ in bounds], [limit_of(enough) for _, enough in bounds]
        oldest, limit = np.minimum.reduce(olds), np.maximum.reduce(limits)
        searches = [_Search(o, x, limit) for o, x in zip(olds, limits, strict=True)]
    length, source = np.zeros(m, np.int32), np.zeros(m, np.int32)
    # keys: the bytes (or the number of a group of equal ones), the place, and whether a match is sought there
    keys = data[:-2].astype(np.int64) << 16
    keys |= data[1:-1].astype(np.int64) << 8
    keys |= data[2:]
    keys = keys[every] << bits | every << 1 | wanted[every]
    for n in range(SHORTEST, SORTED + 1):
        keys.sort()
        group, at = keys >> bits, (keys & place) >> 1
        low = oldest[at]
        linked = np.zeros(len(at), bool)
        linked[1:] = (group[1:] == group[:-1]) & (at[:-1] >= low[1:])
        i = np.flatnonzero(linked & ((keys & 1) != 0))
        a, c = at[i], i - 1
        b = at[c]
        overlap = np.flatnonzero(a - b < n)
        if len(overlap):
            o = i[overlap]
            c[overlap] = np.searchsorted(keys, group[o] << bits | (np.maximum(at[o] - n, 0) << 1) + 1, "right") - 1
            good = np.ones(len(i), bool)
            good[overlap] = (c[overlap] >= 0) & (group[c[overlap]] == group[o]) & (at[c[overlap]] >= low[o]) & (at[o] >= n)
            i, a, c = i[good], a[good], c[good]
            b = at[c]
        for s in searches:
            beyond = np.flatnonzero(b < s.oldest[a])
            s.end(a[beyond[~s.ended[a[beyond]]]], length, source)
            if s.any_shorter:
                full = np.flatnonzero(s.shorter[a] & (s.limit[a] <= n) & ~s.ended[a])
                x, y = a[full], b[full]
                far = np.minimum(room[x], x - y)
                s.length[x], s.source[x], s.ended[x] = np.minimum(_common(eights, y, x, far), far), y, True
        length[a], source[a] = n, b
        most = limit[a]
        if most.min(initial=LONGEST) <= n:
            full = most <= n
            x, y = a[full], b[full]
            far = np.minimum(room[x], x - y)
            length[x] = np.minimum(_common(eights, y, x, far), far)
            i, a, c = i[~full], a[~full], c[~full]
        if n == SORTED or not len(a):
            break
        near = linked
        keys &= -2
        keys[i] |= 1
        near[:-1] |= linked[1:]
        near &= room[at] > n
        number = np.empty(len(at), np.int64)
        number[0] = 0
        np.cumsum(group[1:] != group[:-1], out=number[1:])
        at, number = at[near], number[near]
        keys = (number << 8 | data[at + n]) << bits | keys[near] & place
    known, g, limits, lows, rooms = np.full(len(a), SORTED - 1), group[c], limit[a], oldest[a], room[a]
    while len(a):
        b = at[c]
        keep = (b >= lows) & (group[c] == g) & (c >= 0) & (known < limits)
        if not keep.all():
            a, b, c, g, known, limits, lows, rooms = (x[keep] for x in (a, b, c, g, known, limits, lows, rooms))
        most = np.minimum(rooms, a - b)
        i = np.flatnonzero((most > known) & (eights[b + (known - 7)] == eights[a + (known - 7)]))
        if len(i):
            x, y, far = a[i], b[i], most[i]
            got = np.minimum(_common(eights, y, x, far), far)
            better = got > known[i]
            i, x, y, got = i[better], x[better], y[better], got[better]
            for s in searches:
                s.end(x[((y < s.oldest[x]) | (length[x] >= s.limit[x])) & ~s.ended[x]], length, source)
            known[i], length[x], source[x] = got, got, y
        c = c - 1
    adjacent = np.flatnonzero((buckets[1:] == buckets[:-1]) & whole[:-1] & wanted[1:]) + 1
    of = np.zeros(m, np.int64)
    of[by_bucket] = row

    def found(budget: np.ndarray, limit: np.ndarray, length: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ahead = length.copy()
        # while the position just before isn't a candidate yet, the budget reaches one further
        i = adjacent[np.maximum(length[adjacent], SHORTEST - 1) < limit[adjacent]]
        if len(i):
            reach = of[i] - budget[i]
            more = reach > begin[of[i]]
            i, b = i[more], by_bucket[reach[more] - 1]
            far = np.minimum(room[i], i - b)
            may = (b >= first[i]) & (i - b <= WINDOW) & (far >= SHORTEST)
            i, b, far = i[may], b[may], far[may]
            got = np.minimum(_common(eights, b, i, far), far)
            ahead[i] = np.maximum(length[i], np.where(got >= SHORTEST, got, 0))
        return length, np.where(length > 0, np.arange(m) - source, 0), ahead

    if not searches:
        return [found(bounds[0][0], limit, length, source)]
    return [found(budget, s.limit, np.where(s.ended, s.length, length), np.where(s.ended, s.source, source)) for (budget, _), s in zip(bounds, searches, strict=True)]


def _nearest(data: np.ndarray, eights: np.ndarray, room: np.ndarray, first: np.ndarray, whole: np.ndarray, wanted: np.ndarray, budget: np.ndarray, enough: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _best() finds where every whole position is a candidate."""
    return _nearest_each(data, eights, room, first, whole, wanted, [(budget, enough)])[0]


@dataclass
class Task:
    """A block to match: data[start:], with what may be matched before it."""

    data: bytes
    start: int
    max_chain: int
    nice: int
    indexed: np.ndarray | None = None  # which positions the index holds


def tokenize_searches(tasks: list[Task], searches: list[list[tuple[int, int]]]) -> list[list[Tokens]]:
    """Tokens of each task's block for each of its searches (chain and nice, in place of the task's own). Blocks are matched side by side, each within its own data."""
    sizes = [len(t.data) for t in tasks]
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(t.data for t in tasks), np.uint8)
    n = len(raw)
    m = max(n - 2, 0)
    out, parses = [[] for _ in tasks], [None for _ in tasks]

    def each(values: list) -> np.ndarray:
        return np.repeat(np.array(values), sizes)

    block, room = each(range(len(tasks))).astype(np.uint16), np.minimum(LONGEST, each(ends) - np.arange(n))
    eights = _eights(raw)
    whole = room[:m] >= SHORTEST  # three bytes of its own block
    wanted = whole & (np.arange(m) >= each([e - s + t.start for e, s, t in zip(ends, sizes, tasks, strict=True)])[:m])
    held = None
    if any(t.indexed is not None for t in tasks):
        held = np.concatenate([t.indexed if t.indexed is not None else np.zeros(len(t.data), bool) for t in tasks])[:m]
    lanes = range(max(map(len, searches), default=0))
    bounds = [tuple(each([s[j][k] if j < len(s) else 0 for s in searches]) for k in (0, 1)) for j in lanes]
    found = _nearest_each(raw, eights, room, each(ends - sizes), whole, wanted, bounds) if m and bounds else [None for _ in lanes]
    for j, near, (_, nice) in zip(lanes, found, bounds, strict=True):
        best, far, ahead, by_index = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 2, np.int64), np.zeros(n + 1, bool)
        if m:
            best[:m], far[:m], ahead[:m] = near
            if held is not None:
                length, distance, _ = _best(raw, eights, room, _candidates(raw, block, held & whole), wanted & (best[:m] < nice[:m]), np.full(n, n), np.full(n, LONGEST + 1))
                # the index wins ties
                wins = (length > best[:m]) | ((length == best[:m]) & (length > 0) & (distance <= far[:m]))
                best[:m][wins], far[:m][wins], by_index[:m] = length[wins], distance[wins], wins
        # one step of look-ahead: a short match gives way to a longer one from the next position
        waits = np.zeros(n + 1, bool)
        waits[:n] = (best[:n] > 0) & (best[:n] < np.minimum(nice, LAZY_BELOW)) & (ahead[1 : n + 1] > best[:n])
        for i, (s, t, end) in enumerate(zip(searches, tasks, ends, strict=True)):
            if j < len(s):
                tokens, parses[i] = _parsed(raw, best, far, by_index, waits, int(end) - len(t.data) + t.start, int(end), parses[i])
                out[i].append(tokens)
    return out


def tokenize_all(tasks: list[Task]) -> list[Tokens]:
    """Tokens of each task's block."""
    return [found for found, in tokenize_searches(tasks, [[(t.max_chain, t.nice)] for t in tasks])]


def _stops(step: np.ndarray, like: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Where a parse from 0 stops. like: steps and stops of another parse; both go together from a common stop until their steps differ."""
    n, steps = len(step), memoryview(step)
    if like is None:
        pos, out = 0, []
        while pos < n:
            out.append(pos)
            pos += steps[pos]
        return np.array(out, np.int64)
    other, stops = like
    common = np.zeros(n, bool)
    common[stops] = True
    common, at, parts = common.tobytes(), 0, []
    for d in np.flatnonzero(step[stops] != other[stops]).tolist():
        if d < at:
            continue
        parts.append(stops[at : d + 1])
        pos, own = int(stops[d]), []
        pos += steps[pos]
        while pos < n and not common[pos]:
            own.append(pos)
            pos += steps[pos]
        parts.append(np.array(own, np.int64))
        at = int(np.searchsorted(stops, pos))
    return np.concatenate((*parts, stops[at:]))


def _parsed(raw: np.ndarray, best: np.ndarray, far: np.ndarray, by_index: np.ndarray, waits: np.ndarray, pos: int, end: int, like: tuple[np.ndarray, np.ndarray] | None) -> tuple[Tokens, tuple[np.ndarray, np.ndarray]]:
    """Tokens of raw[pos:end], and the parse's steps and stops."""
    step = np.where(waits[pos:end] | (best[pos:end] == 0), 1, best[pos:end])
    stops = _stops(step, like)
    v = stops + pos
    match = (best[v] > 0) & ~waits[v]
    own = v[match]
    return Tokens(np.where(match, best[v], 0).astype(np.uint16), np.where(match, far[v], raw[v] if len(v) else 0).astype(np.uint16), int((~by_index[own]).sum()), int(by_index[own].sum())), (step, stops)


def tokenize(data: bytes, start: int, max_chain: int, nice: int, indexed: np.ndarray | None = None) -> Tokens:
    """Tokens of data[start:]; what lies before start can be matched. indexed: which positions the index holds."""
    return tokenize_all([Task(data, start, max_chain, nice, indexed)])[0]
