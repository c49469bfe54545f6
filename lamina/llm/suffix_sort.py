"""Suffix arrays with common-prefix values by induced sorting, over arrays that move to disk when they are large.

The order of the S* suffixes (a smaller symbol follows a larger one) is found by recursion on a
string of their names; from it a priority queue induces the L suffixes in rising order, and from
those a second one the S suffixes in falling order.  A queue has one bucket a symbol, filled from
the front in the order in which its entries are induced, so that popping in order is reading on.
An entry is the tuple (place, common prefix with the entry before it in its bucket).  Entries are
popped many at a time: as many symbols as surely induce nothing among themselves.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

# Arrays of more than this many bytes are kept in unnamed files beside Spark's own spills.
MEMORY = 64 << 20


def room(size: int, dtype, memory: int) -> np.ndarray:
    """An array of zeros; on disk in the worker's spill folder when it is larger than ``memory`` bytes.

    The file has no name and goes with the array, or with the worker; nothing else reads it.
    """
    if size * np.dtype(dtype).itemsize <= memory:
        return np.zeros(size, dtype)
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    with tempfile.TemporaryFile(dir=folder) as file:
        return np.memmap(file, dtype, "w+", shape=(size,))


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, up to ``limit`` (a number or one a pair)."""
    length = np.zeros(len(a), np.int64)
    limit = np.broadcast_to(limit, len(a))
    alive = np.flatnonzero(limit > 0)
    step = 0
    while alive.size:
        alive = alive[text[a[alive] + step] == text[b[alive] + step]]
        step += 1
        length[alive] = step
        alive = alive[limit[alive] > step]
    return length


def _s_type(text: np.ndarray, memory: int) -> np.ndarray:
    """Whether the suffix at each place is smaller than the next one; the last one counts as such."""
    n = len(text)
    types = room(n, np.bool_, memory)
    types[n - 1] = True
    block, later = 1 << 20, True
    for begin in range((n - 2) // block * block, -1, -block):
        part = text[begin:min(begin + block, n - 1) + 1].astype(np.int64)
        rise = np.sign(np.diff(part))
        # an equal symbol has the type of the next place that differs
        last = np.where(rise != 0, np.arange(len(rise)), len(rise))
        last = np.minimum.accumulate(last[::-1])[::-1]
        types[begin:begin + len(rise)] = np.r_[rise > 0, later][last]
        later = bool(types[begin])
    return types


def _names(text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the substrings from each S* place to the next one, equal ones alike, and how many differ."""
    bits = int(text.max() + 2).bit_length()
    width, past = 63 // bits, (1 << bits) - 1
    lengths = np.r_[np.diff(places) + 1, 1]
    group = np.zeros(len(places), np.int64)
    active, step = np.arange(len(places)), 0
    while active.size:
        key = np.zeros(len(active), np.int64)
        for k in range(step, step + width):
            inside = lengths[active] > k
            # one that ends is larger than one that goes on
            symbol = np.full(len(active), past, np.int64)
            symbol[inside] = text[places[active[inside]] + k]
            key = key << bits | symbol
        order = np.lexsort((key, group[active]))
        active, key = active[order], key[order]
        old = group[active]
        at = np.arange(len(active))
        first = np.r_[True, old[1:] != old[:-1]]
        cut = first | np.r_[True, key[1:] != key[:-1]]
        begin = np.maximum.accumulate(np.where(cut, at, 0))
        group[active] = old + begin - np.maximum.accumulate(np.where(first, at, 0))
        # left are groups of several that go on; one that has just ended is still to be told from longer ones
        size = np.diff(np.r_[np.flatnonzero(cut), len(active)])
        step += width
        active = active[(np.repeat(size, size) > 1) & (lengths[active] >= step)]
    distinct, names = np.unique(group, return_inverse=True)
    return names, len(distinct)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where an entry differs from the one before; the first one does."""
    found = np.zeros(len(columns[0]), bool)
    found[:1] = True
    for column in columns:
        found[1:] |= column[1:] != column[:-1]
    return found


def _least(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least of ``values`` after the place of the entry before, up to the entry's own; void for the first and where places fall."""
    if not len(at):
        return at
    # a range ends where the next one begins, or at the end
    edges = at + 1
    return np.concatenate([[0], np.minimum.reduceat(np.concatenate([values, [0]]), edges)[:-1]])


def _by_symbol(symbols: np.ndarray, top: int) -> np.ndarray:
    """Stable order; short numbers are sorted by digits."""
    return np.argsort(symbols.astype(np.uint16) if top < 1 << 16 else symbols, kind="stable")


def _before(text, top, down, wanted, memory) -> np.ndarray:
    """For each place the symbol of the place before if that one is wanted, otherwise one past all."""
    found = room(len(text), np.int32, memory)
    found[0] = top + 1
    for begin in range(1, len(text), 1 << 20):
        part = slice(begin - 1, min(begin + (1 << 20), len(text)) - 1)
        symbols = top - text[part].astype(np.int64) if down else text[part]
        found[begin:part.stop + 1] = np.where(wanted[part], symbols, top + 1)
    return found


def _starts(text, top, down, places) -> np.ndarray:
    """Where each symbol begins among sorted places."""
    counts = np.zeros(top + 1, np.int64)
    for begin in range(0, len(places), 1 << 20):
        counts += np.bincount(text[places[begin:begin + (1 << 20)]], minlength=top + 1)
    return np.concatenate([[0], np.cumsum(counts[::-1] if down else counts)])


def _induce(text, top, down, wanted, counts, seeds, seed_common, limit, memory):
    """Entries of the wanted suffixes in order, with their common prefixes, induced from the seeds.

    ``down``: symbols and order are reversed.  ``counts``: wanted suffixes of each symbol.
    The seeds of a symbol come after its wanted suffixes.
    """
    before = _before(text, top, down, wanted, memory)
    bounds, seed_bounds = np.concatenate([[0], np.cumsum(counts)]), _starts(text, top, down, seeds)
    filled, work = bounds[:-1].copy(), bounds + seed_bounds
    queue, shared = room(int(bounds[-1]), np.int64, memory), room(int(bounds[-1]), np.int32, memory)

    low, ahead = 0, 64
    while low <= top:
        high = max(low, min(top, int(work.searchsorted(work[low] + ahead, "right")) - 2))
        # symbols low..high induce nothing among themselves if every symbol they induce is larger
        span = np.arange(low, high + 1)
        sizes = filled[low:high + 1] - bounds[low:high + 1]
        slots = np.arange(sizes.sum()) + (bounds[low:high + 1] - np.cumsum(sizes) + sizes).repeat(sizes)
        reach = np.minimum(
            _group_min(before[queue[slots]], sizes, top + 1),
            _group_min(before[seeds[seed_bounds[low]:seed_bounds[high + 1]]], np.diff(seed_bounds[low:high + 2]), top + 1),
        )
        free = int((np.minimum.accumulate(reach) > span).sum())
        if free:
            ahead = 2 * (ahead if free == high - low + 1 else int(work[low + free] - work[low])) + 64
            high = low + free - 1
        else:
            high = low
            _runs(low, int(bounds[low]), filled, queue, shared, before, limit)

        a, b = slice(bounds[low], bounds[high + 1]), slice(seed_bounds[low], seed_bounds[high + 1])
        single, split, low = high == low, a.stop - a.start, high + 1
        places = np.concatenate([queue[a], seeds[b]])
        if not places.size:
            continue
        values = np.concatenate([shared[a], seed_common[b]])
        if single:
            first = np.zeros(len(places), bool)
            first[0] = True
            seam = np.array([split] if 0 < split < len(places) else [], np.int64)
        else:
            own = text[places].astype(np.int64)
            order = _by_symbol(top - own if down else own, top)
            places, own, values = places[order], own[order], values[order]
            first, seeded = _changes(own), order >= split
            seam = np.flatnonzero(_changes(seeded) & seeded & ~first)
        values[first] = 0
        values[seam] = common(text, places[seam - 1], places[seam], limit)
        target = before[places]
        at = np.flatnonzero((target > high) & (target <= top))
        if not at.size:
            continue
        by = at[_by_symbol(target[at], top)]
        entries = target[by]
        new = _changes(entries)
        if single:
            least = _least(values, by)
            least[new] = 0
        else:
            # from different symbols only the induced symbol is common
            group = np.cumsum(first)
            near = np.lexsort((entries, group[by]))
            close = by[near]
            least = np.empty(len(by), np.int64)
            least[near] = np.where(_changes(target[close], group[close]), 0, _least(values, close))
        # into the buckets, in order
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(by)))
        slots = (filled[entries[begin]] - begin).repeat(sizes) + np.arange(len(by))
        queue[slots], shared[slots] = places[by] - 1, np.minimum(least + 1, limit)
        filled[entries[begin]] += sizes
    return queue, shared


def _group_min(values: np.ndarray, sizes: np.ndarray, empty: int) -> np.ndarray:
    found = np.full(len(sizes), empty, np.int64)
    some = np.flatnonzero(sizes)
    if some.size:
        found[some] = np.minimum.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return found


def _runs(low, begin, filled, queue, shared, before, limit) -> None:
    """Entries of a symbol that its own entries induce: runs of the symbol, one longer each round."""
    longer = 0
    while True:
        end = int(filled[low])
        places = queue[begin:end]
        at = np.flatnonzero(before[places] == low)
        if not at.size:
            return
        least = _least(shared[begin:end], at)
        least[0] = longer
        queue[end:end + len(at)], shared[end:end + len(at)] = places[at] - 1, np.minimum(least + 1, limit)
        filled[low] += len(at)
        begin, longer = end, longer + 1


def suffix_array(text: np.ndarray, limit: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes in order, and what each has in common with the one before, up to ``limit`` symbols.

    The last symbol must be the only 0.
    """
    n, top = len(text), int(text.max())
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int32)
    types = _s_type(text, memory)
    stars = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    names, distinct = _names(text, stars)
    if distinct == len(stars):
        order = np.argsort(names)
        starred = stars[order]
        shared = np.r_[0, common(text, starred[:-1], starred[1:], limit)]
    else:
        # two S* places are two symbols apart at least
        order, same = suffix_array(names, limit // 2 + 1, memory)
        starred, same = stars[order], same[1:].astype(np.int64)
        a, b = stars[order[:-1] + same], stars[order[1:] + same]
        base = np.minimum(a - starred[:-1], limit)
        shared = np.r_[0, base + common(text, a, b, limit - base)]
    sizes = np.zeros(top + 1, np.int64)
    larger = np.zeros(top + 1, np.int64)
    for begin in range(0, n, 1 << 20):
        part = slice(begin, begin + (1 << 20))
        sizes += np.bincount(text[part], minlength=top + 1)
        larger += np.bincount(text[part][types[part]], minlength=top + 1)
    larger[0] = 0  # nothing induces the last place
    falling, falling_shared = _induce(
        text, top, False, ~types, sizes - larger - (np.arange(top + 1) == 0), starred, shared, limit, memory
    )
    # the other way round, an entry's common prefix is that with the larger one
    ends = np.r_[falling_shared[1:], 0][::-1]
    only = types.copy()
    only[n - 1] = False
    rising, rising_shared = _induce(text, top, True, only, larger[::-1], falling[::-1], ends, limit, memory)
    rising, rising_shared = rising[::-1], np.r_[0, rising_shared[::-1][:-1]]
    # each symbol's L suffixes, then its S suffixes
    order = np.argsort(np.concatenate([text[falling], text[rising]]), kind="stable")
    places = np.concatenate([falling, rising])[order]
    values = np.concatenate([falling_shared, rising_shared])[order]
    first = np.r_[True, text[places[1:]] != text[places[:-1]]]
    values[first] = 0
    is_s = order >= len(falling)
    seam = np.flatnonzero(~first & is_s & ~np.r_[False, is_s[:-1]])
    values[seam] = common(text, places[seam - 1], places[seam], limit)
    return np.r_[n - 1, places], np.r_[0, values].astype(np.int32)
