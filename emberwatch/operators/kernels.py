"""Numpy kernels of the detectors, over rows in order of (rule, key, time), many keys at once.

A kernel finds candidate spans: every place at which a match could start, and where that match
would end. Ends never fall as starts rise. The greedy choice takes the first candidate and then
always the first that starts after the end of the one before; it follows pointers, which are
doubled instead of walked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWEST, HIGHEST = -(2**63), 2**63 - 1
KEY = ["rule_id", "entity_key"]
#: Rows that are worked on together, besides the rest of a group.
ROWS = 65_536


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = ROWS) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups, of about `rows` rows or one larger group."""
    ready: list[pa.RecordBatch] = []
    tail: list[pa.RecordBatch] = []  # rows of a group that may go on
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[-1] for k in keys]
        same = np.ones(batch.num_rows, dtype=bool)
        for k, value in zip(keys, last, strict=True):
            same &= pc.equal(batch.column(k), value).to_numpy(zero_copy_only=False)
        cut = batch.num_rows if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        if cut < batch.num_rows:
            ready += [*tail, batch.slice(0, cut)]
            size += sum(t.num_rows for t in tail) + cut
            tail = [batch.slice(cut)]
        elif tail and [tail[-1].column(k)[-1] for k in keys] != last:
            ready += tail
            size += sum(t.num_rows for t in tail)
            tail = [batch]
        else:
            tail.append(batch)
        if size >= rows:
            yield pa.Table.from_batches(ready).combine_chunks()
            ready, size = [], 0
    if ready or tail:
        yield pa.Table.from_batches([*ready, *tail]).combine_chunks()


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _codes(table: pa.Table, name: str) -> np.ndarray:
    """Small numbers for equal values; -1 for null."""
    coded = table.column(name).combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    return pc.fill_null(coded.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether each row begins a group."""
    change = np.zeros(len(table), dtype=bool)
    change[:1] = True
    for k in keys:
        change[1:] |= np.diff(_codes(table, k)) != 0
    return change


def amounts(table: pa.Table, name: str) -> np.ndarray:
    """Whole numbers: longs, or integers of any size in place of decimals, in millionths."""
    values = table.column(name)
    if pa.types.is_decimal(values.type):
        return np.array([int(v.scaleb(6)) for v in values.to_pylist()], dtype=object)
    return values.to_numpy().astype(np.int64)


def time_axis(t: np.ndarray, starts: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Times of all groups on one axis: gaps that no window bridges are shortened, groups kept apart.

    Two rows of a group are within w on it exactly if they are within w in time; rows of different
    groups never are.
    """
    if not len(t):
        return t
    widest = int(w.max()) + 1
    gap = np.minimum(np.diff(t, prepend=t[:1]), widest)
    gap[starts] = widest
    return np.cumsum(gap)


def chain(following: np.ndarray, first: int = 0) -> np.ndarray:
    """The places first, following[first], ... in order; a place beyond the end ends it."""
    m = len(following)
    if first >= m:
        return np.zeros(0, dtype=np.int64)
    hop, path = np.append(following, m), np.array([first])
    while True:
        more = hop[path]
        more = more[more < m]
        if not len(more):
            return np.sort(path)
        path, hop = np.concatenate([path, more]), hop[hop]


def chain_ends(following: np.ndarray) -> np.ndarray:
    """For each place, the last one of the chain that starts there."""
    m = len(following)
    hop = np.where(following < m, following, np.arange(m))
    while True:
        after = hop[hop]
        if (after == hop).all():
            return hop
        hop = after


class Found:
    """Candidates of a table in order.

    rows: each one's first row. The next choice is the first candidate whose `order` exceeds the
    `until` of this one. start, end: positions (time, tie). inside(taken) gives (which, row) of the
    rows that the taken ones hold, `which` counting candidates.
    """

    def __init__(
        self, table: pa.Table, rows: np.ndarray, order: np.ndarray, until: np.ndarray,
        start: tuple[np.ndarray, np.ndarray], end: tuple[np.ndarray, np.ndarray],
        inside: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], place: Sequence[str],
    ) -> None:
        self.table, self.rows, self.order, self.until = table, rows, order, until
        self.start, self.end, self.inside, self.place = start, end, inside, place

    def among(self, kept: np.ndarray) -> np.ndarray:
        """Places, among the kept candidates, of each one's next."""
        return np.searchsorted(self.order[kept], self.until[kept], side="right")

    def first_after(self, kept: np.ndarray, t: int, tie: int) -> int:
        """The place, among the kept candidates, of the first that starts after a position."""
        at, ties = self.start[0][kept], self.start[1][kept]
        low, high = np.searchsorted(at, t, side="left"), np.searchsorted(at, t, side="right")
        return int(low + np.searchsorted(ties[low:high], tie, side="right"))

    def output(self, taken: np.ndarray) -> pa.Table:
        """Rule, key, place and span of the rows inside; rows of one place are told once."""
        which, row = self.inside(taken)
        fresh = np.zeros(len(row), dtype=bool)
        fresh[:1] = True
        for values in (which, *(column(self.table, c)[row] for c in self.place)):
            fresh[1:] |= np.diff(values) != 0
        which, row = which[fresh], row[fresh]
        out = self.table.select([*KEY, *self.place]).take(pa.array(row))
        spans = {"s_t": self.start[0], "s_tie": self.start[1], "e_t": self.end[0], "e_tie": self.end[1]}
        for name, values in spans.items():
            out = out.append_column(name, pa.array(values[which], pa.int64()))
        return out


def _inside(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, row) for all rows first..last of each interval."""
    sizes = last - first + 1
    which = np.repeat(np.arange(len(first)), sizes)
    return which, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[which]


def bursts(table: pa.Table) -> Found:
    """Ticks whose window [t, t + w] reaches the need; output: the ticks inside taken windows.

    Rows (w, need, counts_values, t, counted, amount), in order of t. The tally of a window is what
    began up to its end less what ended before its start; a row begins and ends at its time, and of
    values that are counted once, a run of the same value with gaps of at most w does.
    """
    t, w = column(table, "t"), column(table, "w")
    on = amounts(table, "amount")
    scale = 1_000_000 if on.dtype == object else 1
    need = column(table, "need") * scale if scale == 1 else column(table, "need").astype(object) * scale
    starts = group_starts(table, KEY)
    axis = time_axis(t, starts, w)
    first, last = np.searchsorted(axis, axis, side="left"), np.searchsorted(axis, axis + w, side="right") - 1
    counted = column(table, "counts_values").astype(bool)
    off = on
    if counted.any():
        value, group = _codes(table, "counted"), np.cumsum(starts)
        by_value = np.lexsort((axis, value, group))
        near = (np.diff(value[by_value]) == 0) & (np.diff(group[by_value]) == 0) & (np.diff(axis[by_value]) <= w[by_value][1:])
        begins, ends = np.ones(len(t), dtype=bool), np.ones(len(t), dtype=bool)
        begins[by_value[1:]], ends[by_value[:-1]] = ~near, ~near
        real = value >= 0
        on, off = np.where(counted, (begins & real) * scale, on), np.where(counted, (ends & real) * scale, off)
    begun = np.concatenate([np.zeros(1, on.dtype), np.cumsum(on)])
    ended = np.concatenate([np.zeros(1, off.dtype), np.cumsum(off)])
    reached = (begun[last + 1] - ended[first] >= need) & (first == np.arange(len(t)))
    rows = np.flatnonzero(reached)

    def inside(taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which, row = _inside(rows[taken], last[rows[taken]])
        return taken[which], row

    none = np.full(len(rows), LOWEST), np.full(len(rows), HIGHEST)
    return Found(table, rows, axis[rows], (axis + w)[rows], (t[rows], none[0]), ((t + w)[rows], none[1]), inside, ["t"])


def rolling(table: pa.Table) -> Found:
    """Ticks at which the window [t - w, t] reaches the need; output: these ticks and the tally then."""
    t, w, need = column(table, "t"), column(table, "w"), column(table, "need")
    axis = time_axis(t, group_starts(table, KEY), w)
    summed = np.concatenate([[0], np.cumsum(column(table, "n"))])
    first, after = np.searchsorted(axis, axis, side="left"), np.searchsorted(axis, axis, side="right")
    before = summed[first] - summed[np.searchsorted(axis, axis - w, side="left")]
    rows = np.flatnonzero((before + summed[after] - summed[first] >= need) & (first == np.arange(len(t))))
    table = table.append_column("tally", pa.array(np.maximum(need, before + 1), pa.int64()))
    none = np.full(len(rows), LOWEST), np.full(len(rows), HIGHEST)
    return Found(
        table, rows, axis[rows], (axis + w)[rows], (t[rows], none[0]), ((t + w)[rows], none[1]),
        lambda taken: (taken, rows[taken]), ["t", "tally"],
    )


def _step_rows(mask: np.ndarray, group: np.ndarray, needs: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """First-step rows, and for each the first row of every later step and the last row (-1: none).

    From the last step to the first: a step's rows wait for as many of their kind as are needed,
    and then for the next step's first row.
    """
    later_rows = later = None
    for back, need in enumerate(reversed(needs)):
        rows = np.flatnonzero((mask >> back) & 1)
        nth = np.arange(len(rows)) + need - 1
        ok = nth < len(rows)
        at = rows[np.minimum(nth, max(len(rows) - 1, 0))] if len(rows) else rows
        ok &= group[at] == group[rows]
        if back == 0:
            found = at[:, None]
        elif not len(later_rows):
            found, ok = np.full((len(rows), back + 1), -1), np.zeros(len(rows), dtype=bool)
        else:
            place = np.searchsorted(later_rows, at, side="right")
            ok &= place < len(later_rows)
            place = np.minimum(place, len(later_rows) - 1)
            ok &= (group[later_rows[place]] == group[rows]) & (later[place, -1] >= 0)
            found = np.concatenate([later_rows[place][:, None], later[place]], axis=1)
        later_rows, later = rows, np.where(ok[:, None], found, -1)
    return later_rows, later


def sequences(needs: dict[str, list[int]]) -> Callable[[pa.Table], Found]:
    """Kernel for rules with these counts per step; output: the evidence rows of taken sequences.

    Rows (w, t, tie, mask) in order of (t, tie); bit 0 of the mask is the last step.
    """

    def kernel(table: pa.Table) -> Found:
        t, tie, w, mask = (column(table, c) for c in ("t", "tie", "w", "mask"))
        group = np.cumsum(group_starts(table, KEY))
        edges = [*np.flatnonzero(group_starts(table, KEY[:1])).tolist(), len(t)]
        rows, ends, parts = [], [], []
        for a, b in zip(edges, edges[1:], strict=False):
            need = needs[table.column("rule_id")[a].as_py()]
            start, steps = _step_rows(mask[a:b], group[a:b], need)
            whole = steps[:, -1] >= 0
            start, steps = start[whole] + a, steps[whole] + a
            soon = t[steps[:, -1]] - t[start] <= w[start]
            rows.append(start[soon])
            ends.append(steps[soon, -1])
            parts.append((len(need), steps[soon]))
        row, end = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, ends))
        bounds = np.cumsum([0, *(len(r) for r in rows)])

        def inside(taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            of, inner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for (n, steps), a, b in zip(parts, bounds, bounds[1:], strict=False):
                mine = taken[(taken >= a) & (taken < b)]
                which, at = _inside(row[mine], end[mine])
                opened = np.zeros(len(at), dtype=np.int64)
                for k in range(n - 1):  # the last column is the end
                    opened += steps[mine - a, k][which] <= at
                hit = (mask[at] >> (n - 1 - opened)) & 1 == 1
                of.append(mine[which[hit]])
                inner.append(at[hit])
            return np.concatenate(of), np.concatenate(inner)

        return Found(table, row, row, end, (t[row], tie[row]), (t[end], tie[end]), inside, ["t", "tie", "mask"])

    return kernel


def islands(table: pa.Table) -> np.ndarray:
    """The first_t of the first row of each row's island, for rows in order of first_t.

    A row joins the island before it if it begins at most w after anything in it ended. Rows end
    at most w after they begin.
    """
    first, last, w = (column(table, c) for c in ("first_t", "last_t", "w"))
    starts = group_starts(table, KEY)
    axis = time_axis(first, starts, 2 * w)
    reach = np.maximum.accumulate(axis + (last - first))
    fresh = starts.copy()
    fresh[1:] |= axis[1:] - reach[:-1] > w[1:]
    return first[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
