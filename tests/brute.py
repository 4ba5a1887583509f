"""The detectors' definitions, tried out on all candidates of small inputs, one key at a time.

Rows are dicts with t (any integer unit), tie and whatever the predicates read.
"""

import itertools
import math


def ordered(rows):
    return sorted(rows, key=lambda r: (r["t"], r["tie"]))


def disjoint(candidates):
    """Of (first, last, value) intervals, one per start and in any order: the first, then
    the first that starts after its end, and so on."""
    out, end = [], -1
    for first, last, value in sorted(candidates, key=lambda c: c[0]):
        if first > end:
            out.append(value)
            end = last
    return out


def bursts(rows, within, need, tally):
    """Windows opened by each row, of those in which the tally of some prefix suffices."""
    rows = ordered(rows)
    candidates = []
    for i, r in enumerate(rows):
        n = sum(1 for x in rows[i:] if x["t"] - r["t"] <= within)
        window = rows[i : i + n]
        if any(tally(window[: k + 1]) >= need for k in range(n)):
            candidates.append((i, i + n - 1, window))
    return disjoint(candidates)


def sequences(rows, within, steps):
    """steps: [(test, need)]; the evidence rows of each match.

    From an anchor row, step k + 1 begins at the first row of its kind once step k has its
    `need` rows; the match ends when the last step has enough.
    """
    rows = ordered(rows)
    candidates = []
    for i, anchor in enumerate(rows):
        if not steps[0][0](anchor):
            continue
        window = [j for j in range(i, len(rows)) if rows[j]["t"] - anchor["t"] <= within]
        begins = [i]
        for (test, need), (following, _) in itertools.pairwise(steps):
            own = [j for j in window if j >= begins[-1] and test(rows[j])]
            enough = own[need - 1] if len(own) >= need else len(rows)
            begins.append(next((j for j in window if j > enough and following(rows[j])), len(rows)))
        last, need = steps[-1]
        final = [j for j in window if j >= begins[-1] and last(rows[j])][:need]
        if len(final) < need:
            continue
        spans = [*itertools.pairwise(begins), (begins[-1], final[-1] + 1)]
        taken = [
            rows[j]
            for (a, b), (test, _) in zip(spans, steps, strict=True)
            for j in range(a, b)
            if test(rows[j])
        ]
        candidates.append((i, final[-1], taken))
    return disjoint(candidates)


def unit(place):
    lat, lon = map(math.radians, place)
    return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)


def km_between(a, b):
    """By the chord between points of the unit sphere."""
    return 2 * 6371 * math.asin(min(1.0, math.dist(unit(a), unit(b)) / 2))


def travels(rows, within, min_km, min_kmh, hour, place):
    """Pairs of neighbours with places that no one can reach in the time between."""

    def possible(a, b):
        gap = b["t"] - a["t"]
        ends = place(a["ip"]), place(b["ip"])
        if a["ip"] == b["ip"] or gap <= 0 or gap > within or None in ends:
            return True
        km = km_between(*ends)
        return km < min_km or km * hour < min_kmh * gap

    return [list(p) for p in itertools.pairwise(ordered(rows)) if not possible(*p)]


def fold(matches, within):
    """Connected runs of matches: those whose spans, lengthened by `within`, touch."""
    spans = sorted(matches, key=lambda m: m[0]["t"])
    reach = list(itertools.accumulate((m[-1]["t"] + within for m in spans), max))
    fresh = [i == 0 or m[0]["t"] > reach[i - 1] for i, m in enumerate(spans)]
    number = list(itertools.accumulate(fresh))
    return [[m for m, n in zip(spans, number, strict=True) if n == k] for k in sorted(set(number))]


def merged(group):
    """Evidence of an alert: per raw text and time, the rows of the first match that has it."""
    owner = {}
    for i, m in enumerate(group):
        for r in m:
            owner.setdefault((r["raw"], r["t"]), i)
    return ordered(r for i, m in enumerate(group) for r in m if owner[r["raw"], r["t"]] == i)
