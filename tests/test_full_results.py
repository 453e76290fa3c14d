"""Whole results of queries that SQL can't say, against plain Python on the same tables."""

import itertools
import math

from waymark.operators import kernels
from waymark.plans import catalog, trajectory

FOLDER = "/root/testdata/sf0.01"


def _groups(rows):
    out = {}
    for r in rows:
        out.setdefault((r.vehicle, r.day), []).append(r)
    return out


def test_assignments(spark):
    pairs = _groups(trajectory._pairs(spark, FOLDER).collect())
    best = _groups(catalog.queries()["optimal_assignment"](spark, FOLDER).collect())
    greedy = _groups(catalog.queries()["greedy_assignment"](spark, FOLDER).collect())
    assert len(pairs) > 50 and set(best) == set(greedy) == set(pairs)
    for key, rows in pairs.items():
        cost = {(r.delivery, r.stop_id): r.cost for r in rows}
        got = [(r.delivery, r.stop_id) for r in best[key]]
        assert set(got) <= set(cost) and len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        left, right = sorted({a for a, _ in cost}), sorted({b for _, b in cost})
        if len(left) > len(right):
            left, right, cost = right, left, {(b, a): c for (a, b), c in cost.items()}
            got = [(b, a) for a, b in got]
        if math.perm(len(right), len(left)) <= 50_000:
            total = min(sum(cost.get((a, b), kernels.FORBIDDEN) for a, b in zip(left, p)) for p in itertools.permutations(right, len(left)))
            assert math.isclose(sum(cost[p] for p in got) + kernels.FORBIDDEN * (len(left) - len(got)), total), key
        taken, free = set(), []
        for r in sorted(rows, key=lambda r: (r.cost, r.delivery, r.stop_id)):
            if ("d", r.delivery) not in taken and ("s", r.stop_id) not in taken:
                taken |= {("d", r.delivery), ("s", r.stop_id)}
                free.append((r.delivery, r.stop_id))
        assert sorted((r.delivery, r.stop_id) for r in greedy[key]) == sorted(free), key


def _metres(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_route_lengths(spark):
    trips = _groups(trajectory._trips(spark, FOLDER).where("done").collect())
    got = {(r.vehicle, r.day): r for r in catalog.queries()["route_lengths"](spark, FOLDER).collect()}
    assert set(got) == set(trips) and len(got) > 100
    for key, rows in trips.items():
        length = lambda path: sum(_metres((a.lat, a.lng), (b.lat, b.lng)) for a, b in zip(path, path[1:]))
        drove = sorted(rows, key=lambda r: (r.arrive, r.planned))
        assert math.isclose(got[key].driven_m, length(drove), abs_tol=1e-6)
        if len({r.planned for r in rows}) == len(rows):
            assert math.isclose(got[key].planned_m, length(sorted(rows, key=lambda r: r.planned)), abs_tol=1e-6)
        if len(rows) <= 6:
            shortest = min(length([drove[0], *p]) for p in itertools.permutations(drove[1:]))
            assert shortest - 1e-6 <= got[key].short_m <= length(drove) + 1e-6
