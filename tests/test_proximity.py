import numpy as np
import pytest

from cellframe.domain import Domain
from cellframe.operators.coverage import Shape, classify, cover, quadric_bounds, regions_of_points
from cellframe.operators import coverage, proximity
from cellframe.operators.proximity import near_classes, near_pairs

D = Domain.cube(10.0, 10, (True, True, False))
POINTS = "id long, rx double, ry double, rz double, a string"
REGIONS = "region_id int, name string, id_start long, id_end long, bmin array<double>, bmax array<double>, quadric array<double>"


def frame(spark, points):
    return spark.createDataFrame([(i, *(None if v is None else float(v) for v in p), "x") for i, p in points], POINTS)


def brute(points, d):
    ids = [i for i, p in points if i is not None and all(v is not None and np.isfinite(v) for v in p)]
    r = np.array([p for i, p in points if i is not None and all(v is not None and np.isfinite(v) for v in p)], float).reshape(-1, 3)
    r[:, :2] = np.mod(r[:, :2], 10.0)
    out = set()
    for k in range(len(r)):
        g = np.abs(r - r[k])
        g[:, :2] = np.minimum(g[:, :2], 10.0 - g[:, :2])
        dist = np.sqrt((g * g).sum(1))
        out |= {(min(ids[k], ids[j]), max(ids[k], ids[j])) for j in np.flatnonzero((dist > 0) & (dist <= d)) if ids[j] != ids[k]}
    return out


@pytest.mark.parametrize("dense", [64, 4, 0])
def test_near_against_brute_force(spark, dense):
    rng = np.random.default_rng(2)
    points = [(i, p) for i, p in enumerate(np.r_[rng.normal(0, 0.15, (150, 3)) + [0, 9.95, 5], rng.uniform(0, 10, (150, 3)), np.tile([[5.0, 5, 5]], (40, 1)), [[5.0, 5, 5.05]]])]
    points += [(7, points[3][1]), (8, (None, 1, 1)), (None, points[0][1]), (9, (np.nan, 1, 1)), (10, (np.inf, 0, 0)), (11, (-9999.0,) * 3), (12, (1e300, 1, 1e300)), (13, (1e300, 1.05, 1e300))]
    got = {(r.a, r.b) for r in near_pairs(frame(spark, points), D, 0.1, dense).collect()}
    assert got == brute(points, 0.1)


def test_hot_positions(spark, monkeypatch):
    """A third of all ids at one place: the same pairs, and a compact form as long as the data."""
    monkeypatch.setattr(proximity, "heavy_keys", lambda counts, key, count, total: counts.where(f"{count} > 20").select(key))
    points = [(i, (5.0, 5.0, 5.0)) for i in range(60)] + [(100 + i, (5.0, 5.0, 5.0 + 0.001 * i)) for i in range(1, 40)] + [(200 + i, (0.01 * i, 9.99, 1.0)) for i in range(60)]
    got = [(r.a, r.b) for r in near_pairs(frame(spark, points), D, 0.1, 8).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(points, 0.1)
    links, members = near_classes(frame(spark, points), D, 0.1, 8)
    assert members.count() == len(points) and len({frozenset([tuple(r)[:3], tuple(r)[3:]]) for r in links.collect()}) == links.count() < len(got)


def test_many_regions_in_parts(spark, monkeypatch):
    monkeypatch.setattr(coverage, "PART_CELLS", 100)
    rng = np.random.default_rng(9)
    rows = [(i, "b", None, None, [float(x) for x in lo], [float(x) for x in lo + 2], None) for i, lo in enumerate(rng.uniform(0, 8, (30, 3)))]
    points = [(i, tuple(p)) for i, p in enumerate(rng.uniform(0, 10, (200, 3)))]
    want = {(i, r[0]) for i, p in points for r in rows if all(lo <= x <= hi for lo, x, hi in zip(r[4], p, r[5]))}
    assert {(r.id, r.region_id) for r in regions_of_points(frame(spark, points), spark.createDataFrame(rows, REGIONS), D).collect()} == want
    assert regions_of_points(frame(spark, points), spark.createDataFrame([], REGIONS), D).count() == 0


def test_near_on_empty_and_repeated(spark):
    assert near_pairs(frame(spark, []), D, 0.1).count() == 0
    assert near_pairs(frame(spark, [(1, (1, 1, 1))] * 3 + [(2, (1, 1, 1))]), D, 0.1).count() == 0


def test_short_periodic_axis_is_refused(spark):
    with pytest.raises(ValueError):
        near_pairs(frame(spark, [(1, (0, 0, 0)), (2, (0.1, 0, 0))]), Domain.cube(0.2, 1), 0.1).count()


def quadric(center, radius):
    q = np.eye(4)
    q[:3, 3] = q[3, :3] = -np.array(center)
    q[3, 3] = np.dot(center, center) - radius**2
    return q.ravel().tolist()


def test_quadric_bounds_hold():
    rng = np.random.default_rng(0)
    for _ in range(50):
        q = rng.normal(size=(4, 4))
        lo = rng.uniform(-5, 5, (1, 3))
        hi = lo + rng.uniform(0, 3, (1, 3))
        low, high = quadric_bounds(q, lo, hi)
        r = np.c_[rng.uniform(lo[0], hi[0], (200, 3)), np.ones(200)]
        v = np.einsum("ni,ij,nj->n", r, q, r)
        assert low[0] <= v.min() and v.max() <= high[0]


def test_cover_is_bounded_and_has_interior_cells():
    s = Shape(1, None, None, tuple(quadric((5, 5, 5), 3)))
    cells = cover(s, D, max_cells=500)
    assert len(cells) <= 500 and any(c[5] for c in cells) and any(not c[5] for c in cells)
    inner, outer = classify(s, np.array([[4.9, 4.9, 4.9]]), np.array([[5.1, 5.1, 5.1]]))
    assert inner[0] and not outer[0]


def test_regions_against_direct_tests(spark):
    rng = np.random.default_rng(5)
    rows = [(1, "ball", None, None, None, None, quadric((5, 5, 5), 2.5)), (2, "box", 10, 150, [1.0, 1.0, 1.0], [4.0, 9.0, 9.0], None), (3, "all", None, None, None, None, None), (4, "none", None, None, [6.0, 6.0, 6.0], [6.0, 5.0, 7.0], None), (5, "tall", None, None, None, None, np.diag([1.0, 1.0, 0.0, -4.0]).ravel().tolist())]
    regions = spark.createDataFrame(rows, REGIONS)
    points = [(int(i), tuple(p)) for i, p in enumerate(rng.uniform(-5, 15, (300, 3)))] + [(None, (5, 5, 5)), (400, (5, 5, None)), (401, (5, 5, np.nan)), (402, (1.0, 1.0, 1e6))]
    want = set()
    for i, p in points:
        if i is None or any(v is None or not np.isfinite(v) for v in p):
            continue
        r = np.array([p[0] % 10, p[1] % 10, p[2], 1.0])
        for rid, _, s, e, lo, hi, q in rows:
            ok = (s is None or i >= s) and (e is None or i < e) and (lo is None or (r[:3] >= lo).all()) and (hi is None or (r[:3] <= hi).all())
            if ok and (q is None or r @ np.array(q).reshape(4, 4) @ r <= 0):
                want.add((i, rid))
    got = {(r.id, r.region_id) for r in regions_of_points(frame(spark, points), regions, D).collect()}
    assert got == want
    assert regions_of_points(frame(spark, []), regions, D).count() == 0
