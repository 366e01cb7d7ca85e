import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.domain import Domain
from cellframe.operators.snap import Snap, atom, coupling, parse, representations, snap_force, triples
from cellframe.sources import particles

rng = np.random.default_rng(0)
P = Snap(4, 1.0, (0.5, 0.6), (1.0, 0.7), tuple(tuple(rng.normal(size=len(triples(4)) + 1)) for _ in range(2)))


def test_coupling_is_orthonormal():
    for j1, j2 in ((2, 1), (4, 3)):
        rows = np.concatenate([coupling(j1, j2, j).reshape(j + 1, -1) for j in range(abs(j1 - j2), j1 + j2 + 1, 2)])
        assert np.allclose(rows @ rows.T, np.eye(len(rows)))


def test_representations_are_unitary():
    d = rng.normal(size=(5, 3)) * 0.2
    us, _ = representations(d, np.full(5, 2.0), P)
    for j, u in enumerate(us):
        flat = u @ u.conj().transpose(0, 2, 1)
        assert np.allclose(flat, flat[:, :1, :1] * np.eye(j + 1))


def neighbourhood(n=6):
    d = rng.normal(size=(n, 3))
    return d / np.linalg.norm(d, axis=1)[:, None] * rng.uniform(0.3, 0.95, (n, 1)), rng.integers(0, 2, n)


def test_components_do_not_turn():
    d, kinds = neighbourhood()
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    assert np.allclose(atom(d, kinds, 0, P)[1], atom(d @ q.T, kinds, 0, P)[1])
    assert np.allclose(atom(np.zeros((0, 3)), kinds[:0], 0, P)[1], 0)


def test_slopes_are_those_of_the_energy():
    d, kinds = neighbourhood()
    _, _, slope = atom(d, kinds, 1, P)
    for i, x in np.ndindex(3, 3):
        e = []
        for s in (1e-6, -1e-6):
            moved = d.copy()
            moved[i, x] += s
            e.append(atom(moved, kinds, 1, P)[0])
        assert (e[0] - e[1]) / 2e-6 == pytest.approx(slope[i, x], rel=1e-4, abs=1e-5)


def test_forces_sum_to_zero_and_follow_the_total_energy(spark):
    box = Domain.cube(3.0, 3)
    rows = [(i, i % 2, *map(float, rng.uniform(0, 3, 3)), *[0.0] * 6) for i in range(12)]
    df = spark.createDataFrame(rows, particles.SCHEMA)
    out = snap_force(df, box, P)
    total = out.agg(*(F.sum(f"f{a}") for a in "xyz")).first()
    assert np.allclose(total, 0, atol=1e-9)
    energy = lambda x: snap_force(df.withColumn("rx", F.when(F.col("id") == 3, F.col("rx") + x).otherwise(F.col("rx"))), box, P).agg(F.sum("ep")).first()[0]
    assert -(energy(1e-5) - energy(-1e-5)) / 2e-5 == pytest.approx(out.where("id = 3").first().fx, rel=1e-3, abs=1e-5)
    assert snap_force(df.limit(0), box, P).count() == 0


def test_parse():
    p = parse("rcutfac 4.5\ntwojmax 2 # small\nrfac0 0.99\nbzeroflag 0\n", "# head\n1 3\nNi 0.5 1.0\n0.1\n0.2\n0.3\n")
    assert p.twojmax == 2 and not p.bzero and p.coefficients == ((0.1, 0.2, 0.3),) and p.rcut == 4.5
