"""Arrays and slices against NumPy."""

import itertools
import random

import numpy as np
import pytest

import tessera
from tessera.functions.dtypes import supported_numpy
from tessera.operators import slicing


@pytest.mark.parametrize("name", ["int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64"])
def test_types_round_trip(spark, name):
    values = np.arange(60).astype(name)
    values[-1] = np.iinfo(name).max if values.dtype.kind in "iu" else 1.5
    array = tessera.from_numpy(spark, values.reshape(3, 4, 5))
    back = array.to_numpy()
    assert back.dtype == values.dtype and (back == values.reshape(3, 4, 5)).all()
    assert (array.slice([(1, 3), (0, 4, 2)]).to_numpy() == values.reshape(3, 4, 5)[1:3, 0:4:2]).all()


def test_strings_and_scalars(spark):
    a = tessera.from_numpy(spark, np.array([["a", 'b,"c'], ["", "d\ne"]]))
    assert a.dtype == "string" and a.to_numpy().tolist() == [["a", 'b,"c'], ["", "d\ne"]]
    with pytest.raises(TypeError):
        a.slice([(0, 1)])
    s = tessera.from_numpy(spark, 7)
    assert s.shape == () and len(s) == 0 and s.size == 1 and s.at(0).first()["value"] == 7
    assert tessera.from_numpy(spark, np.zeros((0, 3))).to_numpy().shape == (0, 3)


def test_coercion():
    assert supported_numpy(np.array([True]))[1] == "float64"
    assert supported_numpy(np.array([1], ">i4"))[1] == "int32"
    assert supported_numpy(np.array([b"x", b"y"]))[0].tolist() == ["x", "y"]
    with pytest.warns(UserWarning):
        assert supported_numpy(np.array([1 + 2j]))[0].tolist() == [1.0]


@pytest.mark.parametrize("shape", [(97,), (13, 11), (5, 6, 7)])
def test_slices(spark, shape):
    rng = random.Random(len(shape))
    values = np.arange(np.prod(shape)).reshape(shape)
    array = tessera.from_numpy(spark, values)
    for _ in range(8):
        spec = []
        for n in shape[: rng.randrange(1, len(shape) + 1)]:
            a = rng.randrange(n)
            spec.append((a, rng.randrange(a + 1, n + 1), rng.randrange(1, 5)))
        want = values[tuple(slice(*s) for s in spec)]
        got = array.slice(spec)
        assert got.shape == want.shape and (got.to_numpy() == want).all()
        inside = {int(v) for v in want.ravel()}
        ranges = slicing.flat_ranges(shape, slicing.normalize(shape, spec))
        assert all(any(a <= v <= b for a, b in ranges) for v in inside)
        assert {v // 8 for v in inside} <= set(slicing.block_map(shape, spec, 8))


def test_wrong_slices(spark):
    a = tessera.zeros(spark, (4, 5))
    for bad in ([(0, 5)], [(2, 2)], [(3, 1)], [(0, 1, 0)], [(0, 1)] * 3, [(-1, 2)]):
        with pytest.raises(ValueError):
            a.slice(bad)
    four = tessera.arange(spark, 10**4).reshape((10, 10, 10, 10))
    with pytest.raises(ValueError):
        four.slice([(0, 1)])
    assert four.slice([(1, 3), (0, 10, 5)], allow_nd=True).shape == (2, 2, 10, 10)
    assert slicing.block_runs([7, 3, 4, 5, 9]) == [(3, 5), (7, 7), (9, 9)]
    assert len(tessera.Slice(0, 10, 3)) == 4 and len(tessera.Slice(5, 5)) == 0 and tessera.slice_all(4) == tessera.Slice(0, 4)
    with pytest.raises(ValueError):
        slicing.block_map((10,), [], 0)


@pytest.mark.parametrize("spec", [(0, 10, 1), (0, 20, 2), (10, 0, -1), (0, 10, 3), (0.0, 1.0, 0.1), (5,)])
def test_arange(spark, spec):
    got = tessera.arange(spark, *spec).to_numpy()
    want = np.arange(*spec)
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-10)


def test_factories_and_shapes(spark):
    assert (tessera.full(spark, (2, 3), 7, "uint64").to_numpy() == np.full((2, 3), 7)).all()
    assert tessera.ones(spark, 3, "int8").to_numpy().tolist() == [1, 1, 1] and tessera.empty(spark, 2).to_numpy().tolist() == [0, 0]
    a = tessera.arange(spark, 24).reshape((2, 3, 4))
    assert a.strides == [12, 4, 1] and a.dim(1) == 3 and len(a) == 2 and "(2, 3, 4)" in repr(a)
    assert a.at(1, 2, 3).first()["value"] == 23 and a[-1] == 23 and a[3] == 3
    assert [(r.i0, r.i1, r.i2) for r in a.coordinates().orderBy("idx").collect()] == list(itertools.product(range(2), range(3), range(4)))
    assert list(a)[:3] == [0, 1, 2] and [r["value"] for r in a.scan(reverse=True).take(2)] == [23, 22]
    assert a.resize((5, 6), -1).to_numpy().ravel().tolist() == [*range(24), *[-1] * 6] and a.resize(4).to_numpy().tolist() == [0, 1, 2, 3]
    assert (a.map(lambda v: v * 2 + 1).to_numpy() == np.arange(24).reshape(2, 3, 4) * 2 + 1).all()
    for wrong in (lambda: a.reshape((5, 5)), lambda: a.at(1, 1), lambda: tessera.arange(spark, 0, 1, 0), lambda: tessera.zeros(spark, (-1,))):
        with pytest.raises(ValueError):
            wrong()
    for wrong in (lambda: a.at(2, 0, 0), lambda: a.flat(24), lambda: a[-25], lambda: a.dim(3)):
        with pytest.raises(IndexError):
            wrong()
    for wrong in (lambda: a["x"], lambda: a.typed("int32")):
        with pytest.raises(TypeError):
            wrong()
    with pytest.raises(ValueError):
        tessera.ArrayFrame(a.cells.limit(5), (6,), "int64").checked()
    with pytest.raises(Exception, match="not a uint8"):
        a.map(lambda v: v * 100, "uint8").to_numpy()
