"""Functions of arrays hold few rows as objects, however large the batch."""

import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from spikeloom.operators import chunks as ch


def test_few_results_alive():
    alive, most = [0], [0]

    def gone():
        alive[0] -= 1

    def one(x, k):
        y = x * k
        alive[0] += 1
        weakref.finalize(y, gone)
        most[0] = max(most[0], alive[0])
        return y

    rows = [[float(i), 1.0] for i in range(10 * ch.SLICE + 7)]
    got = ch.by_rows(ch.ARR, one)(pa.array([[9.0], *rows], pa.list_(pa.float64())).slice(1), pa.array([2] * len(rows)))
    assert got.to_pylist() == [[2 * a, 2 * b] for a, b in rows]
    assert most[0] <= 2 * ch.SLICE


def test_nested_results():
    pair = ArrayType(StructType([StructField("re", ch.ARR), StructField("im", ArrayType(DoubleType()))]))
    got = ch.by_rows(pair, lambda x: [(x, -x), (x[:0], x + 1)])(pa.array([[1.0, 2.0], []], pa.list_(pa.float64())))
    assert got.to_pylist() == [[{"re": [1, 2], "im": [-1, -2]}, {"re": [], "im": [2, 3]}], [{"re": [], "im": []}] * 2]
    twice = ch.by_rows(ArrayType(ch.ARR), lambda x: np.outer([1, 2], x))(pa.array([[3.0]], pa.list_(pa.float64())))
    assert twice.to_pylist() == [[[3], [6]]]
