"""Signatures travel with 32 bits of a class."""

import numpy as np

from terracell.llm import partenum


def test_eight_bytes_a_signature():
    sig = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    batch = partenum._blobs([(sig, sig ^ np.uint64(77))], 5)
    assert sum(len(v) for c in batch.column_names[1:] for v in batch.column(c).to_pylist()) == 8 * len(sig)


def test_classes_of_one_short_are_pairs(spark):
    full = spark.createDataFrame([(1, 10), (1, 12), (1, 11), (2, 20), (3, -30), (3, 31)], "short long, cls long")
    got = sorted(map(tuple, partenum.same_short(full).select("a", "b").collect()))
    assert got == [(-30, 31), (10, 11), (10, 12), (11, 12)]
