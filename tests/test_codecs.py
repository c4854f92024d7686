import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import codecs

LISTS = [[], [0], [0, 0, 5], [9, 2, 77, 5, 5, 260, 31, 64, 1024, 3], [2, 3, 17, 40, 41, 255, 256, 900, 5000, 70_000], list(range(129)), [2**32 - 1, 0, 2**28, 1], [7] * 1000, [10, 1000, 10000, 100000]]


@pytest.mark.parametrize("name", codecs.CODECS)
@pytest.mark.parametrize("values", LISTS, ids=lambda v: f"{len(v)}-{v[:2]}")
def test_round_trip(name, values):
    encode, decode = codecs.CODECS[name]
    assert decode(encode(np.array(values, np.int64))) == values


@settings(max_examples=50, deadline=None)
@given(st.sampled_from(sorted(codecs.CODECS)), st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_round_trip_of_any(name, values):
    encode, decode = codecs.CODECS[name]
    assert decode(encode(np.array(values, np.int64))) == values


def test_small_numbers_are_short():
    values = np.ones(128, np.int64)
    assert all(len(e(values)) < 4 * 128 for e, _ in codecs.CODECS.values())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=90), max_size=12))
def test_a_batch_is_encoded_as_each_list_by_itself(lists):
    """First the selector that fits, word by word; exceptions in front."""
    for modes in (codecs._S9, codecs._S16):
        arrays = [np.array(x, np.int64) for x in lists]
        data = codecs._packed_encode(arrays, modes)
        for values, blob in zip(lists, data):
            numbers, low, at = np.frombuffer(blob, "<u4").tolist(), [v & (2**28 - 1) for v in values], 0
            large = [x for i, v in enumerate(values) if v >= 1 << 28 for x in (i, v)]
            assert numbers[: 2 + len(large)] == [len(values), len(large) // 2, *large]
            for word in numbers[2 + len(large) :]:
                fits = next(k for k, m in enumerate(modes) if all(v < 1 << b for v, b in zip(low[at:], m)))
                want, shift = fits, 4
                for v, b in zip(low[at:], modes[fits]):
                    want |= v << shift
                    shift += b
                assert word == want
                at += len(modes[fits])
            assert at >= len(values)
        assert [x.tolist() for x in codecs._packed_decode(data, modes)] == lists


def test_columns(spark):
    rows = spark.createDataFrame([([3, 8, 9, 500],), ([],), (None,)], "v array<bigint>")
    for name in codecs.CODECS:
        for with_gaps in (False, True):
            back = rows.select("v", codecs.decode(codecs.encode(F.col("v"), name, with_gaps), name, with_gaps).alias("b")).collect()
            assert all(r["v"] == r["b"] for r in back)
    assert [r["g"] for r in rows.select(codecs.gaps(F.col("v")).alias("g")).collect()] == [[3, 5, 1, 491], [], None]
    assert [r["g"] for r in rows.select(codecs.ungaps(codecs.gaps(F.col("v"))).alias("g")).collect()] == [[3, 8, 9, 500], [], None]


def test_sums_before(spark):
    rows = spark.createDataFrame([([3, 1, 2],), ([],), (None,)], "v array<int>")
    assert [r["s"] for r in rows.select(codecs.sums_before(F.col("v")).alias("s")).collect()] == [[0, 3, 4], [], None]


def test_unknown_codec():
    with pytest.raises(ValueError):
        codecs.check_codec("zip")
    with pytest.raises(ValueError):
        codecs.varbyte_encode(np.array([-1]))
