import struct

import numpy as np
from pyspark.sql import functions as F

from molframe.functions.order import total_order, total_order_np
from molframe.plans.solvate import choose_spaced

NEGATIVE_NAN = struct.unpack("<d", struct.pack("<Q", 0xFFF8000000000000))[0]
IN_ORDER = [NEGATIVE_NAN, float("-inf"), -1e300, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1.5, 1e300, float("inf"), float("nan")]


def test_keys_rise_strictly(spark):
    keys = total_order_np(np.array(IN_ORDER))
    assert (np.diff(keys.astype(object)) > 0).all()
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*IN_ORDER[1:], None])], "i int, v double").select("i", total_order(F.col("v")).alias("k")).orderBy("i").collect()
    assert [r.k for r in rows] == [*keys[1:].tolist(), None]


def test_zeros_and_nan_choose_sites():
    xyz = np.arange(12.0).reshape(4, 3) * 100
    v, tie = np.array([0.0, -0.0, np.nan, 0.0]), np.array([1, 9, 0, 0])
    assert choose_spaced(xyz, v, tie, [True, False, False, True]) == [1, 2, 3, 0]
