"""Functions on single records against Python's own rules."""

import hashlib
import json
import math
import random

from pyspark.sql import functions as F

from tidelark.functions import columns as C


def test_rounding_is_that_of_the_exact_binary_value(spark):
    rng = random.Random(4)
    values = [2.675, 1.005, 0.125, 0.375, -2.675, -0.125, 0.005, 0.015, 1e15, -1e300, 0.0, 1e-9, 33333.335]
    values += [rng.randrange(10**7) / 1000 for _ in range(3000)] + [rng.uniform(-1e6, 1e6) for _ in range(500)] + [n / 8 for n in range(-40, 41)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", C.round_half_even("v").alias("r"), C.round_half_even("v", 0).alias("whole")).collect()
    assert [(r.r, r.whole) for r in got] == [(round(r.v, 2), round(r.v, 0)) for r in got]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double").select(C.round_half_even("v")).collect()
    assert math.isnan(odd[0][0]) and odd[1][0] == math.inf and odd[2][0] is None


def test_keys_by_score(spark):
    rows = [({"a": 1, "b": "2.5", "c": 2, "d": 2},), ({},), (None,), ({"x": 0.1},)]
    got = spark.createDataFrame([(None if r[0] is None else json.dumps(r[0]),) for r in rows], "m string").select(C.ordered_keys("m")).collect()
    assert [r[0] for r in got] == [["b", "c", "d"], None, None, ["x"]]


def test_lookup_with_default(spark):
    got = spark.createDataFrame([('{"2024-01": "x"}', "01"), ('{"2024-01": "x"}', "02"), (None, "01"), ("not json", "01")], "m string, k string")
    assert [r[0] for r in got.select(C.json_or("m", F.concat(F.lit("2024-"), F.col("k")), "none")).collect()] == ["x", "none", "none", "none"]


def test_ids_hashes_languages(spark):
    got = spark.createDataFrame([("T", "n", ["a", "b"]), ("T", "n", [])], "k string, n string, d array<string>").select(C.stable_id("k", "n", "d")).collect()
    assert [r[0] for r in got] == ["T_n_a_b", "T_n"]
    assert spark.createDataFrame([("é",)], "t string").select(C.content_hash("t")).first()[0] == hashlib.sha256("é".encode()).hexdigest()
    paths = spark.createDataFrame([("a/b.S",), ("a.s",), ("x.h++",), ("x.md",), ("noext",), (None,)], "p string").select(C.symbol_language("p")).collect()
    assert [r[0] for r in paths] == ["ASSEMBLY", "ASSEMBLY", "C_OR_CPP_HEADER", "DEFAULT", "DEFAULT", "DEFAULT"]


def test_scale_and_time_zones(spark):
    rows = [(50, 10), (150, 10), (150, 1500), (90, 300), (101, 0)]
    got = spark.createDataFrame(rows, "f long, p long").select(C.scale_factor("f", "p", 100, 10)).collect()
    assert [r[0] for r in got] == [1, math.ceil(150 / 99), 1, 1, 2]
    times = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+02:00", "2024-01-01T00:00:00", "2024-01-01", None, "2024-01-01 00:00-0330"]
    got = spark.createDataFrame([(t,) for t in times], "t string").select(C.zone_error("t", "end_date")).collect()
    assert [r[0] is None for r in got] == [True, True, False, False, True, True]
