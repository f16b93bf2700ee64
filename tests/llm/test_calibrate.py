from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lexivec.llm import calibrate

RECORDS = "qid string, label_en string, label_vi string, instance_of_qids array<string>"
SEEDS = "seed_name string, instance_of_qid string, weight int"


def draw(spark, rows, seeds, **k):
    s = calibrate.calibrated_sample(spark.createDataFrame(rows, RECORDS), spark.createDataFrame(seeds, SEEDS), **k)
    return s, {r.seed_name: r for r in s.report.collect()}


def test_shares_floors_and_gaps(spark):
    rows = [(f"Q{i}", "x", None, ["A"]) for i in range(3000)]  # most entities are of one class
    rows += [(f"Q{i}", None, "y", [" B ", "B"]) for i in range(3000, 3900)]
    rows += [(f"Q{i}", "x", None, ["C", "A"]) for i in range(3900, 4200)]
    rows += [(f"Q{i}", "x", None, ["D"]) for i in range(4200, 4203)]
    rows += [(f"Q{i}", "x", None, ["E"]) for i in range(4300, 4400)]
    seeds = [("a", "A", 50), ("b", "B", 30), ("c", "C", 19), ("d", "D", 20), ("e", "E", 0), ("none", "Z", 1)]
    s, r = draw(spark, rows, seeds)
    taken = s.rows.collect()
    assert len(taken) == len({t.qid for t in taken}) == 4303 // 5
    assert r["d"].sampled == 3 and r["d"].short and r["d"].missed and r["none"].sampled == 0 and r["none"].short
    assert r["e"].sampled >= 5 and not r["e"].missed
    # categories with enough entities keep the proportions of their weights
    assert abs(r["a"].sampled / r["b"].sampled - 50 / 30) < 0.03
    assert abs(r["c"].sampled / r["b"].sampled - 19 / 30) < 0.03


def test_what_counts(spark):
    rows = [
        ("Q1", "a", None, ["A"]), (" Q1 ", None, " ", ["B"]), ("Q1", "", None, None), ("Q2", " ", None, ["A"]),
        (None, "a", "b", ["A"]), ("Q3", None, "v", ["A", None, "A "]), ("Q4", "a", None, []),
    ]
    s, r = draw(spark, rows, [("a", "A", 1), ("b", "B", 1), (None, "A", 1)], fraction=1)
    assert r["a"].entities == 2 and r["b"].entities == 0 and {t.qid for t in s.rows.collect()} == {"Q1", "Q3"}


def test_empty_tables_and_extra_columns(spark):
    s, r = draw(spark, [], [("a", "A", 1)])
    assert s.rows.count() == 0 and r["a"].target == 5 and r["a"].short
    s, r = draw(spark, [("Q1", "a", None, ["A"])], [])
    assert s.rows.count() == 0 and r == {}
    records = spark.createDataFrame([("Q1", "a", None, ["A"])] * 2, RECORDS).withColumns({c: F.lit(1) for c in ("groups", "class", "k", "p", "n")})
    seeds = spark.createDataFrame([("a", "A", 1)], SEEDS).withColumn("qid", F.lit("x"))
    got = calibrate.calibrated_sample(records, seeds, fraction=1)
    assert got.report.first().sampled == 1


def test_hot_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr(calibrate, "BLOCK_ROWS", 50)
    rows = [(f"Q{i}", "x", None, ["A"] if i % 3 else ["B"]) for i in range(900)]
    s, r = draw(spark, rows, [("a", "A", 1), ("b", "B", 1)])
    assert s.rows.count() == 180 and abs(r["a"].sampled - 90) <= 1


def test_many_categories_use_the_diagonal_alone(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"Q{i}", "x", None, [f"C{j}" for j in rng.choice(8, 1 + (i % 4 == 0), replace=False)]) for i in range(4000)]
    seeds = [(f"c{j}", f"C{j}", 10 + 5 * j) for j in range(8)]
    whole, a = draw(spark, rows, seeds)
    monkeypatch.setattr(calibrate, "FULL_MATRIX", 2)
    s, b = draw(spark, rows, seeds)
    for r in (a, b):
        assert r["c0"].residual <= calibrate.TOLERANCE and r["c0"].rounds > 0
    assert s.rows.count() == whole.rows.count() == 800
    assert all(abs(a[n].calibrated - b[n].calibrated) < 0.5 and abs(b[n].sampled - b[n].calibrated) <= 12 for n in a)


def test_floors_are_fixed_in_two_passes(spark):
    rows = [(f"Q{i}", "x", None, ["A"]) for i in range(2000)] + [(f"R{i}", "x", None, ["B", "C"]) for i in range(40)] + [(f"S{i}", "x", None, ["C"]) for i in range(20)]
    s = calibrate.calibrated_sample(spark.createDataFrame(rows, RECORDS), spark.createDataFrame([("a", "A", 100), ("b", "B", 1), ("c", "C", 1)], SEEDS))
    drawn = spark.createDataFrame([(r[0], [0] if r[0][0] == "Q" else [1, 2] if r[0][0] == "R" else [2], r[0][0] == "Q" and int(r[0][1:]) < 412) for r in rows], "qid string, groups array<int>, taken boolean")
    fixed, counts = s._fix_floors(drawn, np.array([412, 0, 0]), np.array([5, 5, 7]), np.array([1, 2]), 42)
    taken = fixed.where("taken").collect()
    assert len(taken) == 412 and counts.tolist() == [sum(i in t.groups for t in taken) for i in range(3)]
    assert counts[1] >= 5 and counts[2] >= 7


def test_same_seed_same_sample(spark):
    rows = [(f"Q{i}", "x", None, ["A"] if i % 3 else ["B"]) for i in range(300)]
    draws = [{t.qid for t in draw(spark, rows, [("a", "A", 1), ("b", "B", 2)])[0].rows.collect()} for _ in range(2)]
    assert draws[0] == draws[1]


def test_pivotal_keeps_probabilities_and_totals():
    rng = np.random.default_rng(0)
    p = np.array([0.2, 0.5, 0.3, 0.9, 0.1, 1.0, 0.0])
    got = np.array([calibrate.pivotal(p, rng) for _ in range(20_000)])
    assert set(got.sum(axis=1)) == {3}
    assert np.abs(got.mean(axis=0) - p).max() < 0.015
