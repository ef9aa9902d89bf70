import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusframe.operators import joins, numbering, quality, retention, select


def rows(spark, n=600, groups=3):
    return spark.range(n).select("id", (F.col("id") % groups).alias("g"), (F.col("id") % 17 + 1).alias("amount"))


def test_budget_prefix_against_loop(spark):
    import hashlib

    df = rows(spark)
    got = numbering.budget_prefix(df, ["g"], numbering.key_of(1, F.col("id")), ["id"], F.col("amount"), F.lit(400))
    assert got.columns == df.columns
    want = set()
    for g in range(3):
        total = 0
        for i in sorted((i for i in range(600) if i % 3 == g), key=lambda i: hashlib.md5(f"1|{i}".encode()).hexdigest()):
            if total >= 400:
                break
            want.add(i)
            total += i % 17 + 1
        assert 400 <= total < 400 + 17
    assert {r["id"] for r in got.collect()} == want
    assert numbering.budget_prefix(df, ["g"], numbering.key_of(1, F.col("id")), ["id"], F.col("amount"), F.lit(0)).count() == 0


def test_numbering_is_a_permutation(spark):
    n = numbering.numbered(rows(spark), ["g"], numbering.key_of(3, F.col("id")), ["id"]).collect()
    for g in range(3):
        assert sorted(r["n"] for r in n if r["g"] == g) == list(range(1, 201))


def test_samples(spark):
    df = rows(spark)
    assert Counter(r["g"] for r in select.hash_sample(df, ["g"], ["id"], 7).collect()) == {0: 7, 1: 7, 2: 7}
    drawn = select.sample_with_replacement(df, ["g"], ["id"], 500).collect()
    assert Counter(r["g"] for r in drawn) == {0: 500, 1: 500, 2: 500} and len({r["id"] for r in drawn}) < 600
    assert all(r["id"] % 3 == r["g"] for r in drawn)
    small = df.where("g > 0 or id < 90")
    assert Counter(r["g"] for r in select.balance(small, "g", ["id"]).collect()) == {0: 30, 1: 30, 2: 30}
    assert Counter(r["g"] for r in select.balance(small, "g", ["id"], cap=5).collect()) == {0: 5, 1: 5, 2: 5}
    assert select.replicate(df, 3).count() == 1800
    assert sum(select.shard(df, F.col("id"), 4, k).count() for k in range(4)) == 600
    assert [r["id"] for r in select.first_k(df, ["g"], ["id"], 2).orderBy("id").collect()] == [0, 1, 2, 3, 4, 5]


# fixed values: counts by words and duration bin; share of short clips (%); short rows held
COUNTS = {
    1: [7, 23, 33, 17, 18, 10],
    2: [4, 16, 28, 40, 45, 46],
    3: [3, 21, 56, 83, 119, 147],
    4: [1, 6, 23, 56, 82, 132],
    5: [0, 0, 3, 4, 14, 42],
    6: [0, 0, 1, 2, 8, 13],
}
SHORT_SHARE = {"Algeria": 17.4, "Yemen": 16.2, "Palestine": 15.9, "Morocco": 13.6, "Egypt": 12.5, "Mauritania": 6.2, "UAE": 6.2, "Jordan": 3.3}
SHORT_ROWS = {"Algeria": 46, "Egypt": 70, "Jordan": 23, "Mauritania": 23, "Morocco": 93, "Palestine": 46, "UAE": 23, "Yemen": 70}


def test_shared_need(spark):
    g = spark.createDataFrame([("a", 0.5, 100, 10), ("b", 0.2, 100, 10)], "d string, share double, rows int, held int")
    got = {r["d"]: r["n"] for r in select.shared_need(g, F.col("share"), F.col("rows"), F.col("held"), select.missing_rows(F.lit(0.25), F.lit(200), F.lit(20)), "n").collect()}
    assert sum(got.values()) == pytest.approx(40) and (20 + 40) / (200 + 40) == 0.25
    assert got["a"] / got["b"] == pytest.approx(80 / 12.5)


def test_quotas_reach_the_published_totals(spark):
    groups = spark.createDataFrame([(d, p / 100, 23225, SHORT_ROWS[d]) for d, p in SHORT_SHARE.items()], "d string, share double, rows int, held int")
    sized = select.shared_need(groups, F.col("share"), F.col("rows"), F.col("held"), select.missing_rows(F.lit(0.105), F.lit(185798), F.lit(372)))
    cells = spark.createDataFrame([(k, b, float(c)) for k, row in COUNTS.items() for b, c in enumerate(row) if c], "nw int, bin int, c double")
    df = sized.select("d", "total").crossJoin(cells)
    q = select.largest_remainder(df, "d", F.col("c") / 1103, F.col("total"), ["nw", "bin"]).collect()
    sums = Counter()
    words = Counter()
    for r in q:
        sums[r["d"]] += r["quota"]
        if r["d"] == "Jordan":
            words[r["nw"]] += r["quota"]
    assert sums == {"Algeria": 4281, "Egypt": 2866, "Jordan": 681, "Mauritania": 1337, "Morocco": 3141, "Palestine": 3838, "UAE": 1337, "Yemen": 3900}
    assert words == {1: 66, 2: 110, 3: 265, 4: 186, 5: 39, 6: 15}


def spans(n_utts=12, words=8):
    out = []
    for u in range(n_utts):
        for i in range(words):
            for j in range(i, min(words, i + 4)):
                nw = j - i + 1
                out.append((f"u{u}", i, j, nw, min(5, nw), (u + i) % 3, [0.2, 0.03, 0.01][(u + i) % 3], float(-u)))
    return pd.DataFrame(out, columns=["utt", "i", "j", "nw", "bin", "tier", "gap", "score"])


def test_greedy_fill_respects_limits():
    s = spans()
    got = select.fill_quotas(s, {(1, 1): 10, (2, 2): 8, (4, 4): 5})
    assert Counter(got["nw"]) == {1: 10, 2: 8, 4: 5}
    assert got.groupby("utt").size().max() <= 6
    for _, g in got.groupby("utt"):
        taken = [set(range(a, b + 1)) for a, b in zip(g["i"], g["j"], strict=True)]
        assert all(len(x & y) / len(x | y) <= 0.65 for k, x in enumerate(taken) for y in taken[:k])
    # a cell that can't be filled takes from its neighbours; nothing is taken twice
    more = select.fill_quotas(s, {(3, 0): 4})
    assert len(more) == 4 and set(more["nw"]) == {3} and more.index.is_unique
    assert len(select.fill_quotas(s, {(1, 1): 10_000})) <= 6 * 12


def test_quota_fill_by_group(spark):
    s = spans().assign(g=lambda d: (d["utt"].str[1:].astype(int) % 2).astype(str))
    quotas = spark.createDataFrame([("0", 1, 1, 3), ("1", 2, 2, 2)], "g string, nw int, bin int, quota int")
    got = select.quota_fill(spark.createDataFrame(s), quotas, "g").toPandas()
    assert Counter(zip(got["g"], got["nw"], strict=True)) == {("0", 1): 3, ("1", 2): 2}


def test_quota_fill_takes_the_rows_of_the_sequence(spark):
    """Whatever budgets end where: as the one sequence of all offers does."""
    r = random.Random(5)
    for round_ in range(2):
        made = []
        for u in range(40):
            for i in range(9):
                for j in range(i, min(9, i + 4)):
                    gap = r.choice([0.2, 0.03, 0.01, 0.7])
                    made.append((r.choice("ab") if round_ else "ab"[u % 2], f"u{u}", i, j, j - i + 1, r.randrange(6), int(gap < 0.1) + int(gap < 0.02), gap, float(r.randrange(5))))
        s = pd.DataFrame(made, columns=["g", "utt", "i", "j", "nw", "bin", "tier", "gap", "score"])
        quota = {g: {(k, b): r.choice([0, 1, 3, 9, 40]) for k in range(1, 5) for b in range(6) if r.random() < 0.7} for g in "ab"}
        q = spark.createDataFrame([(g, k, b, n) for g, cells in quota.items() for (k, b), n in cells.items()], "g string, nw int, bin int, quota int")
        want = pd.concat([select.fill_quotas(s[s["g"] == g], quota[g]) for g in "ab"])
        for passes in (select.PASSES, 0)[: 2 - round_]:
            select.PASSES, held = passes, select.PASSES
            got = select.quota_fill(spark.createDataFrame(s).repartition(3), q, "g").toPandas()
            select.PASSES = held
            assert sorted(map(tuple, got[list(s.columns)].values)) == sorted(map(tuple, want.values))


def test_joins(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("n", None)], "id string, d double")
    b = spark.createDataFrame([("x", -1.0), ("y", 5.0), ("z", 7.0)], "id string, d double")
    assert {r["id"]: r["d"] for r in joins.override_durations(a, b, "id", "d").collect()} == {"x": 1.0, "y": 5.0, "z": 7.0}
    m = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row int, utt string")
    h = spark.createDataFrame([("a", " x\n y "), ("b", " ")], "utt string, hyp string")
    s = {r["utt"]: (r["line"], r["status"]) for r in joins.submission(m, h, ["utt"], "hyp").collect()}
    assert s == {"a": ("x y", "OK"), "b": ("", "EMPTY"), "c": ("", "MISSING")}
    cov = joins.segment_coverage(spark.createDataFrame([("x",), ("x",), ("q",)], "id string"), a, "id").first()
    assert (cov["matched"], cov["missed"], cov["uncovered"], cov["rows"]) == (2, 1, 2, 3)
    assert {r["id"] for r in joins.resume(a, b, "id").collect()} == {"n"}


def test_checks(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    q = quality.together(quality.violations(d, named=F.col("k").isNotNull(), small=F.col("v") < 3), quality.duplicate_rows(d, ["k"]), quality.leaked_rows(d, d.where("v = 1"), ["k"]))
    assert {r["check"]: r["violations"] for r in q.collect()} == {"named": 1, "small": 1, "duplicates": 1, "leakage": 2}
    quality.require(q.where("violations = 0"))
    try:
        quality.require(q)
    except ValueError as e:
        assert "named" in str(e)
    else:
        raise AssertionError("broken contract passed")


def test_retention(spark):
    scores = [(1, 0.5), (2, 0.3), (3, None), (4, 0.4), (5, 0.9)]
    df = spark.createDataFrame([("m", s, v) for s, v in scores], "g string, step int, v double")
    assert {r["step"] for r in retention.retained(df, ["g"], "step", "v", 2).where("keep").collect()} == {2, 4, 5}
    top = retention.TopK(2)
    gone = [top.add(s, v) for s, v in scores]
    assert gone[2] == [] and set(top.scores) == {2, 4, 5}
    assert retention.TopK(2, {1: 0.5, 2: math.inf}, {1}).scores == {1: 0.5}
    assert retention.best_or_latest(df, "step", "v").first()["step"] == 2
    assert retention.best_or_latest(df.where("v is null"), "step", "v").first()["step"] == 3


def test_labels_and_batches(spark):
    df = spark.createDataFrame([(3, "MA"), (1, "SY"), (2, "EG"), (4, "SY"), (5, None)], "i int, d string")
    assert {r["d"]: r["code"] for r in select.encode_labels(df, "d", ["i"], 3).collect()} == {"SY": 0, "EG": 1, "MA": 2}
    try:
        select.encode_labels(df, "d", ["i"], 20).collect()
    except Exception as e:
        assert "expected 20 classes, not 3" in str(e)
    else:
        raise AssertionError("wrong number of classes passed")
    b = select.batch_index(rows(spark, 50, 2), ["g"], ["id"], 10).groupBy("g", "batch").count().collect()
    assert sorted((r["g"], r["batch"], r["count"]) for r in b) == [(g, k, [10, 10, 5][k]) for g in (0, 1) for k in range(3)]
