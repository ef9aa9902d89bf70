import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusframe.operators import models, neighbours, scan, segments, vectors


@pytest.mark.parametrize(
    ("args", "want"),
    [
        ((1.9, 5, 5, 2), []),
        ((4.2, 5, 5, 2), [(0, 4.2)]),
        ((5.0, 5, 5, 2), [(0, 5.0)]),
        ((6.9, 5, 5, 2), [(0, 5)]),
        ((10.0, 5, 5, 2), [(0, 5), (5, 5)]),
        ((12.3, 5, 5, 2), [(0, 5), (5, 5), (10, 2.3)]),
        ((12.3, 5, 2.5, 2), [(0, 5), (2.5, 5), (5, 5), (7.5, 4.8)]),
    ],
)
def test_windows(spark, args, want):
    dur, length, hop, shortest = args
    got = spark.range(1).select(segments.windows(F.lit(dur), length, hop, shortest).alias("w")).first()["w"]
    assert [(w["start_s"], w["dur_s"]) for w in got] == want


def test_word_spans(spark):
    words = [("a", 0.10, 0.30, True), ("b", 0.40, 0.60, True), (" ", 0.6, 0.7, True), ("c", 0.70, 0.70, True), ("d", 0.62, 0.90, None), ("e", 1.5, 1.9, False)]
    df = spark.createDataFrame([("u", words, 2.0)], "u string, words array<struct<w:string,start:double,end:double,aligned:boolean>>, dur_clip double")
    got = {(r["i"], r["j"]): r for r in segments.word_spans(df, "words", "dur_clip").collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)}
    r = got[0, 1]
    assert r["span_text"] == "a b" and r["t0"] == pytest.approx(0.05) and r["t1"] == pytest.approx(0.62) and r["gap"] == pytest.approx(0.02) and r["tier"] == 2
    assert got[0, 2]["gap"] == 9.0 and got[1, 2]["nw"] == 2


def test_span_overlap_and_boundary(spark):
    r = spark.range(1).select(segments.span_overlap(F.lit(0), F.lit(3), F.lit(1), F.lit(3)).alias("a"), segments.span_overlap(F.lit(0), F.lit(1), F.lit(2), F.lit(3)).alias("b")).first()
    assert (r["a"], r["b"]) == (0.75, 0.0)


def slow_alignment(logp, ids, blank=0):
    """The best score over all monotone paths, by trying each state at each frame."""
    states = [blank]
    for i in ids:
        states += [int(i), blank]
    best = {0: logp[0][states[0]], 1: logp[0][states[1]]}
    for t in range(1, len(logp)):
        new = {}
        for s in range(len(states)):
            came = [best[p] for p in (s, s - 1) if p in best]
            if s > 1 and states[s] != blank and states[s] != states[s - 2] and s - 2 in best:
                came.append(best[s - 2])
            if came:
                new[s] = max(came) + logp[t][states[s]]
        best = new
    return max(best.get(len(states) - 1, -1e30), best.get(len(states) - 2, -1e30)) / len(logp)


def test_forced_alignment():
    r = np.random.default_rng(5)
    for _ in range(40):
        ids = r.integers(1, 4, r.integers(1, 6))
        need = len(ids) + int((ids[1:] == ids[:-1]).sum())
        logp = np.log(r.dirichlet(np.ones(4), need + int(r.integers(0, 6))))
        spans, score = segments.forced_alignment(logp, ids)
        assert score == pytest.approx(slow_alignment(logp, ids))
        assert (spans[:, 0] < spans[:, 1]).all() and (spans[1:, 0] >= spans[:-1, 1]).all()
        with pytest.raises(ValueError):
            segments.forced_alignment(logp[: need - 1], ids)
    with pytest.raises(ValueError):
        segments.forced_alignment(np.zeros((3, 2)), [])


def test_alignment_column_and_target(spark):
    p = np.log(np.full((4, 3), 1 / 3)).tolist()
    df = spark.createDataFrame([(p, [1, 2]), (p[:1], [1, 2]), ([], [1])], "p array<array<double>>, i array<int>")
    rows = [r["a"] for r in df.select(segments.align_labels("p", "i").alias("a")).collect()]
    assert rows[0]["error"] is None and len(rows[0]["spans"]) == 2 and "hold" in rows[1]["error"] and rows[2]["spans"] is None
    known = {"ب": 1, "ا": 2, "|": 9, "a": 3}
    said = spark.createDataFrame([("پا، ؟ ba",), ("؟",), (None,)], "text string").select(segments.alignment_words(F.col("text"), known).alias("w"))
    got = said.select(segments.alignment_ids(F.col("w"), known).alias("ids"), segments.alignment_ranges(F.col("w")).alias("r")).collect()
    assert got[0]["ids"] == [1, 2, 9, 3] and [tuple(r) for r in got[0]["r"]] == [("پا،", 0, 2), ("؟", None, None), ("ba", 3, 4)]
    assert got[1]["ids"] == [] and got[2]["ids"] is None


def full_table(log_prob, ids, blank=0):
    """The same alignment with every row of sums kept."""
    frames, n = len(log_prob), len(ids)
    states = [blank, *(x for i in ids for x in (i, blank))]
    best, came = np.full((frames, len(states)), -np.inf), np.zeros((frames, len(states)), int)
    best[0, :2] = log_prob[0, states[:2]]
    for t in range(1, frames):
        for s in range(len(states)):
            steps = [s] + [s - 1] * (s > 0) + [s - 2] * (s > 1 and states[s] != blank and states[s] != states[s - 2])
            came[t, s] = max(steps, key=lambda k: best[t - 1, k])
            best[t, s] = best[t - 1, came[t, s]] + log_prob[t, states[s]]
    s = 2 * n - 1 if best[-1, 2 * n - 1] > best[-1, 2 * n] else 2 * n
    path = [s]
    for t in range(frames - 1, 0, -1):
        path.append(s := came[t, s])
    path = path[::-1]
    return [[min(t for t, s in enumerate(path) if s == 2 * k + 1), max(t for t, s in enumerate(path) if s == 2 * k + 1) + 1] for k in range(n)]


def test_stretches_of_an_alignment_equal_the_full_table():
    r = np.random.default_rng(11)
    for _ in range(60):
        ids = r.integers(1, 4, r.integers(1, 9))
        frames = len(ids) + int((ids[1:] == ids[:-1]).sum()) + int(r.integers(0, 60))
        # whole numbers, so that many paths are equally likely
        logp = r.integers(-3, 0, (frames, 4)).astype(float) if r.random() < 0.5 else np.log(r.dirichlet(np.ones(4), frames))
        assert segments.forced_alignment(logp, ids)[0].tolist() == full_table(logp, ids.tolist())


def test_an_hour_aligns_in_little_memory():
    r = np.random.default_rng(4)
    frames, n = 180_000, 300
    ids = r.integers(1, 8, n)
    logp = np.full((frames, 8), -3.0, dtype=np.float32)
    logp[:, 0] = -0.1
    at = np.sort(r.choice(np.arange(10, frames - 10, 2), n, replace=False))
    logp[at, 0], logp[at, ids] = -3.0, -0.1
    tracemalloc.start()
    spans, _ = segments.forced_alignment(logp, ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [a for a, _ in spans.tolist()] == at.tolist() and peak < 40e6 < frames * n * 8


def test_scan_over_ranges_equals_windows(spark):
    r = random.Random(6)
    rows = [(None if (g := r.choice([0, 0, 0, 0, 1, 2, None])) is None else f"g{g}", r.randrange(400), i, r.choice([None, r.random()])) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, p int, i int, v double")
    w = Window.partitionBy("g").orderBy(F.desc("p"), "i")
    want = df.select("i", F.row_number().over(w).alias("n"), F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("c"))
    want = {x["i"]: (x["n"], x["c"]) for x in want.collect()}
    order = [F.col("p").desc(), "i"]
    for ranges in (1, 3, 40):
        n = {x["i"]: x["n"] for x in scan.numbered_in_order(df, ["g"], order, "n", ranges).collect()}
        c = {x["i"]: x["c"] for x in scan.carried_forward(df, ["g"], order, "v", "c", ranges).collect()}
        assert {i: (n[i], c[i]) for i in n} == want and len(c) == len(rows)
    assert [x["n"] for x in scan.numbered_in_order(df, [], ["i"], "n", 7).orderBy("i").collect()] == list(range(1, 4001))
    assert scan.numbered_in_order(df.limit(0), ["g"], ["i"]).collect() == []


def test_one_group_of_a_million_rows_meets_in_no_task(spark):
    df = spark.range(1_000_000).select(F.lit("one").alias("g"), F.col("id"), F.when(F.col("id") % 1000 == 0, F.col("id")).alias("v"))
    scanned = scan.scanned_ranges(df, ["g"], ["id"], "v", 16)
    assert max(x["count"] for x in scanned.groupBy("__range").count().collect()) < 200_000
    got = scan.carried_forward(df, ["g"], ["id"], "v", "c", 16)
    assert got.where("c is distinct from case when id > 0 then floor((id - 1) / 1000) * 1000 end").count() == 0
    assert scan.numbered_in_order(df, ["g"], ["id"], "n", 16).where("n <> id + 1").count() == 0


def test_carried_end(spark):
    df = spark.createDataFrame([("u", 0, None), ("u", 1, 0.5), ("u", 2, None), ("u", 3, None)], "u string, p int, e double")
    assert [r["c"] for r in segments.carried_end(df, ["u"], ["p"], "e", "c").orderBy("p").collect()] == [0, 0, 0.5, 0.5]


def test_cohesion(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.6, 0.8]), (0, [0.0, 1.0]), (1, [3.0, 4.0])], "g int, e array<double>")
    got = {r["g"]: r["cohesion"] for r in vectors.cohesion(df, "g", "e").collect()}
    assert got[0] == pytest.approx(0.466667, abs=1e-6) and got[1] == 1.0


def slow_linkage(x, threshold):
    d = 1 - x @ x.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        far = [(max(d[i, j] for i in a for j in b), p, q) for p, a in enumerate(groups) for q, b in enumerate(groups) if p < q]
        v, p, q = min(far)
        if v >= threshold:
            break
        groups[p] += groups.pop(q)
    return {frozenset(g) for g in groups}


def test_complete_linkage_against_loop():
    r = np.random.default_rng(2)
    for n in (1, 2, 5, 30):
        for threshold in (0.05, 0.3, 0.8, 3.0):
            x = r.normal(size=(n, 4))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            label = vectors.complete_linkage(x, threshold)
            assert {frozenset(np.flatnonzero(label == k).tolist()) for k in np.unique(label)} == slow_linkage(x, threshold)


def test_cluster_in_blocks_is_complete_linkage(spark, monkeypatch):
    """No group meets in one task: with blocks of 20 the clusters are those of the whole matrix."""
    monkeypatch.setattr(vectors, "BLOCK", 20)
    monkeypatch.setattr(vectors, "complete_linkage", None)
    r = np.random.default_rng(5)
    rows = [(g, i, (np.eye(6)[i % 5] + 0.45 * r.normal(size=6)).tolist()) for g, n in (("a", 90), (None, 40), ("b", 1)) for i in range(n)]
    rows += [("a", 200 + i, rows[3][2]) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, id long, e array<double>")
    got = {(x["g"], x["id"]): x["cluster"] for x in vectors.cluster(df, "g", "id", "e", 0.3).collect()}
    assert len(got) == len(rows)
    for g in ("a", None, "b"):
        mine = sorted((i, e) for h, i, e in rows if h == g)
        x = np.array([e for _, e in mine])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        name = [got[g, i] for i, _ in mine]
        want = slow_linkage(x, 0.3) if g else None
        sets = {frozenset(k for k, c in enumerate(name) if c == d) for d in set(name)}
        assert g is None or sets == want
        first = [min(k for k, c in enumerate(name) if c == d) for d in range(len(sets))]
        assert first == sorted(first)


def test_voices_targets_and_sweep(spark, monkeypatch):
    r = np.random.default_rng(3)
    base = np.eye(8)[[0, 3]]
    rows = [("EG", i, f"v{i % 3}", (base[i % 2] + 0.05 * r.normal(size=8)).tolist(), 20.0) for i in range(12)]
    df = spark.createDataFrame(rows, "country string, id long, prefix string, e array<double>, dur double")
    c = vectors.cluster(df, "country", "id", "e", 0.45)
    v = vectors.voices(c, df, "country", "id", "e", "dur", "prefix").collect()
    assert len(v) == 2 and all(x["dur"] == 120 and x["n_video"] == 3 and x["dialects"] == ["EG"] for x in v)
    vs = vectors.voices(c, df, "country", "id", "e", "dur", "prefix")
    assert vectors.top_targets(vs, 1).count() == 1 and vectors.top_targets(vs, 0, 500).count() == 0
    assert vectors.conversions(df.select("id"), vs.select("voice", "clips"), "id", "clips").count() == 12
    many = spark.createDataFrame([(f"t{k}", [k, k + 1]) for k in range(7)] + [("t0", [0, 1])], "name string, clips array<long>")
    whole = sorted(map(tuple, vectors.conversions(df.select("id"), many, "id", "clips").collect()), key=repr)
    monkeypatch.setattr(vectors, "TARGETS", 3)
    assert len(whole) == 12 * 8 - 16 and sorted(map(tuple, vectors.conversions(df.select("id"), many, "id", "clips").collect()), key=repr) == whole
    assert vectors.conversions(df.select("id"), many.limit(0), "id", "clips").count() == 0
    s = {(x["threshold"], x["min_cohesion"]): (x["n60"], x["n30"]) for x in vectors.sweep(df, "country", "id", "e", "dur", [0.01, 0.45], [0.7]).collect()}
    assert s[0.45, 0.7] == (2, 2)
    near = neighbours.nearest(df, "id", "e", df.where("id = 0"), 3).collect()
    assert {x["neighbour"] % 2 for x in near} == {0} and [x["rank"] for x in near] == [1, 2, 3]


def test_model_registry(spark):
    models.register("length", lambda: lambda b: b.assign(n=b["text"].str.len())[["id", "n"]])
    df = spark.createDataFrame([(1, "abc"), (2, "")], "id long, text string")
    assert {r["id"]: r["n"] for r in models.apply_model(df, "length", "id long, n long", ["id", "text"], "id").collect()} == {1: 3, 2: 0}


def slow_neighbours(rows, asked, k):
    unit = {i: np.array(e) / np.linalg.norm(e) for i, e in rows}
    return {q: sorted(((round(-float(unit[q] @ unit[i]), 9), i) for i in unit if i != q))[:k] for q in asked}


@pytest.mark.parametrize("block", [neighbours.BLOCK, 16])
def test_nearest_prunes_and_is_exact(spark, monkeypatch, block):
    """Forty tight clusters, a third of all rows one vector, and rows without clusters."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.02 * r.normal(size=16)).tolist()) for i in range(2400)]
    rows += [(5000 + i, centres[7].tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows + rows[:10] * 3, "id long, e array<double>").repartition(5)
    asked = df.where("id % 50 = 0")
    compared = spark.sparkContext.accumulator(0)
    got = neighbours.nearest(df, "id", "e", asked, 4, compared=compared).collect()
    want = slow_neighbours(rows, [i for i, _ in rows if i % 50 == 0], 4)
    for q, best in want.items():
        mine = sorted((x["rank"], x["neighbour"], x["cosine"]) for x in got if x["query"] == q)
        assert [x[0] for x in mine] == [1, 2, 3, 4] and [-round(x[2], 9) for x in mine] == pytest.approx([c for c, _ in best], abs=2e-9)
        if q % 40 != 7 and q < 5000:
            assert [x[1] for x in mine] == [i for _, i in best]
    copies = [x for x in got if x["query"] >= 5000]
    assert {x["neighbour"] for x in copies} <= {5000, 5001, 5002, 5003, 5004} and len(got) == 4 * len(want)
    assert 0 < compared.value < 0.05 * len(rows) * len(want)


def test_nearest_without_clusters_and_on_odd_rows(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=8).tolist()) for i in range(300)]
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (None, [1.0] * 8), (904, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + odd, "id long, e array<double>").withColumn("cell", F.lit("x")).withColumn("r", F.lit(None).cast("int"))
    got = neighbours.nearest(df, "id", "e", df, 3, pivots=10).collect()
    want = slow_neighbours(rows, range(300), 3)
    assert {q: [x["neighbour"] for x in sorted(got, key=lambda x: x["rank"]) if x["query"] == q] for q in want} == {q: [i for _, i in b] for q, b in want.items()}
    assert len(got) == 900
    few = neighbours.nearest(df.where("id < 3"), "id", "e", df.where("id < 5"), 4).collect()
    assert sorted((x["query"], x["rank"]) for x in few) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (4, 1), (4, 2), (4, 3)]
    assert neighbours.nearest(df.limit(0), "id", "e", df).count() == 0 and neighbours.nearest(df, "id", "e", df.limit(0)).count() == 0


def test_meeting_spans_move_once(spark):
    """All pairs of a clip as a join of starts gives them, repeated spans too, without a join."""
    from pyspark.sql import functions as F

    from corpusframe.operators import segments

    rows = [(c, i, j) for c in (1, 2, None) for i in range(7) for j in range(i, min(7, i + 3))] + [(2, 3, 5), (2, 3, 5), (3, 0, 0)]
    a = spark.createDataFrame(rows, "c int, i int, j int").repartition(3)
    got = segments.meeting_spans(a, ["c"])
    want = sorted((c, i, j, k, m) for c, i, j in rows for d, k, m in rows if c is not None and c == d and i <= k <= j and (i < k or j < m))
    assert sorted(map(tuple, got.collect())) == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_ranges_grow_in_number_with_the_rows(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.col("id"), F.repeat(F.lit("x"), 40).alias("t"))
    monkeypatch.setattr(scan, "RANGE_ROWS", 1_000)
    counts = [x["count"] for x in scan.scanned_ranges(df, ["g"], ["id"]).groupBy("__range").count().collect()]
    assert len(counts) > 10 and max(counts) < 4_000 and sum(counts) == 20_000
    assert scan.numbered_in_order(df, ["g"], ["id"]).where("n <> id div 2 + 1").count() == 0
    monkeypatch.setattr(scan, "RANGE_BYTES", 1_000)
    assert scan._kept_rows(df)[1] > 20


def test_meeting_spans_leave_a_worker_in_bounded_parts(spark):
    """300,000 spans of 3 clips have more pairs than one part may hold; with a share only close ones leave."""
    one = [{"i": i, "j": i + n} for i in range(20_000) for n in range(5)]
    parts = list(segments._meeting(pa.array([one] * 3), 0.0))
    brute = sum(1 for i in range(100, 105) for n in range(5) for k in range(i, i + n + 1) for m in range(k, k + 5) if i < k or i + n < m) // 5
    assert len(parts) > 10 and max(len(row) for row, _ in parts) <= segments.PAIRS
    assert sum(len(row) for row, _ in parts) > 3 * 19_900 * brute and {int(r) for row, _ in parts for r in row} == {0, 1, 2}
    a = spark.createDataFrame([("x", 0, 3), ("x", 1, 3), ("x", 2, 3), ("y", 1, 3), (None, 0, 3), (None, 1, 3)], "c string, i int, j int")
    assert [tuple(r) for r in segments.meeting_spans(a, ["c"], 0.65).collect()] == [("x", 0, 3, 1, 3), ("x", 1, 3, 2, 3)]
