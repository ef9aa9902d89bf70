"""Queries of windows, word spans, embeddings, schedules and arrays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.text import tokens
from ..operators import neighbours, segments, select, table_functions, vectors
from .registry import query, sql_tokens


def _milli(c):
    return F.round(F.col(c) * 1000).cast("long")


def _windows(t, length: float, hop: float, shortest: float):
    d = t("documents").select("doc_id", (F.col("n_chars") / 100).alias("dur"))
    s = segments.segment_table(d, "dur", length, hop, shortest)
    return s.select("doc_id", _milli("start_s").alias("start_ms"), _milli("dur_s").alias("dur_ms"))


def sql_windows(length: int, hop: int, shortest: int) -> str:
    """The same in whole milliseconds."""
    return f"""
WITH d AS (SELECT doc_id, n_chars * 10 AS dur FROM documents),
n AS (SELECT *, CASE WHEN dur > {length} THEN (dur - {length}) // {hop} + 1 ELSE 0 END AS n FROM d WHERE dur >= {shortest})
SELECT doc_id, unnest(range(n)) * {hop} AS start_ms, {length} AS dur_ms FROM n
UNION ALL SELECT doc_id, 0, dur FROM n WHERE dur <= {length}
UNION ALL SELECT doc_id, n * {hop}, dur - n * {hop} FROM n WHERE dur > {length} AND dur - n * {hop} >= {shortest}
"""


@query(sql_windows(5000, 5000, 2000))
def q35_segments(t):
    return _windows(t, 5.0, 5.0, 2.0)


@query(sql_windows(5000, 2500, 2000))
def q36_hopping(t):
    return _windows(t, 5.0, 2.5, 2.0)


def timed_turns(t):
    """Turns with words timed by their place and length, in milliseconds made seconds."""
    c = t("conversations").select("conv_id", "turn", tokens(F.col("text")).alias("ws"))
    cost = F.transform("ws", lambda w, i: 60 + 20 * F.char_length(w) + 20 * ((i * 7 + F.col("turn")) % 4))
    c = c.withColumn("cost", cost)
    sums = F.aggregate("cost", F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    c = c.withColumn("begin", sums)
    words = F.transform("ws", lambda w, i: F.struct(w.alias("w"), (F.get("begin", i) / 1000).alias("start"), ((F.get("begin", i) + 60 + 20 * F.char_length(w)) / 1000).alias("end"), F.lit(True).alias("aligned")))
    return c.select("conv_id", "turn", words.alias("words")).withColumn("dur_clip", F.coalesce(F.element_at("words", -1)["end"] + 0.2, F.lit(0.0)))


def spans_of(t):
    return segments.word_spans(timed_turns(t), "words", "dur_clip")


#: Turns' words timed in whole milliseconds and the spans of them, as word_spans makes them.
SPANS = f"""
c AS (SELECT conv_id, turn, {sql_tokens('text')} AS ws FROM conversations),
w AS (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS k, len(ws) AS n FROM c),
x AS (SELECT *, 60 + 20 * length(w) AS own, 20 * ((k * 7 + turn) % 4) AS pause FROM w),
y AS (SELECT *, (coalesce(sum(own + pause) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s FROM x),
z AS (SELECT conv_id, turn, k, n, w, s / 1000 AS st, (s + own) / 1000 AS en FROM y),
v AS (SELECT *, lag(en) OVER q AS pe, lead(st) OVER q AS ns, max(en) OVER (PARTITION BY conv_id, turn) + 0.2 AS dur_clip FROM z WINDOW q AS (PARTITION BY conv_id, turn ORDER BY k)),
p AS (SELECT a.conv_id, a.turn, a.k AS i, b.k AS j, b.k - a.k + 1 AS nw,
 CASE WHEN a.k = 0 THEN greatest(0, a.st - 0.05) ELSE greatest(a.pe, a.pe + (a.st - a.pe) / 2 - 0.035) END AS t0,
 CASE WHEN b.k = b.n - 1 THEN least(b.dur_clip, b.en + 0.05) ELSE least(b.ns, b.en + (b.ns - b.en) / 2 + 0.035) END AS t1,
 least(CASE WHEN a.k = 0 THEN 9.0 ELSE a.st - a.pe END, CASE WHEN b.k = b.n - 1 THEN 9.0 ELSE b.ns - b.en END) AS gap,
 least(a.en - a.st, b.en - b.st) AS width
 FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.k BETWEEN a.k AND a.k + 5),
spans AS (SELECT *, t1 - t0 AS dur FROM p WHERE t1 - t0 BETWEEN 0.43 AND 1.0001)
""".replace("s / 1000", "s::DOUBLE / 1000").replace("(s + own) / 1000", "(s + own)::DOUBLE / 1000").replace("9.0", "9.0::DOUBLE").replace("0.2 AS dur_clip", "0.2::DOUBLE AS dur_clip").replace("0.05)", "0.05::DOUBLE)").replace("0.035)", "0.035::DOUBLE)").replace("BETWEEN 0.43 AND 1.0001", "BETWEEN 0.43::DOUBLE AND 1.0001::DOUBLE").replace("greatest(0,", "greatest(0::DOUBLE,")


@query(f"WITH {SPANS} SELECT conv_id, turn, i, j, nw, round(t0 * 1000)::BIGINT AS t0_ms, round(t1 * 1000)::BIGINT AS t1_ms FROM spans")
def q37_word_spans(t):
    return spans_of(t).select("conv_id", "turn", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("nw").cast("long").alias("nw"), _milli("t0").alias("t0_ms"), _milli("t1").alias("t1_ms"))


@query(sql_windows(5000, 5000, 2000))
def q113_windows_by_sql(t):
    """The windows of q35 through a table function."""
    d = t("documents").select("doc_id", (F.col("n_chars") / 100).alias("dur"))
    table_functions.register(d.sparkSession)
    made = d.sparkSession.sql("SELECT doc_id, start_s, dur_s FROM segment_windows(TABLE({clips}), 'dur', 5.0D, 5.0D, 2.0D)", clips=d)
    return made.select("doc_id", _milli("start_s").alias("start_ms"), _milli("dur_s").alias("dur_ms"))


@query(f"WITH {SPANS} SELECT conv_id, turn, i, j, nw, round(t0 * 1000)::BIGINT AS t0_ms, round(t1 * 1000)::BIGINT AS t1_ms FROM spans")
def q114_spans_by_sql(t):
    """The spans of q37 through a table function, which asks for a clip's words in order."""
    c = t("conversations").select("conv_id", "turn", F.posexplode(tokens(F.col("text"))).alias("k", "w"))
    turn = Window.partitionBy("conv_id", "turn")
    own = 60 + 20 * F.char_length("w")
    begin = F.coalesce(F.sum(own + 20 * ((F.col("k") * 7 + F.col("turn")) % 4)).over(turn.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    words = c.select("*", (begin / 1000).alias("start"), ((begin + own) / 1000).alias("end")).withColumn("dur_clip", F.max("end").over(turn) + 0.2)
    table_functions.register(words.sparkSession)
    s = words.sparkSession.sql("SELECT * FROM word_spans(TABLE({words}), 'conv_id, turn', 'k', 'dur_clip')", words=words)
    return s.select("conv_id", "turn", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("nw").cast("long").alias("nw"), _milli("t0").alias("t0_ms"), _milli("t1").alias("t1_ms"))


@query(f"""
WITH {SPANS}
SELECT conv_id, turn, i, j, CASE WHEN gap >= 0.04::DOUBLE THEN 0 WHEN gap > 0.021::DOUBLE THEN 1 ELSE 2 END AS tier,
(dur >= 0.5::DOUBLE)::INT + (dur >= 0.6::DOUBLE)::INT + (dur >= 0.7::DOUBLE)::INT + (dur >= 0.8::DOUBLE)::INT + (dur >= 0.9::DOUBLE)::INT AS bin
FROM spans WHERE gap >= 0.06::DOUBLE - 1e-9::DOUBLE AND width >= 0.04::DOUBLE - 1e-9::DOUBLE
""")
def q38_boundary_filter(t):
    s = spans_of(t).where(segments.boundary_ok(F.col("words"), F.col("i"), F.col("j"), F.col("gap")))
    return s.select("conv_id", "turn", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "tier", "bin")


@query(f"""
WITH {SPANS}
SELECT conv_id, turn, i, j, k, m, round(common / (nw + w - common), 9) AS share FROM (
SELECT conv_id, turn, a.i, a.j, a.nw, k, b.j AS m, b.nw AS w, least(a.j, b.j) - k + 1 AS common
FROM (SELECT conv_id, turn, i, j, nw, unnest(range(i, j + 1)) AS k FROM spans) a JOIN (SELECT conv_id, turn, i AS k, j, nw FROM spans) b USING (conv_id, turn, k) WHERE a.i < k OR a.j < b.j)
WHERE common / (nw + w - common) > 0.65
""")
def q39_span_overlaps(t):
    """Overlapping spans of a turn that share too many words; a span meets the few that start in it."""
    met = segments.meeting_spans(spans_of(t), ["conv_id", "turn"], 0.65)
    share = segments.span_overlap(F.col("i"), F.col("j"), F.col("k"), F.col("m"))
    return met.withColumn("share", F.round(share, 9)).where("share > 0.65").select("conv_id", "turn", "i", "j", "k", "m", "share")


@query("""
SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS carried FROM events
""")
def q40_carry_forward(t):
    e = t("events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "click", F.col("value")).alias("v"))
    return segments.carried_end(e, ["user_id"], ["ts", "event_id"], "v", "carried").select("event_id", "user_id", "carried")


@query("""
WITH v AS (SELECT label, list(vec_id) AS members, count(*) AS dur FROM embeddings GROUP BY label ORDER BY dur DESC, label LIMIT 3)
SELECT vec_id, v.label AS target FROM embeddings e, v WHERE NOT list_contains(members, vec_id)
""")
def q41_conversions(t):
    e = t("embeddings")
    voices = e.groupBy("label").agg(F.collect_list("vec_id").alias("members"), F.count("*").alias("n"))
    targets = vectors.top_targets(voices.withColumnRenamed("n", "dur"), 3, 0, "label")
    return vectors.conversions(e.select("vec_id"), targets.select("members", F.col("label").alias("target")), "vec_id", "members").select("vec_id", "target")


@query("""
WITH u AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT label, vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM u),
d AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM n), s AS (SELECT label, k, sum(x) AS s, count(*) AS n FROM d GROUP BY ALL)
SELECT label, max(n) AS n, round(CASE WHEN max(n) > 1 THEN (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) ELSE 1 END, 6) AS cohesion FROM s GROUP BY label
""")
def q42_cohesion(t):
    return vectors.cohesion(t("embeddings"), "label", "embedding").withColumn("cohesion", F.round("cohesion", 6))


@query("""
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS c FROM u a, u b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query, neighbour, round(c, 6) AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, neighbour) <= 4
""")
def q43_cosine_topk(t):
    e = t("embeddings")
    return neighbours.nearest(e, "vec_id", "embedding", e.where("vec_id % 50 = 0")).select("query", "neighbour", F.round("cosine", 6).alias("cosine"))


@query()
def q45_quota_fill(t):
    """Spans of all turns chosen by role's quotas: a tenth of each cell's candidates."""
    turns = timed_turns(t).join(t("conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    s = segments.word_spans(turns, "words", "dur_clip")
    s = s.select("role", F.concat_ws(":", "conv_id", "turn").alias("utt"), "i", "j", "nw", "bin", "tier", "gap", (-F.col("dur")).alias("score"), "dur")
    cells = s.groupBy("role", "nw", "bin").agg(F.count("*").alias("n"))
    quotas = cells.select("role", "nw", "bin", F.ceil(F.col("n") / 10).cast("int").alias("quota"))
    return select.quota_fill(s, quotas, "role").select("role", "utt", "i", "j", "nw", "bin", "tier")


@query()
def q46_cluster(t):
    """Voices of each label by complete linkage."""
    e = t("embeddings")
    c = vectors.cluster(e, "label", "vec_id", "embedding", 0.45)
    clips = e.select("label", "vec_id", "embedding", F.lit(30.0).alias("dur"), (F.col("vec_id") % 10).alias("prefix"))
    return vectors.voices(c, clips, "label", "vec_id", "embedding", "dur", "prefix", 0.0, 0.0).select("voice", "dur", "n_video", F.round("cohesion", 3).alias("cohesion"), F.size("clips").alias("n_clips"))


@query("""
WITH e AS (SELECT event_id, event_id % 15 + 1 AS epoch FROM events)
SELECT event_id, epoch, round(CASE WHEN epoch <= 5 THEN 1e-4 * epoch / 5 ELSE 1e-7 + (1e-4 - 1e-7) * 0.5 * (1 + cos(pi() * (epoch - 5) / 10)) END, 12) AS lr,
round(least(1.0, (epoch - 1) / 3.0) * 0.2, 9) AS margin, CASE WHEN epoch < 2 THEN 0 ELSE least(12, (epoch - 1) * 3) END AS unfrozen FROM e
""")
def q48_schedules(t):
    """Every event as a step of some epoch: its rate, margin and number of layers that train."""
    x = F.col("epoch")
    e = t("events").select("event_id", (F.col("event_id") % 15 + 1).alias("epoch"))
    return e.select("event_id", "epoch", F.round(arrays.learning_rate(x, 1e-4, 1e-7, 5, 15), 12).alias("lr"), F.round(arrays.margin(x, 0.2, 3), 9).alias("margin"), arrays.unfrozen(x, 12, 2, 3).alias("unfrozen"))


@query(f"""
WITH c AS (SELECT doc_id, list_transform({sql_tokens('text')}, lambda w: length(w)) AS ids FROM documents),
p AS (SELECT doc_id, ids, CASE WHEN list_position(ids, 7) > 0 THEN list_position(ids, 7) ELSE 1 END AS spot FROM c)
SELECT doc_id, list_concat(list_concat(list_slice(ids, 1, spot), [100, 101]), list_slice(ids, spot + 1, len(ids))) AS prompt,
list_concat(list_concat([-100, -100], ids), [2]) AS labels FROM p
""")
def q49_prompt_mask(t):
    ids = F.transform(F.filter(F.split("text", "(?U)[\\s\\x1c-\\x1f]+"), lambda w: w != ""), F.char_length)
    d = t("documents").select("doc_id", ids.alias("ids"))
    prompt = arrays.insert_after(F.col("ids"), 7, F.array(F.lit(100), F.lit(101)))
    labels = arrays.masked_labels(F.array(F.lit(0), F.lit(0)), F.col("ids"), 2, F.lit(0))
    return d.select("doc_id", prompt.alias("prompt"), labels.alias("labels"))


@query("""
SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best, round(embedding[4]::DOUBLE * 32, 6) AS a, round(embedding[1]::DOUBLE * 32, 6) AS b FROM embeddings
""")
def q50_argmax_permute(t):
    e = t("embeddings").select("vec_id", "embedding", arrays.permuted(F.col("embedding").cast("array<double>"), [3, 0], 32.0).alias("p"))
    return e.select("vec_id", arrays.argmax(F.col("embedding")).alias("best"), F.round(F.get("p", F.lit(0)), 6).alias("a"), F.round(F.get("p", F.lit(1)), 6).alias("b"))
