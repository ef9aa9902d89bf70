"""Queries of number and signal rules on arrays, and of what is done in Arrow batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, signal
from ..operators import models, segments
from .file_queries import _waves
from .registry import query, sql_tokens

E = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"""
WITH e AS (SELECT vec_id, {E} AS e FROM embeddings),
f AS (SELECT vec_id, e, vec_id * 37 + 400 AS n FROM e),
c AS (SELECT *, (((n - 10) // 5 + 1 - 3) // 2 + 1 - 3) // 2 + 1 AS frames FROM f)
SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e) + 1e-12), 9) AS rms, frames,
round(least(greatest(frames * 0.02::DOUBLE - 0.01::DOUBLE, 0), 1.5), 4) AS seconds, greatest(n - 1000, 0) // 2 AS centre, greatest(0, least(vec_id * 3, n - 300)) AS clamped,
round(cos(vec_id / 1000), 9) AS cos_m, round(sin(pi() - vec_id / 1000) * (vec_id / 1000), 9) AS mm FROM c
""")
def q99_array_rules(t):
    n, m = F.col("vec_id") * 37 + 400, F.col("vec_id") / 1000
    frames = arrays.frames(n, [10, 3, 3], [5, 2, 2])
    terms = arrays.margin_terms(m)
    x = F.transform("embedding", lambda v: v.cast("double"))
    return t("embeddings").select(
        "vec_id", F.round(arrays.rms(x), 9).alias("rms"), frames.alias("frames"), F.round(arrays.frame_seconds(frames, 0.02, -0.01, F.lit(1.5)), 4).alias("seconds"),
        arrays.centre_start(n, F.lit(1000)).alias("centre"), arrays.clamped_start(F.col("vec_id") * 3, n, F.lit(300)).alias("clamped"), F.round(terms["cos_m"], 9).alias("cos_m"), F.round(terms["mm"], 9).alias("mm"),
    )


@query(f"""
WITH e AS (SELECT vec_id, unnest({E}) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
q AS (SELECT vec_id, k, round_even((sign(x) * ln(1 + 255 * abs(x)) / ln(256) + 1) / 2 * 255, 0) / 255 * 2 - 1 AS q FROM (SELECT vec_id, k, least(1, greatest(-1, x)) AS x FROM e))
SELECT vec_id, round(sum(sign(q) / 255 * (256 ** abs(q) - 1) * k), 6) AS weighed FROM q GROUP BY vec_id
""")
def q100_mu_law(t):
    y = F.transform("embedding", lambda v, k: arrays.mu_law(v.cast("double")) * (k + 1))
    return t("embeddings").select("vec_id", F.round(F.aggregate(y, F.lit(0.0), lambda s, v: s + v), 6).alias("weighed"))


@query(f"""
WITH e AS (SELECT vec_id, {E} AS x, label FROM embeddings), p AS (SELECT vec_id, x, list_transform(range(len(x)), lambda k: x[(vec_id + k) % 5 + 1]) AS n FROM e),
g AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x) + 1e-12) / (sqrt(list_sum(list_transform(n, lambda v: v * v)) / len(n) + 1e-12) + 1e-9) / 10 ** ((vec_id % 20) / 20) AS gain FROM p)
SELECT vec_id, round(list_sum(list_transform(range(1, len(x) + 1), lambda k: k * (x[k] + n[k] * gain))), 6) AS weighed FROM g
""")
def q101_mix_at_snr(t):
    """Each clip with its own first five samples, said again and again, as noise."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    e = t("embeddings").select("vec_id", x.alias("x"))
    noise = arrays.tiled(F.slice("x", 1, 5), F.size("x"), F.col("vec_id"))
    y = F.transform(arrays.mixed(F.col("x"), noise, F.col("vec_id") % 20), lambda v, k: v * (k + 1))
    return e.select("vec_id", F.round(F.aggregate(y, F.lit(0.0), lambda s, v: s + v), 6).alias("weighed"))


@query(f"""
WITH e AS (SELECT vec_id, {E} AS z, label FROM embeddings), s AS (SELECT *, ln(list_sum(list_transform(z, lambda v: exp(v)))) AS total FROM e)
SELECT vec_id, round(CASE WHEN label % 3 <> 2 THEN total - 0.9::DOUBLE * z[label % 8 + 1] - 0.1::DOUBLE * list_sum(z) / len(z) END, 6) AS loss FROM s
""")
def q102_cross_entropy(t):
    label = F.when(F.col("label") % 3 == 2, -100).otherwise(F.col("label") % 8)
    loss = arrays.smoothed_cross_entropy(F.transform("embedding", lambda v: v.cast("double")), label, 0.1)
    return t("embeddings").select("vec_id", F.round(loss, 6).alias("loss"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 12 WHEN p_partkey % 3 = 1 THEN -1 ELSE 11 END AS layer, CASE WHEN p_partkey % 3 = 1 THEN false ELSE CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 12 ELSE 11 END >= 12 - p_size % 12 END AS trainable FROM part
""")
def q103_layers(t):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("m.encoder.layers."), (F.col("p_partkey") % 12).cast("string"), F.lit(".w"))).when(F.col("p_partkey") % 3 == 1, "feature_extractor.conv").otherwise("feature_projection.w")
    layer = arrays.layer_bucket(name, 12)
    return t("part").select("p_partkey", layer.alias("layer"), arrays.trainable(layer, 12, F.col("p_size") % 12).alias("trainable"))


@query()
def q104_forced_alignment(t):
    """Each vector as log probabilities of four labels over frames, aligned to two of them; the tests
    compare with every path."""
    e = t("embeddings")
    frames = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 4).cast("int") - 1), lambda k: F.transform(F.slice("embedding", k * 4 + 1, F.lit(4)), lambda v: v.cast("double") - 1))
    a = segments.align_labels(frames, F.array((F.col("vec_id") % 3 + 1).cast("int"), F.lit(2)))
    return e.select("vec_id", a.alias("a")).select("vec_id", F.round("a.score", 6).alias("score"), F.to_json("a.spans").alias("spans"), "a.error")


@query()
def q105_augmented(t):
    """Every vector as a clip, through one kind of augmentation, and through chains beside itself."""
    waves = _waves(t("embeddings"), "vec_id", F.array_repeat(F.get("embedding", F.lit(0)).cast("double"), 2000))
    pools = {"additive": [signal.encode_wav(signal.np.sin(signal.np.arange(900) / 3))]}
    one = signal.augment_rows(waves, "id", "audio", ("additive", "channel", "speed"), pools).select("id", "kind", F.length("audio").alias("bytes"), "error")
    both = signal.augmented_with_original(waves, "id", "audio", ("speed", "bands", "chunks")).select("id", F.concat_ws("+", "variant", F.array_join("chain", "+")).alias("kind"), F.length("audio").alias("bytes"), "error")
    return one.unionByName(both)


@query()
def q106_cut_sources(t):
    """Spans cut from low-passed clips, and what plainly sounds in them."""
    e = t("embeddings")
    waves = _waves(e, "vec_id", F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), 200)))
    spans = e.select(F.col("vec_id").cast("string").alias("id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select("id", "i", F.col("i").alias("j"), (F.col("i") * 0.1).alias("t0"), (F.col("i") * 0.1 + 0.35).alias("t1"))
    cut = signal.cut_sources(waves, spans, "id", "audio", 2500.0).select(F.col("source").alias("id"), F.concat(F.lit("cut"), F.col("i").cast("string")).alias("kind"), F.col("duration").alias("seconds"), "error")
    said = signal.speech_rows(waves, "id", "audio", signal.loud_frames, 512 / 16000).select("id", F.lit("speech").alias("kind"), F.col("speech_s").alias("seconds"), "error")
    return cut.unionByName(said)


@query(f"""
WITH w AS (SELECT conv_id, turn, list_filter(list_transform({sql_tokens('text')}, lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w: w <> '') AS ws FROM conversations)
SELECT conv_id, turn, list_transform(string_split(array_to_string(ws, '|'), ''), lambda c: CASE WHEN c = '|' THEN 0 ELSE ascii(c) - 96 END) AS target FROM w WHERE len(ws) > 0
""")
def q107_alignment_target(t):
    vocabulary = {c: k for k, c in enumerate("|abcdefghijklmnopqrstuvwxyz")}
    words = t("conversations").select("conv_id", "turn", segments.alignment_words(F.col("text"), vocabulary).alias("words"))
    return words.select("conv_id", "turn", segments.alignment_ids(F.col("words"), vocabulary).alias("target")).where("size(target) > 0")


@query("""
WITH f AS (SELECT vec_id, unnest(embedding) > 0.1 AS act, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
s AS (SELECT vec_id, k, act, k - row_number() OVER (PARTITION BY vec_id, act ORDER BY k) AS g FROM f),
r AS (SELECT vec_id, min(k) AS a, max(k) + 1 AS b FROM s WHERE act GROUP BY vec_id, g),
n AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY vec_id ORDER BY a) < 5 THEN 0 ELSE 1 END AS new FROM r),
c AS (SELECT vec_id, a, b, sum(new) OVER (PARTITION BY vec_id ORDER BY a) AS c FROM n),
m AS (SELECT vec_id, max(b) - min(a) AS d FROM c GROUP BY vec_id, c)
SELECT e.vec_id, round(coalesce(sum(d * 0.02) FILTER (d * 0.02 >= 0.24), 0), 6) AS speech FROM embeddings e LEFT JOIN m USING (vec_id) GROUP BY e.vec_id
""")
def q108_speech_seconds(t):
    """Frame decisions to seconds of speech: short pauses are bridged, short stretches don't count."""
    return t("embeddings").select("vec_id", F.round(signal.speech_of(0.02, 0.24)(F.transform("embedding", lambda v: v > 0.1)), 6).alias("speech"))


@query("SELECT conv_id, turn, length(text) AS n, least(floor(length(text) / 400 * 8), 7)::INT AS bucket FROM conversations")
def q109_model_batches(t):
    """A model over batches of like length."""
    models.register("letters", lambda: lambda b: b.assign(n=b["text"].str.len())[["conv_id", "turn", "n", "bucket"]])
    rows = models.length_batches(t("conversations"), F.char_length("text"), 64, 8, 400.0)
    return models.apply_model(rows, "letters", "conv_id long, turn long, n long, bucket int", ["conv_id", "turn", "text", "bucket"])
