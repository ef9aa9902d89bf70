"""Queries of corpus builds: transcript joins, modes, budgets, summaries, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import combine, joins, lexicon, metrics, models, quality, select
from ..sources import scratch
from . import corpora
from .registry import SENTENCES, query, sql_edits, sql_normalized, sql_tokens
from .segment_queries import SPANS, spans_of, timed_turns
from .select_queries import sql_key
from .text_queries import LEXICON, RATES, _lexicon, _words, sentences


def _transcripts(t):
    """Two rounds of transcripts for seven tenths of 500 stems; the later row counts."""
    d = t("documents")
    return d.where("doc_id % 10 < 7").select(F.concat(F.lit("s"), (F.col("doc_id") % 500).cast("string")).alias("stem"), F.col("source").alias("text"), F.col("doc_id").alias("row"))


TRANSCRIPTS = "tr AS (SELECT 's' || (doc_id % 500) AS stem, arg_max(source, doc_id) AS text FROM documents WHERE doc_id % 10 < 7 GROUP BY 1)"


@query(f"""
WITH {TRANSCRIPTS}
SELECT doc_id, lang AS dialect, tr.text FROM documents JOIN tr ON tr.stem = 's' || (doc_id % 700)
""")
def q74_transcript_join(t):
    clips = t("documents").select("doc_id", F.col("lang").alias("dialect"), F.concat(F.lit("/audio/"), "lang", F.lit("/s"), (F.col("doc_id") % 700).cast("string"), F.lit(".flac")).alias("audio"))
    return joins.transcripts_to_clips(clips, _transcripts(t), text.stem("audio"), "stem", ["row"]).select("doc_id", "dialect", "text")


@query(f"""
WITH {TRANSCRIPTS}, o AS (SELECT lang AS dialect, doc_id, tr.text FROM documents JOIN tr ON tr.stem = 's' || doc_id),
c AS (SELECT lang AS dialect, 's' || (doc_id % 900) AS src, row_number() OVER (PARTITION BY lang ORDER BY md5('0|' || '/vc/' || lang || '/s' || (doc_id % 900) || '__v' || doc_id || '.wav'), '/vc/' || lang || '/s' || (doc_id % 900) || '__v' || doc_id || '.wav') AS n FROM documents)
SELECT 'original' AS origin, dialect, count(*) * 3 AS n FROM o GROUP BY dialect
UNION ALL SELECT 'clean', dialect, count(*) * 3 FROM o WHERE doc_id % 4 <> 1 GROUP BY dialect
UNION ALL SELECT 'converted', c.dialect, count(*) FROM c JOIN tr ON tr.stem = c.src WHERE n <= 40 GROUP BY c.dialect
""")
def q75_base_build(t):
    d = t("documents")
    path = lambda kind, name: F.concat(F.lit(f"/audio/{kind}/"), "lang", F.lit("/"), name, F.lit(".flac"))
    s = F.concat(F.lit("s"), F.col("doc_id").cast("string"))
    originals = d.select(path("original", s).alias("audio"), F.col("lang").alias("dialect"))
    clean = d.where("doc_id % 4 <> 1").select(path("clean-neural", s).alias("path"))
    converted = d.select(F.concat(F.lit("/vc/"), "lang", F.lit("/s"), (F.col("doc_id") % 900).cast("string"), F.lit("__v"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("audio"), F.col("lang").alias("dialect"))
    return corpora.base_build(originals, clean, converted, _transcripts(t), 40).groupBy("origin", "dialect").agg(F.count("*").alias("n"))


@query(f"""
WITH {SPANS}, f AS (SELECT count(*) AS n FROM spans WHERE gap >= 0.06::DOUBLE - 1e-9::DOUBLE AND width >= 0.04::DOUBLE - 1e-9::DOUBLE), a AS (SELECT count(*) AS n FROM spans), b AS (SELECT count(*) AS n FROM documents)
SELECT 'filtered' AS mode, (SELECT n FROM b) + (SELECT n FROM f) AS rows, 0 AS broken UNION ALL SELECT 'identity', (SELECT n FROM b) + (SELECT n FROM a), 0 UNION ALL SELECT 'none', (SELECT n FROM b), 0
""")
def q76_build_modes(t):
    base = t("documents").select(F.col("doc_id").cast("string").alias("audio"), "text", F.col("lang").alias("dialect"))
    turns = timed_turns(t).withColumn("audio", F.concat_ws(":", "conv_id", "turn"))
    spans = spans_of(t).select(F.concat_ws(":", "conv_id", "turn", "i", "j").alias("audio"), F.col("span_text").alias("text"), F.lit("x").alias("dialect"), F.concat_ws(":", "conv_id", "turn").alias("src"), F.array("i", "j").alias("span"), "gap")
    # spans are listed and met with their words once, for all modes and checks
    path = scratch.folder(base.sparkSession, "met")
    corpora.met_short_clips(spans, turns.select("audio", "words")).write.parquet(path)
    met, out = base.sparkSession.read.parquet(path), []
    for mode in quality.MODES:
        rows, checks = corpora.built_of(base, met, mode)
        bad = checks.agg(F.sum("violations").cast("long").alias("broken"))
        out.append(rows.agg(F.lit(mode).alias("mode"), F.count("*").alias("rows")).crossJoin(bad))
    return quality.together(*out)


CENTS = "round(o_totalprice * 100)::BIGINT"


@query(f"""
WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, {CENTS} AS cents, {sql_key(6, 'o_orderkey')} AS k FROM orders),
h AS (SELECT o_orderpriority, sum(cents) AS have FROM o WHERE o_orderstatus = 'P' GROUP BY 1),
c AS (SELECT o.*, coalesce(have, 0) + coalesce(sum(cents) OVER (PARTITION BY o.o_orderpriority ORDER BY k, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM o LEFT JOIN h USING (o_orderpriority) WHERE o_orderstatus = 'O' AND cents >= 5000000)
SELECT 'with' AS real, o_orderkey::VARCHAR AS id FROM c WHERE run < 2000000000 UNION ALL SELECT 'without', o_orderkey::VARCHAR FROM o WHERE o_orderstatus = 'O' AND cents >= 5000000
""")
def q77_remaining_budget(t):
    o = t("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("dialect"), "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("duration"))
    have = o.where("o_orderstatus = 'P'").groupBy("dialect").agg(F.sum("duration").alias("have"))
    rows = o.where("o_orderstatus = 'O'").select("id", "dialect", "duration")
    one = corpora.remaining_budget(rows, have, 2_000_000_000, None, 5_000_000, 6).select(F.lit("with").alias("real"), "id")
    return one.unionByName(corpora.remaining_budget(rows, None, 0, 5_000_000).select(F.lit("without").alias("real"), "id"))


@query(f"""
WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, {CENTS} AS cents, {sql_key(0, 'o_orderkey')} AS k FROM orders),
a AS (SELECT *, coalesce(sum(cents) OVER (PARTITION BY o_orderpriority ORDER BY k, o_orderkey::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM o WHERE o_orderstatus = 'F' AND cents >= 3000000 AND o_orderkey % 13 <> 0),
r AS (SELECT o_orderkey, o_orderpriority, cents FROM a WHERE run < 700000000),
h AS (SELECT o_orderpriority, sum(cents) AS have FROM r GROUP BY 1),
b AS (SELECT o.*, coalesce(have, 0) + coalesce(sum(cents) OVER (PARTITION BY o.o_orderpriority ORDER BY k, o_orderkey::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM o LEFT JOIN h USING (o_orderpriority) WHERE o_orderstatus <> 'F' AND cents >= 3000000),
u AS (SELECT o_orderkey FROM r UNION ALL SELECT o_orderkey FROM b WHERE run < 700000000),
m AS (SELECT count(*) AS segments, count(DISTINCT l_orderkey) AS clips, round(sum(l_quantity) / 3600, 9) AS hours FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM u))
SELECT m.*, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM u)) AS missed, (SELECT count(*) FROM u WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS uncovered, (SELECT sum(l_linenumber) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM u)) AS lines FROM m
""")
def q78_train_set(t):
    o = t("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("dialect"), "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("duration"))
    real, converted = o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus <> 'F'").drop("o_orderstatus")
    segs = t("lineitem").select(F.col("l_orderkey").cast("string").alias("id"), "l_linenumber", F.col("l_quantity").alias("dur_s"))
    rows, summary = corpora.train_set(real, o.where("cast(id as long) % 13 = 0").select("id"), converted, segs, 700_000_000, 3_000_000)
    return summary.drop("uncovered_share").withColumn("hours", F.round("hours", 9)).crossJoin(rows.agg(F.sum("l_linenumber").alias("lines")))


@query("""
WITH s AS (SELECT user_id AS k, value AS dur FROM events), r AS (SELECT c_custkey AS k FROM customer)
SELECT (SELECT count(*) FROM s WHERE k IN (SELECT k FROM r)) AS segments, (SELECT count(DISTINCT k) FROM s WHERE k IN (SELECT k FROM r)) AS clips, (SELECT round(sum(dur) / 3600, 6) FROM s WHERE k IN (SELECT k FROM r)) AS hours,
(SELECT count(*) FROM s WHERE k NOT IN (SELECT k FROM r)) AS missed, (SELECT count(*) FROM r WHERE k NOT IN (SELECT k FROM s)) AS uncovered
""")
def q79_segment_summary(t):
    out = joins.segment_summary(t("events").select(F.col("user_id").alias("k"), F.col("value").alias("dur")), t("customer").select(F.col("c_custkey").alias("k")), "k", "dur")
    return out.drop("uncovered_share").withColumn("hours", F.round("hours", 6))


@query("SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / 3600, 6) AS F_h, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) / 3600, 6) AS O_h, round(sum(o_totalprice) / 3600, 6) AS total_h FROM orders GROUP BY 1")
def q80_hour_accounts(t):
    out = metrics.hour_accounts(t("orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O"])
    return out.select("o_orderpriority", *[F.round(c, 6).alias(c) for c in ("F_h", "O_h", "total_h")])


@query("""
WITH v AS (SELECT c_nationkey AS g, c_mktsegment, sum(c_acctbal) / 100 AS dur FROM customer GROUP BY ALL),
c AS (SELECT c_nationkey AS g, count(*) AS clips, sum(c_acctbal) / 3600 AS hours FROM customer GROUP BY GROUPING SETS ((c_nationkey), ())),
w AS (SELECT g, count(*) FILTER (dur >= 60) AS long_voices, coalesce(sum(dur) FILTER (dur >= 60), 0) / 60 AS long_minutes, count(*) FILTER (dur >= 30) AS voices, coalesce(sum(dur) FILTER (dur >= 30), 0) / 60 AS minutes FROM v GROUP BY GROUPING SETS ((g), ()))
SELECT c.g, clips, round(hours, 6) AS hours, long_voices, round(long_minutes, 6) AS long_minutes, voices, round(minutes, 6) AS minutes FROM c LEFT JOIN w ON c.g IS NOT DISTINCT FROM w.g
""")
def q81_bank_summary(t):
    c = t("customer").select(F.col("c_nationkey").alias("g"), "c_mktsegment", F.col("c_acctbal").alias("dur"))
    v = c.groupBy("g", "c_mktsegment").agg((F.sum("dur") / 100).alias("dur"))
    out = metrics.bank_summary(v, c, "g")
    return out.select("g", "clips", "long_voices", "voices", *[F.round(x, 6).alias(x) for x in ("hours", "long_minutes", "minutes")])


@query("""
WITH e AS (SELECT event_id, value / 100 AS speech, CASE WHEN event_id % 40 = 0 THEN -1 ELSE 5.0 END AS total FROM events),
f AS (SELECT CASE WHEN total < 0 THEN 'decode_fail' WHEN speech < 0.5 OR speech / total < 0.1 THEN 'empty' WHEN speech / total < 0.3 THEN 'severe' WHEN speech / total < 0.5 THEN 'low' END AS reason FROM e)
SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM e), 9) AS share FROM f WHERE reason IS NOT NULL GROUP BY GROUPING SETS ((reason), ())
""")
def q82_problem_summary(t):
    total = F.when(F.col("event_id") % 40 == 0, -1.0).otherwise(5.0)
    e = t("events").select(F.col("event_id").alias("id"), (F.col("value") / 100).alias("speech"), total.alias("total"))
    flagged = metrics.problems(e, "total", "speech", arrays.speech_severity(F.col("speech"), F.col("speech") / F.col("total")))
    return metrics.problem_summary(flagged, e).withColumn("share", F.round("share", 9))


@query("SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations) WHERE w <> '' GROUP BY w ORDER BY n DESC, w LIMIT 3")
def q83_top_values(t):
    return metrics.top_values(t("conversations").select(F.explode(F.split("text", " ")).alias("w")), "w")


@query("""
WITH k AS (SELECT unnest(['en', 'de', 'xx', 'yy']) AS lang)
SELECT k.lang, count(d.lang) AS n, (SELECT round(avg((coalesce(source, '') <> '')::INT), 9) FROM documents) AS share FROM k LEFT JOIN documents d USING (lang) GROUP BY k.lang
""")
def q84_class_counts(t):
    return metrics.class_counts(t("documents"), "lang", ["en", "de", "xx", "yy"]).crossJoin(metrics.coverage(t("documents"), "source").select(F.round("share", 9).alias("share")))


@query("SELECT event_type, 'n=' || count(*) || '  total_h=' || printf('%.2f', sum(floor(value)) / 3600) || '  top=' || printf('%.2f', max(floor(value))) AS line FROM events GROUP BY event_type")
def q85_format_stats(t):
    s = t("events").groupBy("event_type").agg(F.count("*").alias("n"), (F.sum(F.floor("value")) / 3600).alias("h"), F.max(F.floor("value")).alias("top"))
    return s.select("event_type", metrics.named_values(n=F.col("n").cast("string"), total_h=metrics.two_decimals(F.col("h")), top=metrics.two_decimals(F.col("top"))).alias("line"))


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer UNION SELECT user_id FROM events")
def q86_set_union(t):
    return select.either(t("orders").select(F.col("o_custkey").alias("k")), t("customer").select(F.col("c_custkey").alias("k")), t("events").select(F.col("user_id").alias("k")))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 1 ORDER BY doc_id LIMIT 25")
def q87_sharded_head(t):
    return select.sharded_head(t("documents").select("doc_id"), F.col("doc_id"), 4, 1, 25)


@query(f"""
WITH {SPANS}, cand AS (SELECT conv_id || ':' || turn AS utt, i, j, nw, (dur >= 0.5::DOUBLE)::INT + (dur >= 0.6::DOUBLE)::INT + (dur >= 0.7::DOUBLE)::INT + (dur >= 0.8::DOUBLE)::INT + (dur >= 0.9::DOUBLE)::INT AS bin, gap FROM spans)
SELECT utt, i, j, row_number() OVER (PARTITION BY nw, bin ORDER BY least(gap, 0.5) DESC, j - i DESC, utt, i, j) AS place FROM cand
""")
def q88_candidate_order(t):
    s = spans_of(t).select(F.concat_ws(":", "conv_id", "turn").alias("utt"), "i", "j", "nw", "bin", "gap", (F.col("j") - F.col("i")).alias("score"))
    return select.ranked_candidates(s, ["nw", "bin"]).select("utt", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "place")


@query("""
WITH s AS (SELECT p_size % 5 AS nw, p_partkey % 3 AS bin, count(*) AS supply FROM part GROUP BY ALL), q AS (SELECT s_nationkey % 6 AS nw, s_suppkey % 3 AS bin, count(*) AS quota FROM supplier GROUP BY ALL)
SELECT nw, bin, quota, coalesce(supply, 0) AS supply, row_number() OVER (ORDER BY coalesce(supply, 0) / greatest(quota, 1), nw, bin) AS place FROM q LEFT JOIN s USING (nw, bin)
""")
def q89_scarcity(t):
    s = t("part").select((F.col("p_size") % 5).cast("long").alias("nw"), (F.col("p_partkey") % 3).cast("long").alias("bin"))
    q = t("supplier").groupBy((F.col("s_nationkey") % 6).cast("long").alias("nw"), (F.col("s_suppkey") % 3).cast("long").alias("bin")).agg(F.count("*").alias("quota"))
    return select.scarcity(s, q, ["nw", "bin"])


@query("SELECT conv_id FROM (SELECT DISTINCT conv_id, turn % 3 AS s FROM conversations) GROUP BY conv_id HAVING count(*) = 3")
def q90_common_ids(t):
    return combine.complete_ids(t("conversations").select("conv_id", (F.col("turn") % 3).alias("sys_idx")), 3, "conv_id")


@query("""
WITH c AS (SELECT o_custkey, o_orderkey, -(o_totalprice / 100000) AS lp, o_orderkey % 7 / 7 AS rate FROM orders),
m AS (SELECT o_custkey, max(lp) AS top, avg(rate) AS mean FROM c GROUP BY 1)
SELECT o_custkey, round(sum(exp(lp - top) * (rate - mean)) / sum(exp(lp - top)), 9) AS risk FROM c JOIN m USING (o_custkey) GROUP BY o_custkey
""")
def q91_expected_risk(t):
    o = t("orders").select("o_custkey", (-(F.col("o_totalprice") / 100000)).alias("lp"), (F.col("o_orderkey") % 7 / 7).alias("rate"))
    return metrics.expected_risk(o, "o_custkey", "lp", "rate").withColumn("risk", F.round("risk", 9))


@query(f"""
WITH {SENTENCES}, p AS (SELECT lang, CASE WHEN lang = 'en' THEN [] ELSE ref END AS r, hyp FROM pairs),
e AS (SELECT lang, {sql_edits('r', 'hyp')} AS edits, len(r) AS n_ref FROM p),
g AS (SELECT lang, coalesce(sum(edits) FILTER (n_ref > 0), 0) AS e, coalesce(sum(n_ref) FILTER (n_ref > 0), 0) AS u, count(*) FILTER (n_ref > 0) AS n FROM e GROUP BY lang)
SELECT round(avg(CASE WHEN u > 0 THEN e / u ELSE 0 END), 9) AS macro, round(sum(e) / sum(u), 9) AS micro, sum(n) AS n FROM g
""")
def q92_macro_micro(t):
    """A language whose references are all empty scores 0 and counts in the plain mean."""
    s = sentences(t("documents")).withColumn("ref", F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.col("ref")))
    out = metrics.macro_micro(metrics.corpus_rate(metrics.with_edits(s, F.col("ref"), F.col("hyp")), "lang"))
    return out.select(F.round("macro", 9).alias("macro"), F.round("micro", 9).alias("micro"), "n")


@query(f"""
WITH {LEXICON}, k AS (SELECT lang, folded, surface AS s FROM l WHERE total >= 30 AND top >= 0.6 * total),
j AS (SELECT w.doc_id, max(coalesce(k.s, w.surface) <> w.surface) AS changed FROM w LEFT JOIN k ON w.lang = k.lang AND lower(w.surface) = k.folded GROUP BY w.doc_id)
SELECT (SELECT count(*) FROM documents) AS rows, (SELECT count(*) FROM j WHERE changed) AS changed
""")
def q93_changed_rows(t):
    rows = _words(t)
    return lexicon.changed_rows(lexicon.canonicalize(rows, _lexicon(rows), "doc_id", "lang", "words", F.lower))


@query("""
WITH p AS (SELECT p_partkey AS id, ['encoder.layers.', 'projector.', 'decoder.layers.', 'head.'][p_partkey % 4 + 1] || (p_partkey % 12) || '.w' AS name, p_size AS numel FROM part),
g AS (SELECT *, name LIKE 'encoder.%' OR name LIKE 'projector.%' AS train FROM p)
SELECT CASE WHEN name LIKE 'encoder.%' THEN 1e-5 ELSE 1e-4 END AS lr, CASE WHEN numel > 10 THEN 0.01 ELSE 0.0 END AS wd, count(*) AS tensors, sum(numel) AS numel, (SELECT sum(numel) FROM g WHERE train) AS n_train, (SELECT sum(numel) FROM g) AS n_total, 0 AS wrong FROM g WHERE train GROUP BY 1, 2
""")
def q94_parameter_groups(t):
    kind = F.get(F.array(*map(F.lit, ["encoder.layers.", "projector.", "decoder.layers.", "head."])), (F.col("p_partkey") % 4).cast("int"))
    p = t("part").select(F.concat(kind, (F.col("p_partkey") % 12).cast("string"), F.lit(".w")).alias("name"), F.col("p_size").alias("numel"))
    train, frozen = arrays.begins_with(F.col("name"), ("encoder.", "projector.")), arrays.begins_with(F.col("name"), ("decoder.", "head."))
    rate = F.when(arrays.begins_with(F.col("name"), ("encoder.",)), 1e-5).otherwise(1e-4)
    groups = models.parameter_groups(p.withColumn("trainable", train), rate, F.when(F.col("numel") > 10, 0.01).otherwise(0.0))
    return groups.crossJoin(models.trainable_summary(p, train, frozen))


@query("""
WITH f AS (SELECT lang, min(doc_id) AS first FROM documents GROUP BY lang)
SELECT d.doc_id, d.lang, c.code, (row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id) - 1) // 32 AS batch FROM documents d JOIN (SELECT lang, row_number() OVER (ORDER BY first, lang) - 1 AS code FROM f) c USING (lang)
""")
def q95_label_codes(t):
    d = t("documents").select("doc_id", "lang")
    codes = select.encode_labels(d, "lang", ["doc_id"])
    return select.batch_index(d, ["lang"], ["doc_id"], 32).join(F.broadcast(codes), "lang").select("doc_id", "lang", "code", "batch")


@query("""
WITH f AS (SELECT doc_id AS id, lang AS dialect, n_chars * 10 AS ms FROM documents WHERE doc_id % 3 = 0), s AS (SELECT doc_id AS id, lang AS dialect, n_chars * 10 AS ms FROM documents WHERE doc_id % 3 <> 0),
c AS (SELECT * FROM f UNION ALL SELECT * FROM s), n AS (SELECT *, CASE WHEN ms > 5000 THEN (ms - 5000) // 5000 + 1 ELSE 0 END AS n FROM c WHERE ms >= 2000),
g AS (SELECT dialect, 5000 AS d FROM n, range(n) UNION ALL SELECT dialect, ms FROM n WHERE ms <= 5000 UNION ALL SELECT dialect, ms - n * 5000 FROM n WHERE ms > 5000 AND ms - n * 5000 >= 2000)
SELECT dialect, count(*) AS n, round(count(*) / (SELECT count(*) FROM g), 9) AS share, round(sum(d) / 3600000, 6) AS hours FROM g GROUP BY dialect
""")
def q96_segment_build(t):
    """Two corpora's segments; an id of both counts for the first."""
    d = t("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("dialect"), (F.col("n_chars") / 100).alias("duration"))
    built = corpora.segment_build(d.where("id % 3 = 0"), d, 5.0, 5.0, 2.0)
    return corpora.segment_totals(built).select("dialect", "n", F.round("share", 9).alias("share"), F.round("hours", 6).alias("hours"))


@query("""
SELECT 'original' AS "check", count(*) FILTER (doc_id % 9 = 0) AS violations FROM documents UNION ALL SELECT 'known_group', count(*) FILTER (lang NOT IN ('en', 'de')) FROM documents
UNION ALL SELECT 'begins', count(*) FILTER (doc_id % 7 = 0) FROM documents UNION ALL SELECT 'no_counterpart', count(*) FILTER (doc_id % 5 = 0) FROM documents
UNION ALL SELECT 'empty_group', 2 - count(DISTINCT lang) FILTER (lang IN ('en', 'de')) FROM documents
UNION ALL SELECT 'unexpected_counts', (SELECT count(DISTINCT lang) FROM documents) + CASE WHEN (SELECT count(*) FROM documents WHERE lang = 'zz') = 0 THEN 1 ELSE 0 END
""")
def q97_metadata_checks(t):
    d = t("documents")
    rows = d.select("doc_id", F.concat(F.when(F.col("doc_id") % 9 == 0, "/audio/other/").otherwise("/audio/original/"), "lang").alias("audio"), F.concat(F.when(F.col("doc_id") % 7 == 0, "x").otherwise(text.TEXT_MARK), F.lit("t")).alias("text"), F.col("lang").alias("group"), F.col("doc_id").alias("id"))
    checks = quality.metadata_checks(rows, rows.where("id % 5 <> 0"), ["en", "de"], text.TEXT_MARK)
    return quality.together(checks, quality.unexpected_counts(d, "lang", {"zz": 1}))


LETTERS_ONLY = r"[^ء-ي\s\x0b\x1c-\x1f\x{85}\p{Z}]"
BRANCH = r"[,.،;؛@#؟?!&$ـ_\[\]()]+ *"
ARABIC = "ابتثجحخدذرزسشصضطظعغفقكلمنه"


@query(f"""
WITH a AS (SELECT doc_id, replace(replace(replace(regexp_replace(text, '<[\\p{{L}}\\p{{N}}\\p{{M}}_]+>', '', 'g'), '< ⁇ n ⁇ >', ''), '<', ' <'), '>', '> ') AS x FROM documents),
b AS (SELECT doc_id, translate(array_to_string(list_filter(string_split(replace(x, '▁', ' '), ' '), lambda w: NOT (w LIKE '<%' OR w LIKE '%>')), ' '), 'iIEBC', 'jgGGG') AS x FROM a),
l AS (SELECT doc_id, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{ARABIC}') AS x FROM documents)
SELECT doc_id, {sql_normalized(f"regexp_replace(b.x, '{BRANCH}', ' ', 'g')")} AS asmo,
array_to_string({sql_tokens(f"regexp_replace(regexp_replace(l.x, '[ً-ْٰـ]', '', 'g'), '{LETTERS_ONLY}', ' ', 'g')")}, ' ') AS letters FROM b JOIN l USING (doc_id)
""")
def q98_letter_rules(t):
    """The substitution branch of the training rule, under the scoring rule as well, and letters only."""
    x = text.normalize_scoring(text.normalize_training(F.col("text"), asmo=True))
    y = text.normalize_letters(F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", ARABIC))
    return t("documents").select("doc_id", x.alias("asmo"), y.alias("letters"))


@query("""
WITH a AS (SELECT count(*) AS n, count(*) FILTER (lang IN ('en', 'de')) AS held FROM documents)
SELECT 'rows' AS "check", 2 * n AS violations FROM a UNION ALL SELECT 'whole', (SELECT count(*) FROM documents WHERE doc_id % 7 = 0) FROM a
UNION ALL SELECT 'begins', (SELECT count(*) FROM documents WHERE doc_id % 7 = 0) + (SELECT count(*) FROM documents WHERE doc_id % 4 = 1) FROM a
UNION ALL SELECT 'original', n - held FROM a UNION ALL SELECT 'leakage', (SELECT count(*) FROM documents WHERE doc_id % 10 = 0) FROM a
""")
def q121_assembled(t):
    """Two manifests as one, and the checks of what came together: how many rows there are, whole and
    rightly begun texts, nothing of the held-out audio."""
    d = t("documents")
    text_ = F.concat(F.lit(text.TEXT_MARK), "source")
    where = F.when(F.col("lang").isin("en", "de"), "/audio/original/").otherwise("/audio/original_val/")
    first = d.select(F.concat(where, F.col("doc_id").cast("string")).alias("audio"), F.when(F.col("doc_id") % 7 != 0, text_).alias("text"), F.col("lang").alias("dialect"))
    second = d.select(F.concat(F.lit("/audio/more/"), F.col("doc_id").cast("string")).alias("audio"), F.when(F.col("doc_id") % 4 == 1, "plain").otherwise(text_).alias("text"), F.col("lang").alias("dialect"))
    rows, checks = corpora.assemble([first, second], second.where("cast(substring_index(audio, '/', -1) as long) % 10 = 0"), text.TEXT_MARK)
    return rows.agg(F.lit("rows").alias("check"), F.count("*").alias("violations")).unionByName(checks)


@query("SELECT source, sum(n_chars) AS total, row_number() OVER (ORDER BY sum(n_chars) DESC, source) AS place FROM documents GROUP BY source")
def q122_groups_by_total(t):
    """Groups by falling total, with their places."""
    from pyspark.sql import Window

    per = metrics.by_total(t("documents"), "source", "n_chars")  # one row a group
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.col("total").desc(), "source")))


@query(f"""
WITH w AS (SELECT doc_id, {sql_tokens('text')} AS words FROM documents)
SELECT doc_id, len(words) AS n_words, round(CASE WHEN len(words) > 0 THEN list_sum(list_transform(words, lambda w: length(w))) / len(words) ELSE 0 END, 9) AS mean_length FROM w
""")
def q123_items(t):
    """What two outputs need, and nothing else, from items that say what they take and provide."""
    letters = lambda w: F.aggregate(w, F.lit(0), lambda s, x: s + F.char_length(x))
    items = models.Items().provides("words", ("text",), text.tokens).provides("n_words", ("words",), F.size).provides("letters", ("words",), letters)
    items.provides("mean_length", ("letters", "n_words"), lambda a, n: F.round(F.when(n > 0, a / n).otherwise(0.0), 9)).provides("unused", ("words",), F.array_distinct)
    return items.select(t("documents"), ["doc_id", "n_words", "mean_length"])
