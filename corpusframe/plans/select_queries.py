"""Queries of classification, statistics, selection and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import joins, metrics, numbering, quality, retention, select
from .registry import query


def sql_key(seed, *parts: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"{p}::VARCHAR" for p in parts) + "))"


@query("""
WITH k AS (SELECT unnest([quality, toxic]) AS k, unnest([(quality = toxic)::INT, 0]) AS tp, unnest([0, (quality <> toxic)::INT]) AS fp, unnest([(quality <> toxic)::INT, 0]) AS fn FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
c AS (SELECT k, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM k GROUP BY k),
m AS (SELECT avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END) AS p, avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END) AS r, avg(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS f, sum(tp) AS hit, sum(tp + fn) AS n FROM c)
SELECT n::BIGINT AS n, round(hit / n, 9) AS accuracy, round(p, 9) AS macro_precision, round(r, 9) AS macro_recall, round(f, 9) AS macro_f1 FROM m
""")
def q15_classification(t):
    out = metrics.classification(t("labels"), "quality", "toxic")
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")])


@query("SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def q16_confusion(t):
    return metrics.confusion(t("labels"), "quality", "toxic")


@query("""
WITH e AS (SELECT event_type, value / 100.0 AS speech, 5.0 AS total, value / 500.0 AS ratio FROM events)
SELECT event_type, coalesce(CASE WHEN speech < 0.5 OR ratio < 0.10 THEN 'empty' WHEN ratio < 0.30 THEN 'severe' WHEN ratio < 0.5 THEN 'low' END, 'fine') AS reason,
count(*) AS n, round(avg(100 * ratio), 6) AS mean_pct, round(median(100 * ratio), 6) AS median_pct FROM e GROUP BY ALL
""")
def q17_severity(t):
    e = t("events").select("event_type", (F.col("value") / 100.0).alias("speech"), F.lit(5.0).alias("total"), (F.col("value") / 500.0).alias("ratio"))
    e = e.withColumn("reason", F.coalesce(arrays.speech_severity(F.col("speech"), F.col("ratio")), F.lit("fine")))
    e = e.withColumn("group", F.struct("event_type", "reason"))
    d = metrics.duration_stats(e, "group", F.col("total"), F.col("speech"))
    return d.select("group.*", "n", F.round("mean_pct", 6).alias("mean_pct"), F.round("median_pct", 6).alias("median_pct"))


@query("""
SELECT least(floor(value / 500.0 * 39), 38)::INT AS bin, count(*) AS n FROM events WHERE value / 500.0 BETWEEN 0 AND 1 GROUP BY 1
""")
def q18_ratio_histogram(t):
    return metrics.ratio_histogram(t("events"), F.col("value") / 500.0)


@query("""
WITH g AS (SELECT lang, quantile_cont(n_chars, 0.1) AS gate FROM documents GROUP BY lang)
SELECT doc_id, lang, n_chars, gate FROM documents JOIN g USING (lang) WHERE n_chars >= gate
""")
def q19_percentile_gate(t):
    return metrics.percentile_gate(t("documents"), "lang", "n_chars", 0.1).select("doc_id", "lang", "n_chars", "gate")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 38")
def q20_first_k(t):
    return select.first_k(t("documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 38)


@query("SELECT doc_id % 4 AS shard, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def q21_shard(t):
    d = t("documents").select("doc_id", "n_chars")
    parts = [select.shard(d, F.col("doc_id"), 4, k).withColumn("shard", F.lit(k).cast("long")) for k in range(4)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return whole.groupBy("shard").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


CENTS = "round(o_totalprice * 100)::BIGINT"


def _orders(t):
    return t("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@query(f"""
WITH o AS (SELECT o_orderkey, o_orderpriority, {CENTS} AS cents, {sql_key(1, 'o_orderkey')} AS k FROM orders),
r AS (SELECT *, coalesce(sum(cents) OVER (PARTITION BY o_orderpriority ORDER BY k, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM o)
SELECT o_orderkey, o_orderpriority, cents FROM r WHERE run < 1000000000
""")
def q22_budget_prefix(t):
    o = _orders(t).drop("o_orderstatus")
    return numbering.budget_prefix(o, ["o_orderpriority"], numbering.key_of(1, F.col("o_orderkey")), ["o_orderkey"], F.col("cents"), F.lit(1_000_000_000))


@query(f"""
WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, {CENTS} AS cents, {sql_key(2, 'o_orderkey')} AS k FROM orders),
a AS (SELECT *, coalesce(sum(cents) OVER (PARTITION BY o_orderpriority ORDER BY k, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM o WHERE o_orderstatus = 'F'),
real AS (SELECT o_orderkey, o_orderpriority, cents FROM a WHERE run < 700000000),
h AS (SELECT o_orderpriority, sum(cents) AS have FROM real GROUP BY 1),
b AS (SELECT o.*, coalesce(have, 0) + coalesce(sum(cents) OVER (PARTITION BY o.o_orderpriority ORDER BY k, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM o LEFT JOIN h USING (o_orderpriority) WHERE o_orderstatus <> 'F')
SELECT o_orderkey, o_orderpriority, cents, 'real' AS origin FROM real UNION ALL SELECT o_orderkey, o_orderpriority, cents, 'topup' FROM b WHERE run < 900000000
""")
def q23_topup_with_existing(t):
    o, key = _orders(t), numbering.key_of(2, F.col("o_orderkey"))
    real = numbering.budget_prefix(o.where("o_orderstatus = 'F'"), ["o_orderpriority"], key, ["o_orderkey"], F.col("cents"), F.lit(700_000_000))
    have = real.groupBy("o_orderpriority").agg(F.sum("cents").alias("have"))
    rest = o.where("o_orderstatus <> 'F'").join(F.broadcast(have), "o_orderpriority", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    more = numbering.budget_prefix(rest, ["o_orderpriority"], key, ["o_orderkey"], F.col("cents"), F.lit(900_000_000), F.col("have"))
    cols = ["o_orderkey", "o_orderpriority", "cents"]
    return real.select(*cols, F.lit("real").alias("origin")).unionByName(more.select(*cols, F.lit("topup").alias("origin")))


@query(f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY {sql_key(3, 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber) AS n FROM lineitem),
m AS (SELECT min(c) AS k FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_returnflag))
SELECT l_orderkey, l_linenumber, l_returnflag FROM l, m WHERE n <= k
""")
def q24_balance_cap(t):
    return select.balance(t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", ["l_orderkey", "l_linenumber"], seed=3)


@query(f"SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY {sql_key(4, 'c_custkey')}, c_custkey) <= 60")
def q25_sample_without(t):
    return select.hash_sample(t("customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], ["c_custkey"], 60, 4)


@query(f"""
WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {sql_key(5, 'c_custkey')}, c_custkey) AS n, count(*) OVER (PARTITION BY c_mktsegment) AS size FROM customer),
s AS (SELECT DISTINCT c_mktsegment, size FROM r), d AS (SELECT c_mktsegment, size, unnest(range(400)) AS draw FROM s),
a AS (SELECT c_mktsegment, draw, ('0x' || substr({sql_key(5, 'c_mktsegment', 'draw')}, 1, 8))::BIGINT % size + 1 AS n FROM d)
SELECT c_mktsegment, draw::INT AS draw, c_custkey FROM a JOIN r USING (c_mktsegment, n)
""")
def q26_sample_with(t):
    return select.sample_with_replacement(t("customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], ["c_custkey"], 400, 5)


@query("""
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
q AS (SELECT *, n / sum(n) OVER (PARTITION BY c_nationkey) * (sum(n) OVER (PARTITION BY c_nationkey) * 0.37) AS q, sum(n) OVER (PARTITION BY c_nationkey) * 0.37 AS total FROM c),
s AS (SELECT *, floor(q) AS f, round_even(total, 0) - sum(floor(q)) OVER (PARTITION BY c_nationkey) AS short, row_number() OVER (PARTITION BY c_nationkey ORDER BY q - floor(q) DESC, c_mktsegment) AS rank FROM q)
SELECT c_nationkey, c_mktsegment, n, (f + CASE WHEN rank <= short THEN 1 ELSE 0 END)::BIGINT AS quota FROM s
""")
def q27_largest_remainder(t):
    from pyspark.sql import Window

    c = t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    c = c.withColumn("s", F.sum("n").over(Window.partitionBy("c_nationkey")))
    return select.largest_remainder(c, "c_nationkey", F.col("n") / F.col("s"), F.col("s") * F.lit(0.37), ["c_mktsegment"]).drop("s")


@query("""
SELECT kind, id, count(*) AS n FROM (SELECT 'order' AS kind, o_orderkey AS id, unnest([1, 2, 3]) FROM orders UNION ALL SELECT 'customer', c_custkey, 1 FROM customer) GROUP BY ALL
""")
def q28_replicate_union(t):
    o = select.replicate(t("orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")), 3)
    return o.unionByName(t("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))).groupBy("kind", "id").agg(F.count("*").alias("n"))


@query("""
WITH w AS (SELECT DISTINCT source, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents)
SELECT w FROM w WHERE w <> '' GROUP BY w HAVING count(*) = (SELECT count(DISTINCT source) FROM documents)
""")
def q29_intersect_all_systems(t):
    w = t("documents").select("source", F.explode(F.split(F.lower("text"), "[^a-z]+", -1)).alias("w")).where("w <> ''")
    n = t("documents").agg(F.count_distinct("source").alias("k"))
    per = w.groupBy("w").agg(F.count_distinct("source").alias("c"))
    return per.crossJoin(F.broadcast(n)).where("c = k").select("w")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def q30_except_problem(t):
    return joins.resume(t("documents").select("doc_id"), t("labels").where("toxic = 1"), "doc_id").distinct()


@query("""
WITH h AS (SELECT split_part(url, '/', 3) AS host FROM pages GROUP BY 1 HAVING count(*) >= 3)
SELECT page_id, url FROM pages WHERE split_part(url, '/', 3) IN (SELECT host FROM h)
""")
def q31_prefix_semi(t):
    p, host = t("pages").select("page_id", "url"), F.get(F.split("url", "/"), F.lit(2))
    often = p.groupBy(host.alias("host")).agg(F.count("*").alias("n")).where("n >= 3")
    return joins.keep_prefix(p, often, host, "host")


@query("""
WITH m AS (SELECT l_partkey AS id, max(l_quantity) - 10 AS d FROM lineitem GROUP BY 1)
SELECT coalesce(p_partkey, id) AS id, coalesce(CASE WHEN d > 0 THEN d END, p_retailprice) AS duration FROM part FULL JOIN m ON p_partkey = id WHERE coalesce(CASE WHEN d > 0 THEN d END, p_retailprice) IS NOT NULL
""")
def q32_override_durations(t):
    listed = t("part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("duration"))
    measured = t("lineitem").groupBy(F.col("l_partkey").alias("id")).agg((F.max("l_quantity") - 10).alias("duration"))
    return joins.override_durations(listed, measured, "id", "duration")


@query("""
WITH h AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE text END AS x FROM documents)
SELECT c.conv_id, c.turn, CASE WHEN h.doc_id IS NULL THEN 'MISSING' WHEN trim(regexp_replace(x, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')) = '' THEN 'EMPTY' ELSE 'OK' END AS status,
length(coalesce(trim(regexp_replace(x, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')), '')) AS n_chars FROM conversations c LEFT JOIN h ON c.conv_id * 7 + c.turn = h.doc_id
""")
def q33_submission(t):
    h = t("documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.col("text")).alias("x"))
    m = t("conversations").select("conv_id", "turn", (F.col("conv_id") * 7 + F.col("turn")).alias("doc_id"))
    return joins.submission(m, h, ["doc_id"], "x").select("conv_id", "turn", "status", F.char_length("line").alias("n_chars"))


@query("""
WITH r AS (SELECT DISTINCT c_custkey AS k FROM customer), s AS (SELECT user_id AS k FROM events)
SELECT (SELECT count(*) FROM s WHERE k IN (SELECT k FROM r)) AS matched, (SELECT count(*) FROM s WHERE k NOT IN (SELECT k FROM r)) AS missed,
(SELECT count(*) FROM r WHERE k NOT IN (SELECT k FROM s)) AS uncovered, (SELECT count(*) FROM r) AS rows
""")
def q34_segment_coverage(t):
    out = joins.segment_coverage(t("events").select(F.col("user_id").alias("k")), t("customer").select(F.col("c_custkey").alias("k")), "k")
    return out.drop("uncovered_share")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w <= 3 OR o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS keep
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)
""")
def q47_topk_retention(t):
    return retention.retained(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice", 3)


@query("""
WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT max(n) AS n, min(value) AS min, max(value) FILTER (i = n // 2) AS upper_median, max(value) AS max, round(avg(value), 6) AS mean FROM v
""")
def q51_duration_summary(t):
    return metrics.duration_summary(t("events"), "value").withColumn("mean", F.round("mean", 6))


@query("""
SELECT 'text_present' AS "check", count(*) FILTER (NOT coalesce(length(trim(text)) > 0, false)) AS violations FROM documents
UNION ALL SELECT 'chars_match', count(*) FILTER (NOT coalesce(length(text) = n_chars, false)) FROM documents
UNION ALL SELECT 'known_lang', count(*) FILTER (NOT coalesce(lang IN ('en', 'de', 'es'), false)) FROM documents
UNION ALL SELECT 'duplicates', (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1))
UNION ALL SELECT 'leakage', (SELECT count(*) FROM documents WHERE text IN (SELECT text FROM benchmark))
UNION ALL SELECT 'missing', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
UNION ALL SELECT 'unequal_counts', (SELECT count(*) FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT lang, count(*) AS m FROM documents JOIN labels USING (doc_id) GROUP BY 1) b USING (lang) WHERE n IS DISTINCT FROM m)
""")
def q52_quality_checks(t):
    d, labels = t("documents"), t("labels")
    own = quality.violations(d, text_present=F.length(F.trim("text")) > 0, chars_match=F.char_length("text") == F.col("n_chars"), known_lang=F.col("lang").isin("en", "de", "es"))
    labelled = d.join(labels.select("doc_id"), "doc_id")
    return quality.together(own, quality.duplicate_rows(d, ["text"]), quality.leaked_rows(d, t("benchmark"), ["text"]), quality.missing_rows(d, labels, ["doc_id"]), quality.unequal_counts(d, labelled, "lang"))


@query("""
SELECT role, count(*) AS n, count(*) FILTER (conv_id % 5 = 2) AS broken, count(*) FILTER (conv_id % 5 = 3) AS errors, count(*) FILTER (conv_id % 5 NOT IN (2, 3)) AS good FROM conversations GROUP BY role
""")
def q53_dead_letter(t):
    """Every turn as a log line, some cut off, some holding an error: what a tolerant reader keeps."""
    c = t("conversations")
    ok = F.to_json(F.struct(F.col("conv_id").cast("string").alias("audio"), F.col("text")))
    line = F.when(F.col("conv_id") % 5 == 2, F.substr(ok, F.lit(1), F.length(ok) - 2)).when(F.col("conv_id") % 5 == 3, F.to_json(F.struct(F.col("conv_id").cast("string").alias("audio"), F.lit("unreadable").alias("error")))).otherwise(ok)
    r = F.from_json(line, "audio STRING, text STRING, error STRING, _corrupt_record STRING")
    rows = c.select("role", r.alias("r"))
    bad, err = F.col("r._corrupt_record").isNotNull(), F.col("r.error").isNotNull()
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("broken"), F.count(F.when(err & ~bad, 1)).alias("errors"), F.count(F.when(~bad & ~err, 1)).alias("good"))


@query("""
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL
""")
def ext_hourly_values(t):
    from ..streaming.windows import tumbling

    return tumbling(t("events"), "ts", "1 hour", ["event_type"], "value")
