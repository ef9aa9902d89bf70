"""Queries of text rules and error rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edit, text
from ..operators import combine, lexicon, metrics
from .registry import BLANK, SENTENCES, query, sql_edits, sql_normalized, sql_tokens


def sentences(documents, moduli: tuple[int, int] | None = (7, 11)):
    """Sentences of whole documents as utterances, and a perturbed hypothesis of each."""
    s = documents.select("doc_id", "lang", "source", F.posexplode(F.split("text", "[.\n]", -1)).alias("p", "s"))
    s = s.select("doc_id", "lang", "source", (F.col("p") + 1).alias("pos"), text.scoring_words(F.col("s")).alias("ref"))
    return s.withColumn("hyp", perturbed(F.col("ref"), *moduli)) if moduli else s


def perturbed(words, drop: int, replace: int):
    at = lambda i: i + 1 + F.col("doc_id") + F.col("pos")
    made = F.transform(words, lambda w, i: F.when(at(i) % drop == 3, None).when(at(i) % replace == 5, "unk").otherwise(w))
    return F.filter(made, lambda w: w.isNotNull())


@query(f"SELECT doc_id, {sql_normalized('text')} AS norm FROM documents")
def q01_text_normalize(t):
    return t("documents").select("doc_id", text.normalize_scoring(F.col("text")).alias("norm"))


@query(f"""
WITH a AS (SELECT doc_id, replace(replace(replace(regexp_replace(text, '<[\\p{{L}}\\p{{N}}\\p{{M}}_]+>', '', 'g'), '< ⁇ n ⁇ >', ''), '<', ' <'), '>', '> ') AS x FROM documents),
b AS (SELECT doc_id, array_to_string(list_filter(string_split(replace(x, '▁', ' '), ' '), lambda w: NOT (w LIKE '<%' OR w LIKE '%>')), ' ') AS x FROM a),
c AS (SELECT doc_id, replace(replace(lower(translate(x, 'ىةإأآ', 'يهااا')), 'سين', 'س'), 'جيم', 'ج') AS x FROM b)
SELECT doc_id, trim(regexp_replace(regexp_replace(x, '[,.،;؛@#؟?!&$ـ_\\[\\]()]+ *', ' ', 'g'), '{BLANK}', ' ', 'g')) AS norm FROM c
""")
def q02_train_normalize(t):
    return t("documents").select("doc_id", text.normalize_training(F.col("text")).alias("norm"))


@query("""
SELECT doc_id, replace(translate(text, 'ىةإأآ', 'يهااا'), 'ﻻ', 'لا') AS folded,
length(text) - length(translate(text, 'éèàçñöüß', '')) AS accents FROM documents
""")
def q03_fold(t):
    return t("documents").select("doc_id", text.fold_letters(F.col("text")).alias("folded"), text.count_characters(F.col("text"), "éèàçñöüß").alias("accents"))


@query("""
WITH d AS (SELECT doc_id, 'language ' || lang || '<asr_text>' || text || '<asr_text>' || source AS x FROM documents)
SELECT doc_id, substr(x, strpos(x, '<asr_text>') + 10) AS first_part, string_split(x, '<asr_text>')[-1] AS last_part FROM d
""")
def q04_prefix_strip(t):
    x = F.concat(F.lit("language "), "lang", F.lit(text.TEXT_MARK), "text", F.lit(text.TEXT_MARK), "source")
    return t("documents").select("doc_id", text.after_first(x).alias("first_part"), text.after_last(x).alias("last_part"))


@query(f"""
WITH w AS (SELECT lang, unnest({sql_tokens('text')}) AS w FROM documents)
SELECT lang, count(*) AS n_tokens, count(DISTINCT w) AS n_distinct, sum(length(w)) AS n_letters, max(length(w)) AS longest FROM w GROUP BY lang
""")
def q05_token_stats(t):
    w = t("documents").select("lang", F.explode(text.tokens(F.col("text"))).alias("w"))
    return w.groupBy("lang").agg(F.count("*").alias("n_tokens"), F.count_distinct("w").alias("n_distinct"), F.sum(F.char_length("w")).alias("n_letters"), F.max(F.char_length("w")).alias("longest"))


@query(r"""
SELECT page_id, regexp_extract(string_split(string_split(url, '?')[1], '#')[1] || '.html', '([^/]+?)(\.[^./]*)?$', 1) AS stem FROM pages
""")
def q06_path_stem(t):
    path = F.regexp_extract("url", "^[^?#]*", 0)
    return t("pages").select("page_id", text.stem_simple(F.concat(path, F.lit(".html"))).alias("stem"))


@query("""
WITH p AS (SELECT page_id, ['Algeria','EGYPT','jordan','none','Morocco','UAE','k2hub'][page_id % 7 + 1] AS c FROM pages)
SELECT page_id, CASE lower(c) WHEN 'algeria' THEN 'Algeria' WHEN 'egypt' THEN 'Egypt' WHEN 'jordan' THEN 'Jordan' WHEN 'morocco' THEN 'Morocco' WHEN 'uae' THEN 'UAE' ELSE '' END AS any_case,
CASE WHEN c IN ('Algeria', 'Morocco', 'UAE') THEN c ELSE '' END AS exact_case,
CASE WHEN page_id % 2 = 0 THEN 'Yemen' ELSE CASE lower(c) WHEN 'algeria' THEN 'Algeria' WHEN 'egypt' THEN 'Egypt' WHEN 'jordan' THEN 'Jordan' WHEN 'morocco' THEN 'Morocco' WHEN 'uae' THEN 'UAE' ELSE '' END END AS resolved,
CASE WHEN page_id % 3 = 0 THEN (page_id % 500) / 100.0 ELSE 0 END AS seconds FROM p
""")
def q07_group_from_path(t):
    c = F.get(F.array(*map(F.lit, ["Algeria", "EGYPT", "jordan", "none", "Morocco", "UAE", "k2hub"])), (F.col("page_id") % 7).cast("int"))
    path = F.concat(F.lit("/Yemen/audio/x/"), c, F.lit("/"), F.col("page_id").cast("string"), F.lit(".flac"))
    uid = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("v_100-"), (F.col("page_id") % 500 + 100).cast("string"))).otherwise(F.lit("plain"))
    field = F.when(F.col("page_id") % 2 == 0, " yemen ").otherwise("ar")
    return t("pages").select("page_id", text.group_from_path(path).alias("any_case"), text.group_from_path_exact(path).alias("exact_case"), text.group_of([field], path).alias("resolved"), text.seconds_from_id(uid).alias("seconds"))


RATES = """
SELECT lang, sum(edits) FILTER (n_ref > 0) AS edits, sum(n_ref) FILTER (n_ref > 0) AS units, count(*) FILTER (n_ref > 0) AS n,
sum(edits) FILTER (n_ref > 0) / sum(n_ref) FILTER (n_ref > 0) AS rate FROM e GROUP BY GROUPING SETS ((lang), ())
"""


@query(f"WITH {SENTENCES}, e AS (SELECT lang, {sql_edits('ref', 'hyp')} AS edits, len(ref) AS n_ref FROM pairs) {RATES}")
def q08_corpus_wer(t):
    scored = metrics.with_edits(sentences(t("documents")), F.col("ref"), F.col("hyp"))
    return metrics.corpus_rate(scored, "lang").select("lang", "edits", "units", "n", "rate")





#: Letters beyond ASCII that the sample texts use, and punctuation (which normalized text has none
#: of) to stand for them, as DuckDB compares bytes (fixed values).
LETTERS, STANDINS = "éóèñüçäöêßíÉÈÑÓÇÊÜÖÄÍ", "!#$%&()*+-/:;<=>?@[]^"


@query(f"""
WITH {SENTENCES}, c AS (SELECT lang, translate(array_to_string(ref, ' '), '{LETTERS}', '{STANDINS}') AS r, translate(array_to_string(hyp, ' '), '{LETTERS}', '{STANDINS}') AS h FROM pairs WHERE len(ref) > 0),
e AS (SELECT lang, levenshtein(r, h) AS edits, length(r) AS n_ref FROM c) {RATES}
""")
def q09_corpus_cer(t):
    # sentences without words are left out of the sums, not by a filter, for which words would be split again
    s = sentences(t("documents")).select("lang", F.array_join("ref", " ").alias("r"), F.array_join("hyp", " ").alias("h"))
    rates = metrics.corpus_rate(metrics.with_char_edits(s, F.col("r"), F.col("h")), "lang")
    return rates.where("n > 0 or pooled = 1").select("lang", "edits", "units", "n", "rate")


@query(f"""
WITH {SENTENCES}, two AS (SELECT lang, doc_id, pos, hyp, unnest([1, 2]) AS place, unnest([ref, list_reverse(ref)]) AS r FROM pairs),
e AS (SELECT *, {sql_edits('r', 'hyp')} AS edits, len(r) AS n_ref FROM two),
b AS (SELECT lang, doc_id, pos, arg_min({{'e': edits, 'n': n_ref}}, {{'r': edits / n_ref, 'p': place}}) FILTER (n_ref > 0) AS m FROM e GROUP BY ALL)
SELECT lang, sum(coalesce(m.e, 0)) AS edits, sum(coalesce(m.n, 0)) AS units FROM b GROUP BY lang
""")
def q10_mr_wer(t):
    s = sentences(t("documents")).withColumn("r", F.explode(F.array(F.struct(F.lit(1).alias("place"), "ref"), F.struct(F.lit(2).alias("place"), F.reverse("ref").alias("ref")))))
    s = metrics.with_edits(s.select("lang", "doc_id", "pos", "hyp", "r.place", "r.ref"), F.col("ref"), F.col("hyp"))
    best = metrics.best_reference(s, ["lang", "doc_id", "pos"])
    return best.groupBy("lang").agg(F.sum("best_edits").alias("edits"), F.sum("best_n").alias("units"))


@query(f"""
WITH {SENTENCES}, e AS (SELECT lang, source, {sql_edits('ref', 'hyp')} AS edits, len(ref) AS n_ref, len(hyp) AS n_hyp FROM pairs),
g AS (SELECT *, CASE WHEN lang = 'en' THEN '_nondialect' ELSE lang END AS g, CASE WHEN n_ref = 0 THEN CASE WHEN n_hyp = 0 THEN 0.0 ELSE 1.0 END ELSE edits / n_ref END AS u FROM e)
SELECT round((SELECT avg(u) FROM g), 9) AS utterance_rate,
round((SELECT avg(r) FROM (SELECT sum(edits) / sum(n_ref) AS r FROM g WHERE n_ref > 0 GROUP BY source)), 9) AS macro_domain,
round((SELECT avg(r) FROM (SELECT sum(edits) / sum(n_ref) AS r FROM g WHERE n_ref > 0 AND g <> '_nondialect' GROUP BY g)), 9) AS macro_group
""")
def q11_dev_report(t):
    s = metrics.with_edits(sentences(t("documents")), F.col("ref"), F.col("hyp")).withColumn("g", F.when(F.col("lang") == "en", "").otherwise(F.col("lang")))
    out = metrics.dev_report(s, "source", "g")
    return out.select(*[F.round(c, 9).alias(c) for c in ("utterance_rate", "macro_domain", "macro_group")])


@query(f"""
WITH {SENTENCES}, c AS (SELECT CASE WHEN (doc_id + pos) % 3 = 0 THEN [] ELSE ref END AS r, CASE WHEN (doc_id + pos) % 4 = 0 THEN [] ELSE hyp END AS h, lang FROM pairs),
e AS (SELECT lang, {sql_edits('r', 'h')} AS edits, len(r) AS n_ref, len(h) AS n_hyp FROM c)
SELECT lang, count(*) FILTER (n_ref = 0 AND n_hyp = 0) AS both_empty, count(*) FILTER (n_ref = 0 AND n_hyp > 0) AS ref_empty,
round(sum(CASE WHEN n_ref = 0 THEN CASE WHEN n_hyp = 0 THEN 0.0 ELSE 1.0 END ELSE edits / n_ref END), 6) AS total_rate FROM e GROUP BY lang
""")
def q12_empty_ref_rules(t):
    none = F.array().cast("array<string>")
    at = F.col("doc_id") + F.col("pos")
    s = sentences(t("documents")).select("lang", F.when(at % 3 == 0, none).otherwise(F.col("ref")).alias("r"), F.when(at % 4 == 0, none).otherwise(F.col("hyp")).alias("h"))
    s = metrics.with_edits(s, F.col("r"), F.col("h"))
    rate = edit.utterance_rate(F.col("edits"), F.col("n_ref"), F.col("n_hyp"))
    return s.groupBy("lang").agg(F.count(F.when((F.col("n_ref") == 0) & (F.col("n_hyp") == 0), 1)).alias("both_empty"), F.count(F.when((F.col("n_ref") == 0) & (F.col("n_hyp") > 0), 1)).alias("ref_empty"), F.round(F.sum(rate), 6).alias("total_rate"))


LEXICON = f"""
w AS (SELECT lang, doc_id, unnest(list_filter(string_split_regex({sql_normalized('text')}, ' '), lambda t: t <> '')) AS surface, generate_subscripts(list_filter(string_split_regex({sql_normalized('text')}, ' '), lambda t: t <> ''), 1) AS pos FROM documents),
f AS (SELECT lang, surface, lower(surface) AS folded, count(*) AS n, min({{'d': doc_id, 'p': pos}}) AS first FROM w GROUP BY lang, surface),
l AS (SELECT lang, folded, sum(n) AS total, max(n) AS top, arg_min(surface, {{'n': -n, 'f': first}}) AS surface FROM f GROUP BY lang, folded)
"""


def _lexicon(docs):
    return lexicon.build_lexicon(docs, "lang", "words", ["doc_id"], F.lower)


def _words(t):
    return t("documents").select("doc_id", "lang", text.scoring_words(F.col("text")).alias("words"))


@query(f"WITH {LEXICON} SELECT lang, folded, surface FROM l WHERE total >= 30 AND top >= 0.6 * total")
def q13_lexicon(t):
    return _lexicon(_words(t))


@query(f"""
WITH {LEXICON}, k AS (SELECT lang, folded, surface AS s FROM l WHERE total >= 30 AND top >= 0.6 * total),
j AS (SELECT w.doc_id, w.lang, w.pos, w.surface AS old, coalesce(k.s, w.surface) AS new FROM w LEFT JOIN k ON w.lang = k.lang AND lower(w.surface) = k.folded)
SELECT d.doc_id, coalesce(x.line, '') AS line, coalesce(x.changed, false) AS changed FROM documents d LEFT JOIN (SELECT doc_id, string_agg(new, ' ' ORDER BY pos) AS line, max(new <> old) AS changed FROM j GROUP BY doc_id) x USING (doc_id)
""")
def q14_canonicalize(t):
    rows = _words(t)
    out = lexicon.canonicalize(rows, _lexicon(rows), "doc_id", "lang", "words", F.lower)
    return out.select("doc_id", F.array_join("words", " ").alias("line"), "changed")


def sql_perturbed(drop: int, replace: int) -> str:
    return f"list_filter([CASE WHEN (i + doc_id + pos) % {drop} = 3 THEN NULL WHEN (i + doc_id + pos) % {replace} = 5 THEN 'unk' ELSE ref[i] END FOR i IN range(1, len(ref) + 1)], lambda x: x IS NOT NULL)"


#: The table of distances row by row (an insertion continues a row: a running minimum of value minus
#: place), the path back from its end, and the votes for each of the pivot's places.
@query(f"""
WITH RECURSIVE {SENTENCES},
systems AS (SELECT doc_id || ':' || pos AS utt, {sql_perturbed(10**9, 11)} AS p, [{sql_perturbed(7, 11)}, {sql_perturbed(5, 13)}] AS os FROM refs),
named AS (SELECT *, list_distinct(list_concat(p, list_concat(os[1], os[2]))) AS ws FROM systems),
two AS (SELECT utt, s, list_transform(p, lambda w: list_position(ws, w)::INT) AS p, list_transform(os[s], lambda w: list_position(ws, w)::INT) AS o FROM named, (VALUES (1), (2)) v(s)),
d AS (SELECT utt, s, p, o, 0 AS i, range(0, len(o) + 1)::INT[] AS r FROM two WHERE p <> o UNION ALL
 SELECT utt, s, p, o, i + 1, list_transform(range(0, len(o) + 1), lambda j: (j + list_min(v[:j + 1]))::INT)
 FROM (SELECT *, list_prepend(i + 1, list_transform(range(1, len(o) + 1), lambda k: (least(r[k + 1] + 1, r[k] + (p[i + 1] <> o[k])::INT) - k)::INT)) AS v FROM d WHERE i < len(p))),
m AS (SELECT utt, s, list(r ORDER BY i) AS t FROM d GROUP BY utt, s),
n AS (SELECT utt, s, p, o, t FROM m JOIN two USING (utt, s)),
b AS (SELECT utt, s, p, o, t, len(p) AS i, len(o) AS j, NULL::BIGINT AS pos, NULL::BIGINT AS k FROM n UNION ALL
 SELECT utt, s, p, o, t, i - (mv <> 'left')::INT, j - (mv <> 'up')::INT, CASE WHEN mv <> 'left' THEN i END, CASE WHEN mv = 'diagonal' THEN j END
 FROM (SELECT *, CASE WHEN j > 0 AND t[i + 1][j + 1] = t[i][greatest(j, 1)] + (p[i] <> o[greatest(j, 1)])::INT THEN 'diagonal' WHEN t[i + 1][j + 1] = t[i][j + 1] + 1 THEN 'up' ELSE 'left' END AS mv FROM b WHERE i > 0)),
met AS (SELECT utt, s, pos, o[k] AS code FROM b WHERE pos IS NOT NULL UNION ALL SELECT utt, s, unnest(range(1, len(p) + 1)), unnest(p) FROM two WHERE p = o),
slots AS (SELECT utt, s, met.pos, coalesce(ws[code], '') AS word, CASE s WHEN 1 THEN 1.10::DOUBLE ELSE 1.05::DOUBLE END AS w FROM met JOIN named USING (utt)
 UNION ALL SELECT utt, 0, unnest(range(1, len(p) + 1)), unnest(p), 1.30::DOUBLE FROM systems),
votes AS (SELECT utt, pos, word, sum(w) AS w, min(s) AS first FROM slots GROUP BY ALL),
won AS (SELECT utt, pos, arg_max(word, [w, -first]) AS word FROM votes GROUP BY ALL)
SELECT utt AS utt_id, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (word <> ''), '') AS line FROM systems LEFT JOIN won USING (utt) GROUP BY utt
""")
def q44_rover(t):
    """Three perturbed systems of every sentence, combined."""
    s = sentences(t("documents"), None)
    lists = [perturbed(F.col("ref"), *m) for m in ((10**9, 11), (7, 11), (5, 13))]
    words = combine.vote_columns([1.30, 1.10, 1.05], *lists)
    return s.select(F.concat_ws(":", "doc_id", "pos").alias("utt_id"), F.array_join(words, " ").alias("line"))
