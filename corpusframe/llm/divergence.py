"""How the sources of a language differ in their words: exact sums over heavy and light terms."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, discard, materialize, release, small, table

#: Documents of a language that a kept term is in; what every count is raised by; the scale of shares.
MIN_DOCS, PRIOR, ONE = 30, 5, 1_000_000_000
#: Ranks of a group's own terms that are given.
TOP = 50
#: Terms in more groups than the smaller of LIGHT and a quarter of the language's groups are heavy.
LIGHT = 32
#: Groups and terms of a dense tile, light rows of a bucket (terms are dealt by a hash, so about).
TILE_GROUPS, TILE_TERMS, BUCKET_ROWS = 64, 2048, 65_536
#: Entries that a worker counts before it hands them on.
HELD = 200_000
#: Bytes of terms: A-Z become a-z, and all that is below 128 and no letter ends a term.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_SUMS = pa.schema([("lang", pa.string()), ("g", pa.int32()), ("h", pa.int32()), ("value", pa.int64())])
_SUMS_SQL = "lang string, g int, h int, value long"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts of every group's terms, and a row with a null term
    for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        docs: dict[tuple, Counter] = defaultdict(Counter)

        def give() -> Iterator[pa.RecordBatch]:
            for (lang, source), words in n.items():
                said = docs[lang, source]
                terms = [None, *(w.decode() for w in words)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()),
                     pa.array([0, *words.values()], pa.int64()), pa.array([0, *(said[w] for w in words)], pa.int64())], schema=_COUNTS,
                )
            n.clear()
            docs.clear()

        for batch in batches:
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for names, texts in chunks(groups, batch.column(2).to_pylist()):
                for name, text in zip(names, texts, strict=True):
                    words = text.encode().translate(TERMS).split()
                    n[name].update(words)
                    docs[name].update(set(words))
                if sum(map(len, n.values())) > HELD:
                    yield from give()
        yield from give()
        release()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(ONE * (n + PRIOR) / (total + PRIOR * kept)), in exact integers."""
    big = lambda c: c.cast("decimal(38,0)")
    whole = F.call_function("div", big(F.lit(ONE)) * (n + PRIOR).cast("decimal(25,0)"), (total + PRIOR * kept).cast("decimal(38,0)"))
    return F.when(kept > 0, whole + 1).otherwise(0).cast("long")


def sums(parts: tuple[np.ndarray, np.ndarray, np.ndarray], lang: str) -> pa.Table:
    g, h, value = parts
    return pa.table([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int32()), pa.array(h, pa.int32()), pa.array(value, pa.int64())], schema=_SUMS)


def _tile(key: tuple, t: pa.Table, tile: int) -> pa.Table:
    """Heavy terms of one slice between two blocks of groups: a dense array of shares for each block,
    a group's base where it lacks a term. What counts is how much farther apart the shares are than
    the bases; the first slice also has the bases' distance for every kept term, light ones and those of
    neither block included."""
    lang, lo, hi, part = (k.as_py() for k in key)
    at = np.asarray(t["at"])
    is_base = np.asarray(t["term"].is_null())
    terms = t["term"].filter(pa.array(~is_base)).combine_chunks().dictionary_encode()
    col, row, p = np.asarray(terms.indices), at[~is_base], np.asarray(t["p"])
    bases, kept = dict(zip(at[is_base].tolist(), p[is_base].tolist(), strict=True)), int(np.asarray(t["kept"])[is_base][0])

    def dense(block: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(sorted(i for i in bases if i // tile == block), dtype=np.int64)
        out = np.repeat(np.array([bases[i] for i in ids.tolist()], dtype=np.int64)[:, None], len(terms.dictionary) + 1, axis=1)
        mine = row // tile == block
        out[np.searchsorted(ids, row[mine]), col[mine]] = p[~is_base][mine]
        return ids, out

    left, a = dense(lo)
    right, b = dense(hi) if hi != lo else (left, a)
    none = np.zeros(0, dtype=np.int64)
    g, h, value = [none], [none], [none]
    for i, x in zip(left.tolist(), a, strict=True):
        other = right > i
        far = np.abs(b[other] - x)  # the last column holds bases only
        g.append(np.full(other.sum(), i))
        h.append(right[other])
        value.append(far[:, :-1].sum(axis=1) + ((kept if part == 0 else 0) - far.shape[1] + 1) * far[:, -1])
    return sums((np.concatenate(g), np.concatenate(h), np.concatenate(value)), lang)


def _against_bases(key: tuple, t: pa.Table) -> pa.Table:
    """Light terms of a block's groups against the bases of all groups: what a term adds where the
    other group lacks it. Sorted shares and their running sums answer all bases at once."""
    lang = key[0].as_py()
    at, p = np.asarray(t["at"]), np.asarray(t["p"])
    is_base = np.asarray(t["term"].is_null())
    order = np.argsort(at[is_base])
    ids, bases = at[is_base][order], p[is_base][order]
    at, p = at[~is_base], p[~is_base]
    none = np.zeros(0, dtype=np.int64)
    g, h, value = [none], [none], [none]
    for i in np.unique(at):
        mine = np.sort(p[at == i])
        run = np.r_[0, np.cumsum(mine)]
        k = np.searchsorted(mine, bases)
        far = bases * k - run[k] + (run[-1] - run[k]) - bases * (len(mine) - k)
        far -= len(mine) * np.abs(bases[np.searchsorted(ids, i)] - bases)
        other = ids != i
        g.append(np.minimum(ids, i)[other])
        h.append(np.maximum(ids, i)[other])
        value.append(far[other])
    return sums((np.concatenate(g), np.concatenate(h), np.concatenate(value)), lang)


def _postings(key: tuple, t: pa.Table) -> pa.Table:
    """Corrections for light terms that both groups of a pair have. A term has LIGHT groups at
    most, so neighbours at each distance under LIGHT in the order of terms are all its pairs."""
    lang = key[0].as_py()
    code = np.asarray(t["term"].combine_chunks().dictionary_encode().indices)
    order = np.lexsort((np.asarray(t["at"]), code))
    code, at, p, base = (np.asarray(x)[order] for x in (code, t["at"], t["p"], t["base"]))
    pairs, value = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for d in range(1, LIGHT):
        i = np.flatnonzero(code[d:] == code[:-d])
        if not len(i):
            break
        j = i + d
        far = np.abs(p[i] - p[j]) - np.abs(p[i] - base[j]) - np.abs(base[i] - p[j]) + np.abs(base[i] - base[j])
        pairs.append(at[i].astype(np.int64) << 32 | at[j])
        value.append(far)
    pairs, where = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(total, where, np.concatenate(value))
    return sums((pairs >> 32, pairs & 0xFFFFFFFF, total), lang)


def divergence(docs: DataFrame, light: int = LIGHT, min_docs: int = MIN_DOCS, top: int = TOP, tile: int = TILE_GROUPS) -> DataFrame:
    """How far the groups (lang, source) of documents lie apart: lang, source, part, item, value, rank.

    A language keeps the terms that at least min_docs of its documents hold. A kept term's share in a
    group is raised by PRIOR counts. Part `pair`: for each other source of the language, the sum of
    absolute differences of shares over all kept terms. Part `term`: the `top` terms whose share lies
    highest over the language's.

    Sums over pairs never list the terms of two groups beside each other. Terms in many groups go
    to dense tiles (blocks of groups by slices of terms). A light term, in `light` groups at most (LIGHT
    at the very most) and in a quarter of the language's groups at most, is set against the other
    groups' bases (the share of a count of 0) by sorted running sums, and pairs that share it are
    corrected from its postings. All parts are integers, and Spark adds them by pair.

    Null text, lang and source count as ''. Texts are read whole; repeated rows count each; ties go by
    the item's bytes; a group without terms has its rows; a language without kept terms has
    pairs of value 0; a language of one source has no pair; an empty table gives no rows; other
    columns, whatever their names, stay behind."""
    light = min(light, LIGHT)
    counted = materialize(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    same = Window.partitionBy("lang", "term")
    kept = counted.where("term is not null").select(
        "*", F.sum("docs").over(same).alias("in_docs"), F.sum("n").over(same).alias("total"), F.count("*").over(same).alias("spread"),
        (F.min("source").over(same) == F.col("source")).alias("first"),
    )
    kept = materialize(kept.where(F.col("in_docs") >= min_docs).drop("docs", "in_docs"))

    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("here"))
    groups = counted.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left")
    groups = groups.withColumn("here", F.coalesce("here", F.lit(0).cast("long")))
    groups = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    size = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    most = F.least(F.lit(light), F.floor(F.col("sources") / 4))
    by_lang = kept.groupBy("lang", "spread").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum("n").alias("n"))
    is_light = F.col("spread") <= most
    by_lang = size.join(by_lang, "lang", "left").groupBy("lang", "sources").agg(
        F.coalesce(F.sum("terms"), F.lit(0)).alias("kept"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"),
        F.coalesce(F.sum(F.when(~is_light, F.col("terms"))), F.lit(0)).alias("heavy"),
        F.coalesce(F.sum(F.when(is_light, F.col("terms") * F.col("spread"))), F.lit(0)).alias("light_rows"),
    ).withColumn("most", most)
    blocks = F.ceil(F.col("sources") / tile).cast("int")
    slices = F.greatest(F.lit(1), F.ceil(F.col("heavy") / TILE_TERMS)).cast("int")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("light_rows") / BUCKET_ROWS)).cast("int")
    groups = groups.join(by_lang, "lang").withColumns({"blocks": blocks, "slices": slices, "buckets": buckets})
    groups = groups.withColumn("base", share(F.lit(0), F.col("here"), F.col("kept")))
    groups = materialize(groups.withColumn("block", F.floor(F.col("at") / tile).cast("int")))
    n_groups = groups.count()

    rows = kept.join(small(groups, n_groups, 50_000), ["lang", "source"])
    rows = rows.withColumns({"p": share(F.col("n"), F.col("here"), F.col("kept")), "q": share(F.col("total"), F.col("all_n"), F.col("kept")), "light_term": F.col("spread") <= F.col("most"), "hash": F.xxhash64("term")})
    rows = materialize(rows.select("lang", "source", "term", "at", "block", "blocks", "slices", "buckets", "base", "p", "q", "light_term", "hash"))
    discard(counted, kept)

    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    no_term, unsaid = F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("kept")
    heavy = rows.where("not light_term").select("lang", "at", "block", "term", "p", F.pmod("hash", "slices").cast("int").alias("slice"), each("blocks").alias("other"), unsaid)
    bases = groups.select("lang", "at", "block", no_term, F.col("base").alias("p"), "kept", "blocks", each("slices").alias("slice"))
    bases = bases.select("lang", "at", "block", "term", "p", "slice", each("blocks").alias("other"), "kept")
    tiles = heavy.unionByName(bases).select("lang", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "slice", "at", "term", "p", "kept")
    dense = tiles.groupBy("lang", "lo", "hi", "slice").applyInArrow(lambda key, t: _tile(key, t, tile), _SUMS_SQL)

    thin = rows.where("light_term").withColumn("bucket", F.pmod("hash", "buckets").cast("int"))
    asked = groups.where("light_rows > 0").select("lang", "at", no_term, F.col("base").alias("p"), "buckets", each("blocks").alias("block"))
    asked = asked.select("lang", "at", "term", "p", "block", each("buckets").alias("bucket"))
    one_sided = thin.select("lang", "at", "term", "p", "block", "bucket").unionByName(asked).groupBy("lang", "block", "bucket").applyInArrow(_against_bases, _SUMS_SQL)
    both = thin.select("lang", "bucket", "at", "term", "p", "base").groupBy("lang", "bucket").applyInArrow(_postings, _SUMS_SQL)

    pairs = dense.unionByName(one_sided).unionByName(both).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "value", F.inline(F.array(F.struct("g", "h"), F.struct(F.col("h").alias("g"), F.col("g").alias("h")))))
    name = lambda at, as_: small(groups.select("lang", F.col("at").alias(at), F.col("source").alias(as_)), n_groups, 50_000)
    pairs = pairs.join(name("g", "source"), ["lang", "g"]).join(name("h", "item"), ["lang", "h"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    above = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(above.select("*", rank).where(F.col("rank") <= top))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = """
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM docs),
per_doc AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS total FROM per_doc GROUP BY ALL HAVING count(*) >= 30),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
counts AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k USING (lang)
  LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM per_doc GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS MATERIALIZED (
  SELECT lang, source, term, n,
         1 + (1000000000 * (n::HUGEINT + 5)) // (sum(n) OVER w + 5 * count(*) OVER w)::HUGEINT AS p,
         1 + (1000000000 * (total::HUGEINT + 5)) // (sum(total) OVER w + 5 * count(*) OVER w)::HUGEINT AS q
  FROM counts WINDOW w AS (PARTITION BY lang, source)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS f
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS f FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, f::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY f DESC, item))::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY f DESC, item) <= 50
"""
