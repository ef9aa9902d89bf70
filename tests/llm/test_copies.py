import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusframe.llm import components, exact_dedup, jaccard_join

from .conftest import ODD, prose


def test_exact_on_odd_rows(odd_docs, no_docs):
    rows = exact_dedup.exact_dedup(odd_docs).collect()
    texts = [(i, t or "") for i, t in enumerate(ODD)] + [(4, "a"), (None, "a")]
    groups = defaultdict(list)
    for i, t in texts:
        groups[t].append(i)
    assert len(rows) == len(texts)
    want = sorted(((i, max(x for x in groups[t] if x is not None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in rows)
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    left = exact_dedup.drop_copies(odd_docs)
    assert left.columns == odd_docs.columns and sorted(r["text"] or "" for r in left.collect()) == sorted(groups)


def test_jaccard_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = jaccard_join.op6_jaccard_join(spark, sf).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(jaccard_join.ORACLE).fetchall())


def test_exact_against_sql(spark, sf):
    got = exact_dedup.op7_exact_dedup(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(exact_dedup.ORACLE).fetchall())
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_exact_with_a_third_in_one_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.exact_dedup(df)
    assert out.where("kept").count() == 2001 and out.where("group_size = 1000 and keep_id = 2997").count() == 1000


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """Sizes and components by comparing all pairs."""
    sets = [(i, shingles(t or "")) for i, t in docs]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets}


def test_jaccard_on_odd_rows(odd_docs, no_docs):
    ids = odd_docs.where("doc_id is not null")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(ids).collect()}
    assert got == brute(list(enumerate(ODD)))
    assert jaccard_join.jaccard_components(odd_docs).count() == len(ODD) + 2
    assert jaccard_join.jaccard_components(no_docs).count() == 0
    left = jaccard_join.drop_near_copies(ids)
    assert left.columns == odd_docs.columns


def test_jaccard_with_ids_missing_or_shared(spark):
    t = " ".join(f"w{i}" for i in range(60))
    docs = [(None, t), (1, t), (None, t + " x"), (2, t + " y"), (2, "other words that are not like any of all these"), (3, None), (5, t)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(docs) and {r for r in rows if r[0] in (1, 3, 5)} == {(1, 56, 1), (3, 0, 3), (5, 56, 1)}
    assert all(r[2] is None for r in rows if r[0] is None)
    assert {r[1] for r in rows if r[0] == 2} == {57, 6}


def test_ids_with_several_texts_link_by_each(spark):
    """(1, A), (2, A), (2, B), (9, near B): 9 is found through 2; B is like no smaller id's text."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = [(1, a, "p"), (2, a, "q"), (2, b, "r"), (2, b, "s"), (9, b + " more", "t"), (3, "alone in all this", "u"), (2, None, "v"), (None, b, "w"), (7, "x y", "x"), (7, "z", "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, node string")
    got = sorted(map(tuple, jaccard_join.jaccard_components(df).collect()), key=repr)
    want = [(1, 56, 1), (2, 56, 1), (2, 56, 1), (2, 56, 1), (2, 0, 1), (9, 57, 1), (3, 1, 3), (None, 56, None), (7, 1, 7), (7, 1, 7)]
    assert got == sorted(want, key=repr)
    left = jaccard_join.drop_near_copies(df)
    assert left.columns == df.columns and sorted(r["node"] for r in left.collect()) == ["p", "r", "s", "u", "v", "w", "x", "y"]


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        at = r.randrange(len(words))
        kind = r.random()
        if kind < 0.5:
            words[at] = f"new{r.random()}"
        elif kind < 0.75 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"more{r.random()}")
    return words


@pytest.mark.parametrize("few", [jaccard_join.FEW, 2])
def test_jaccard_against_all_pairs(spark, monkeypatch, few):
    """Groups of near copies around the limit, a passage that many share, texts of every small
    length; with few = 2 nearly every slice takes the refined way."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    r = random.Random(11)
    texts = []
    for n in (6, 9, 14, 30, 60, 120, 150, 400):
        base = prose(r, n).split()
        texts += [" ".join(edited(r, base, r.randint(0, max(1, n // 25)))) for _ in range(25)]
    passage = prose(r, 60)
    texts += [f"{prose(r, r.randint(5, 40))} {passage} {prose(r, r.randint(5, 40))}" for _ in range(60)]
    texts += [" ".join(f"w{k}" for k in range(n)) for n in range(1, 40)]
    texts += [texts[3], texts[3].upper(), "", None]
    r.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_components(df).collect()}
    assert got == brute(docs)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 499), (499, 500)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(30)) and got[500] == got[499] == 499
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filter_ranges_keep_suspicion_low(spark):
    """2,000 rows with a repeated word for each word that may be broadcast."""
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 100 == 0, F.col("id") + 1).otherwise(F.col("id")).cast("string")).alias("text"))
    marked = exact_dedup.suspects_marked(rows, max_words=30)
    got = marked.agg(F.count("*"), F.count_if("suspect")).first()
    copies = 1200
    assert got[0] == 60_000 and copies <= got[1] < copies + 0.02 * 60_000
    made = exact_dedup.exact_dedup(rows, max_words=30)
    assert made.where("group_size = 2").count() == copies and made.where("not kept").count() == copies // 2
    assert made.where("not kept and keep_id <> doc_id + 1").count() == 0 and made.count() == 60_000
