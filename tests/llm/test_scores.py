import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from corpusframe.llm import compression_quality, license_scan, toxic_crf
from corpusframe.llm.labelled import Logistic, sample

from .conftest import ODD, prose

# ---- licences


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_phrases(text):
    w = plain_words(text)
    return sorted((i, label) for p, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def licence_texts():
    r = random.Random(2)
    said = ["Released under the MIT License.", "Apache-License, version 2", "CC BY-NC", "under the mit", "cc by", "UNDER THE MİT LICENSE", "under the mit license under the mit license"]
    return [f"{prose(r, r.randint(0, 30))} {r.choice(said)} {prose(r, r.randint(0, 9))} {r.choice(said)}" for _ in range(80)] + ODD


def test_phrases_against_search(spark):
    texts = licence_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in license_scan.license_scan(df).collect():
        found = plain_phrases(texts[row["doc_id"]])
        at = [i for i, _ in found]
        assert row["n_words"] == len(plain_words(texts[row["doc_id"]])) and row["n_base"] == len(found)
        assert (row["first_word"], row["last_word"]) == (min(at, default=None), max(at, default=None))
        assert row["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(row["base_labels"].split(",")) - {""} <= set(row["labels"].split(","))
        assert (row["score"] == 1.0) if found else 0 <= row["score"] <= 1


def test_templates_survive_changes():
    index = license_scan.RareTokenIndex()
    for label, text, _ in license_scan.TEMPLATES:
        words = license_scan.words_of("some code " + text.upper() + " the end")
        assert (2, label, 1.0, False) in index.scan(words)
    mit = license_scan.TEMPLATES[0][1].replace("merge", "blend").replace("publish", "print")
    assert any(m[1] == "mit" and 0.9 < m[2] < 1 for m in index.scan(license_scan.words_of(mit)))
    cut = license_scan.words_of(" ".join(license_scan.TEMPLATES[0][1].split()[4:]))
    assert not any(m[1] == "mit" for m in index.scan(cut))
    assert {m[1] for m in index.scan(license_scan.words_of("Creative Commons Attribution-NonCommercial 4.0: this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"))} == {"cc-by-nc"}


def test_words_put_in_or_left_out():
    index, said = license_scan.RareTokenIndex(), {label: text for label, text, _ in reversed(license_scan.TEMPLATES)}
    labels = lambda text: {m[1] for m in index.scan(license_scan.words_of(text))}
    bsd = said["bsd"].replace("are met redistributions", "are met:\n1. Redistributions").replace("disclaimer", "disclaimer. 2.")
    assert labels(f"Copyright 2001, all rights reserved. {bsd}") == {"bsd"}
    assert labels(said["isc"].replace(" and or ", " and/ ")) == {"isc"}
    assert labels("x = 1 # " + " # ".join(said["mit"].split())) == {"mit"}
    assert labels(" ".join(w + (" really" if i % 9 == 4 and i > 6 else "") for i, w in enumerate(said["unlicense"].split()))) == {"unlicense"}


def test_versions_and_families_are_told_apart():
    index = license_scan.RareTokenIndex()
    labels = lambda text: {m[1] for m in index.scan(license_scan.words_of(text))}
    program = "This program is free software; you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    assert labels(program.format("GNU General Public License", 2)) == {"gpl", "gpl-2"}
    assert labels(program.format("GNU General Public License", 3)) == {"gpl", "gpl-3"}
    assert labels(program.format("GNU Affero General Public License", 3)) == {"agpl-3"}
    assert labels("Released under the GNU General Public License version 2 only.") == {"gpl", "gpl-2"}
    assert labels("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\nCopyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.") == {"gpl-2"}
    assert labels(" ".join(text for label, text, _ in license_scan.TEMPLATES if label == "boost")) == {"boost"}
    assert labels("we read about the boost of the zlib authors, who permitted everyone to copy eclipse pictures under the terms of no license") == set()


def test_labels_and_score_against_trying_every_place(spark):
    r, index = random.Random(4), license_scan.RareTokenIndex()
    texts = []
    for _ in range(120):
        words = r.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(r.randint(0, 12)):
            k = r.randrange(len(words))
            words[k : k + 1] = r.choice([[], [words[k], "extra"], ["other"], [words[k]]])
        texts.append(f"{prose(r, r.randint(0, 20))} {' '.join(words)} {prose(r, r.randint(0, 20))} {r.choice(['', 'under the MIT license', 'the bsd license 3'])}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in license_scan.license_scan(df, index).collect():
        ws = license_scan.words_of(texts[row["doc_id"]])
        found = [(index.entries[t][0], v[1]) for t in range(len(index.entries)) for s in range(-5, len(ws)) if (v := index.verified(t, ws, s)) and v[1] >= index.entries[t][1] and not index.entries[t][2]]
        found += [(label, 1.0) for _, label in plain_phrases(texts[row["doc_id"]])]
        assert row["labels"] == ",".join(sorted({x for x, _ in found}))
        assert row["score"] <= max((v for _, v in found), default=0) <= row["score"] + 0.1


def test_licence_edges(odd_docs, no_docs):
    assert license_scan.license_scan(odd_docs).count() == len(ODD) + 2
    assert license_scan.license_scan(no_docs).count() == 0


# ---- scores


def labelled(spark, n=400):
    """Good prose and bad lists, some of both with toxic words."""
    r = random.Random(6)
    rows, marks = [], []
    for i in range(n):
        good, toxic = i % 3 > 0, i % 5 == 0
        words = prose(r, r.randint(20, 120)).split()
        if not good:
            words = [w + r.choice(["###", "%%%", " |"]) for w in words]
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["vexo", "grumbit", "snarlish", "snarlon"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label, held):
    rows = scored.join(labels, "doc_id").where(held).select("predicted", label).collect()
    assert len(rows) > 40
    return np.mean([r["predicted"] == r[label] for r in rows])


def test_quality_on_held_out(spark):
    docs, labels = labelled(spark)
    out = compression_quality.quality_scores(docs, labels, ~compression_quality.held_out())
    assert accuracy(out, labels, "quality", compression_quality.held_out()) > 0.93
    kept = compression_quality.keep_quality(docs, labels, ~compression_quality.held_out())
    assert kept.count() == out.where("predicted = 1").count() and kept.columns == docs.columns


def test_toxicity_on_held_out(spark):
    docs, labels = labelled(spark)
    out = toxic_crf.toxicity(docs, labels, ~toxic_crf.held_out())
    assert accuracy(out, labels, "toxic", toxic_crf.held_out()) > 0.95
    hot = out.join(docs, "doc_id").where("n_spans > 0").collect()
    words = {w for r in hot for s in r["spans"] for w in re.findall(r"\w+", r["text"][s["start"] : s["end"]].lower())}
    assert {"vexo", "grumbit"} <= words and len(words) < 12
    kept = toxic_crf.drop_toxic(docs, labels, ~toxic_crf.held_out())
    assert kept.count() == out.where("predicted = 0").count()


def test_long_documents_fit_the_field(spark):
    """What marks a document may stand behind 64,000 characters of it; the fit reads it there."""
    r = random.Random(8)
    texts, y = [], []
    for i in range(60):
        words = prose(r, 14_000 if i == 1 else 60).split()
        texts.append(" ".join([*words, "vexo", "grumbit"] if i % 2 else words))
        y.append(i % 2)
    assert len(texts[1]) > 64_000
    field = toxic_crf.ToxicField.fit(texts, y)
    assert field.calibration is not None
    assert max(field.tag([["vexo"]])[0]) > max(field.tag([["thing"]])[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxic_crf.toxicity(docs, labels, F.lit(True)).collect()}
    assert got[1]["n_spans"] >= 1 and texts[1][got[1]["spans"][0]["start"] :].startswith("vexo")
    assert toxic_crf.drop_toxic(docs, labels, F.lit(True)).count() < 40


def test_quality_is_the_difference_alone():
    """Scores rise with the normalised difference and depend on nothing else; parts of the end of
    a long text are in a dictionary as well."""
    r = random.Random(9)
    good = [prose(r, 80) for _ in range(60)]
    bad = [" ".join(w + "###" for w in prose(r, 80).split()) for _ in range(60)]
    scorer = compression_quality.CompressionScorer.fit(good + bad, [1] * 60 + [0] * 60)
    texts = [*good[:9], *bad[:9], "", "thing"]
    d, s = np.array([scorer.difference(t) for t in texts]), scorer.scores(texts)
    assert (np.diff(s[np.argsort(d)]) >= 0).all() and s[:9].min() > 0.8 and s[9:18].max() < 0.2
    assert scorer.difference("") == 0.0
    assert b"tail" in compression_quality.dictionary(["x" * 100_000 + "tail" * 20_000], 4096)


@pytest.mark.parametrize("score", [lambda d, y: compression_quality.quality_scores(d, y, F.lit(True)), lambda d, y: toxic_crf.toxicity(d, y, F.lit(True))])
def test_score_edges(spark, odd_docs, no_docs, score):
    docs, labels = labelled(spark, 120)
    odd_labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (5, 1, 0), (5, 1, 0), (99999, 1, 1)], labels.schema))
    rows = score(odd_docs, odd_labels).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert score(no_docs, labels).count() == 0
    assert score(docs, labels.limit(0)).count() == 120
    all_ = score(docs.unionByName(spark.createDataFrame([(None, None)], docs.schema)), odd_labels)
    assert all_.count() == 121
    assert [r["score"] for r in all_.orderBy("doc_id").collect()] == [r["score"] for r in all_.orderBy("doc_id").collect()]


def test_places_are_those_of_forms():
    for word in ["", "a", "ab", "abc", "achlichkeiten", "ñandúes", "漢字仮名交", "🙂🙂🙂🙂", "x\ud800yz"]:
        assert toxic_crf.places(word) == [zlib.crc32(f.encode("utf-8", "replace")) % toxic_crf.DIM for f in toxic_crf.forms(word)]


def test_marginals_against_all_labellings():
    r = np.random.default_rng(7)
    trans = np.array([[0.0, -0.7], [0.4, 1.1]])
    emit = [r.normal(size=n) for n in (1, 3, 6, 0, 4)]
    got, pairs = toxic_crf.marginals(emit, trans, True)
    want_pairs = np.zeros((2, 2))
    for e, p in zip(emit, got, strict=True):
        if not len(e):
            assert len(p) == 0
            continue
        total, mass, own = 0.0, np.zeros(len(e)), np.zeros((2, 2))
        for code in range(1 << len(e)):
            y = np.array([code >> k & 1 for k in range(len(e))])
            w = np.exp((e * y).sum() + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            mass += w * y
            for a, b in zip(y, y[1:], strict=False):
                own[a, b] += w
        assert p == pytest.approx(mass / total)
        want_pairs += own / total
    assert pairs == pytest.approx(want_pairs)


def test_logistic_and_prior():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 2))
    y = r.random(2000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))
    m = Logistic(x, y, 1e-6)
    assert np.abs(m(x).mean() - y.mean()) < 0.01 and m.w[0] > 1.5 > 0.3 > abs(m.w[1])
    assert m.shift(0.5, 0.9)(x).mean() > y.mean()


# ---- the queries against plain scoring


def plain_probability(curve, x):
    z = (np.asarray(x, float) - curve.mean) / curve.std
    return 1 / (1 + math.exp(-(float(z @ curve.w[:-1]) + curve.w[-1])))


def test_quality_query_against_plain_scoring(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scorer = compression_quality.CompressionScorer.fit(*sample(docs, labels, "quality", ~compression_quality.held_out()))

    def size(raw, held):
        total = 0
        for i in range(0, len(raw), 512):
            d = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            total += len(zstandard.ZstdCompressor(level=7, dict_data=d, write_content_size=False, write_dict_id=False).compress(raw[i : i + 512]))
        return total

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = compression_quality.op3_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows[:60]:
        raw = texts[r["doc_id"]]
        p = plain_probability(scorer.calibration, [(size(raw, scorer.bad) - size(raw, scorer.good)) / (len(raw) + 64)])
        assert r["score"] == pytest.approx(p, abs=1e-9) and r["predicted"] == int(p >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def plain_marginals(emit, trans):
    """In logarithms, one number at a time."""
    add = lambda *xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    n = len(emit)
    e = [(0.0, v) for v in emit]
    a, b = [e[0]], [(0.0, 0.0)] * n
    for t in range(1, n):
        a.append(tuple(e[t][j] + add(*(a[t - 1][i] + trans[i][j] for i in (0, 1))) for j in (0, 1)))
    for t in range(n - 2, -1, -1):
        b[t] = tuple(add(*(trans[i][j] + e[t + 1][j] + b[t + 1][j] for j in (0, 1))) for i in (0, 1))
    total = add(*a[-1])
    return [math.exp(a[t][1] + b[t][1] - total) for t in range(n)]


def test_toxicity_query_against_plain_scoring(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = toxic_crf.ToxicField.fit(*sample(docs, labels, "toxic", ~toxic_crf.held_out()))
    weight = dict(zip(field.keep.tolist(), field.value.tolist(), strict=True))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = toxic_crf.op8_toxicity(spark, sf).collect()
    assert len(rows) == len(texts)
    checked = 0
    for r in rows:
        text = texts[r["doc_id"]]
        words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\w+", text)]
        if not 0 < len(words) < 300 or checked >= 60 and not r["predicted"]:
            continue
        checked += 1
        p = plain_marginals([field.bias + sum(weight.get(k, 0.0) for k in toxic_crf.places(w)) for w, _, _ in words], field.trans)
        spans = []
        for q, (_, a, b), last in zip(p, words, [0.0, *p], strict=False):
            if q >= 0.5:
                if spans and last >= 0.5:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
        assert [[s["start"], s["end"]] for s in r["spans"]] == spans and r["n_spans"] == len(spans)
        heard = [q for q in p if q > 0.2]
        top = sorted(p)[-3:]
        x = [top[-1], math.log1p(sum(heard)), sum(top) / 3, min(1.0, 20 * sum(heard) / len(p))]
        want = plain_probability(field.calibration, x) if field.calibration else 0.0
        assert r["score"] == pytest.approx(want, abs=1e-6) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert checked >= 60
