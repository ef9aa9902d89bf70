"""Whitening, files of token ids and source divergence against plain versions."""

import io
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusframe.llm import divergence, token_bits, whitening


# --- whitening


def test_limbs_sum_up_and_products_are_exact():
    r = np.random.default_rng(3)
    for top in (10, 1 << 17, 1 << 40, 1 << 61):
        x = r.integers(-top, top, size=(500, 5))
        parts = whitening.limbs(x)
        assert all(np.abs(p).max() < 1 << whitening.BITS for p in parts)
        assert (sum(p.astype(object) << whitening.BITS * i for i, p in enumerate(parts)) == x.astype(object)).all()
        gram = whitening.Gram(5)
        gram.add(x[:200])
        gram.add(x[200:])
        big = x.astype(object)
        assert (gram.squares == big.T @ big).all() and (gram.sums == big.sum(axis=0)).all()
        assert whitening.square_sums(x) == [sum(int(c) ** 2 for c in row) for row in x]
        sums = [int(s) for s in big.sum(axis=0)]
        assert whitening.deviations(x, 500, sums) == [sum((500 * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]


@given(st.integers(-(2**170), 2**170))
def test_words_of_a_big_integer(v):
    a, b, c = whitening.words(v)
    assert a + (b << whitening.WORD) + (c << 2 * whitening.WORD) == v


def test_whitening_equals_a_plain_fit(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").repartition(7)
    got = whitening.whitened_components(table).toPandas()
    base = table.toPandas()
    x = np.floor(1024 * np.stack(base.embedding).astype(float)).astype(np.int64) + 100_000
    n, dims = x.shape
    s = x.sum(axis=0)
    exact = [[Fraction(int(n * (x[:, i] @ x[:, j]) - int(s[i]) * int(s[j])), n * n) for j in range(dims)] for i in range(dims)]
    v = np.array([[float(c) for c in r] for r in exact])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    want = ((x - s / n) @ u) / np.sqrt(e)
    assert len(got) == 8 * n and set(got.n) == {n} and set(got.component) == set(range(1, 9))
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[base.vec_id].to_numpy()
    sign = np.sign((wide * want).sum(axis=0))
    assert np.allclose(wide * sign, want, atol=1e-8)
    assert np.allclose(got.groupby("component").explained.first(), e / np.trace(v), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    far = dict(zip(base.vec_id, (((n * x - s).astype(object)) ** 2).sum(axis=1), strict=True))
    assert all(far[i] == d for i, d in zip(got.vec_id, got.deviation, strict=True))


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 9), (2, None, 9), (3, [nan, 1.0], 9), (4, [None, 1.0], 9), (5, [inf, 0.0], 9), (None, [0.5, -1.0], 9), (1, [1.0, 2.0], 9), (7, [3.0], 9), (8, [], 9), (9, [1e300, 0.0], 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened int")
    got = whitening.whitened_components(frame).collect()
    assert Counter(r.vec_id for r in got) == {1: 4, None: 2, 7: 2, 8: 2, 9: 2}
    assert {r.n for r in got} == {6} and {r.deviation for r in got if r.vec_id == 9} == {None}
    assert all(math.isfinite(r.whitened) for r in got)
    one = whitening.whitened_components(frame.where("vec_id = 1")).collect()
    assert {(r.whitened, r.explained, r.deviation) for r in one} == {(0.0, 0.0, 0)}
    assert whitening.whitened_components(frame.where("vec_id = 2")).collect() == []
    assert whitening.whitened_components(frame.limit(0)).collect() == []


# --- files of token ids


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(0, 2**w - 1), max_size=60))))
def test_bits_there_and_back(case):
    width, ids = case
    raw = token_bits.pack_bits(np.array(ids, dtype=np.uint32), width)
    assert len(raw) == -(-len(ids) * width // 8)
    assert int.from_bytes(raw, "little") == sum(v << k * width for k, v in enumerate(ids))
    assert token_bits.unpack_bits(raw, width, len(ids)).tolist() == ids


def test_file_gives_any_document_and_tells_damage():
    class Kept(io.BytesIO):
        def close(self):
            pass

    r = np.random.default_rng(5)
    docs = [(None if k == 3 else k - 5, r.integers(0, 50_000, size=int(n)).astype(np.uint32)) for k, n in enumerate([0, 1, 40, 7, 1000, 0, 16, 333, 0])]
    out = Kept()
    writer = token_bits.Writer(out, 16, block=16)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    reader = token_bits.Reader(out)
    for k, (_, ids) in enumerate(docs):
        assert (reader.document(k) == ids).all()
    every = np.concatenate([ids for _, ids in docs])
    assert (reader.ids(30, 500) == every[30:500]).all() and len(reader.ids(5, 5)) == 0
    for at_once in (1, 3, 64):
        told = list(reader.digests(at_once))
        assert [t[0] for t in told] == [d for d, _ in docs] and [t[2] for t in told] == [len(i) for _, i in docs]
        assert [t[1] for t in told] == np.cumsum([0, *(len(i) for _, i in docs)])[:-1].tolist()
        assert [t[3] for t in told] == [zlib.crc32(i.astype("<u4").tobytes()) for _, i in docs]
    raw = bytearray(out.getvalue())
    raw[len(token_bits.MAGIC) + 50] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_bits.Reader(io.BytesIO(bytes(raw))).ids(0, len(every))
    with pytest.raises(ValueError):
        token_bits.Writer(Kept(), 3).add(1, np.array([8]))
    with pytest.raises(ValueError):
        token_bits.Reader(io.BytesIO(b"x" * 100))


def test_written_ids_equal_the_library(spark, sf, odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert token_bits.width_of(token_bits.vocabulary(path)) == 16
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    got = {r.doc_id: r for r in token_bits.written_ids(docs, path, public_tokenizers.PATTERN).collect()}
    start = 0
    rows = sorted(docs.select("doc_id", "text").collect())
    assert len(got) == len(rows)
    for d, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    odd = token_bits.written_ids(odd_docs, path, public_tokenizers.PATTERN).collect()
    assert sorted((r.start, r.n_tokens) for r in odd)[0][0] == 0 and len(odd) == odd_docs.count()
    in_order = sorted(odd, key=lambda r: r.start)
    assert [r.start for r in in_order] == np.cumsum([0, *(r.n_tokens for r in in_order)])[:-1].tolist()
    ids = [r.doc_id for r in in_order]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert token_bits.written_ids(no_docs, path, public_tokenizers.PATTERN).collect() == []


def test_files_roll_over_and_lists_name_whole_files_only(spark, sf, tmp_path):
    import public_tokenizers
    from corpusframe.llm.packing import tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"file://{tmp_path}/ids"
    files = token_bits.write_ids(docs, lambda: tokenizer(path, public_tokenizers.PATTERN), 50257, folder, file_ids=5000, block=64)
    listed = files.collect()
    assert len(listed) > 8 and sum(r.n_docs for r in listed) == docs.count()
    (tmp_path / "ids" / "ids-000000-left-behind.bits").write_bytes(b"half")
    got = token_bits.read_ids(spark, files, folder)
    assert got.count() == docs.count() and got.agg({"n_tokens": "sum"}).first()[0] == sum(r.n_ids for r in listed)


# --- divergence


def plain_divergence(rows, min_docs=30, top=50):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(lower) for w in term.findall(text or "")]
        groups[lang].add(source)
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [w for w, n in docs[lang].items() if n >= min_docs]
        of = lambda c, n: {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}  # noqa: E731, B023
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        p = {s: of(count[lang, s], sum(count[lang, s][w] for w in kept)) for s in sources}
        q = of(whole, sum(whole[w] for w in kept))
        for s in sources:
            lists = {"pair": [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s], "term": [(p[s][w] - q[w], w) for w in kept if count[lang, s][w] and p[s][w] > q[w]]}
            for part, items in lists.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                for k, (v, i) in enumerate(items if part == "pair" else items[:top], 1):
                    out.add((lang, s, part, i, v, k))
    return out


def told(frame):
    return [tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect()]


@pytest.mark.parametrize("light", [0, 2, 32])
def test_divergence_equals_a_plain_version(spark, light):
    r = np.random.default_rng(light)
    words = ["The", "a", "É", "été", "x1y", "zß", "日本", "Ab-c"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = []
    for k in range(900):
        lang, source = ["en", "de", None][k % 3], f"s{int(r.integers(0, 40)) if k % 2 else 1}"
        at = np.minimum(r.zipf(1.3, size=int(r.integers(0, 30))) - 1 + int(source[1:]) * (k % 2), len(words) - 1)
        rows.append((" ".join(words[i] for i in at), lang, None if source == "s3" else source))
    rows += [(None, "fr", "s1"), ("", "fr", "s2"), ("rare words", "fr", None), ("alone", "it", "s1")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "'k' AS term", "1 AS n", "2 AS p", "3 AS value")
    got = told(divergence.divergence(frame, light=light, min_docs=8, tile=16))
    want = plain_divergence(rows, min_docs=8)
    assert len(got) == len(want) and set(got) == want


def test_divergence_of_the_table_and_of_nothing(spark, sf, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.read.parquet(f"{sf}/documents.parquet").limit(3))
    got = told(divergence.divergence(docs))
    assert set(got) == plain_divergence([(r.text, r.lang, r.source) for r in docs.collect()]) and len(got) == len(set(got))
    assert divergence.divergence(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).collect() == []
