import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusframe.llm import audio_fingerprint as audio
from corpusframe.llm import html_lstm
from corpusframe.llm.html_blocks import blocks

# ---- pages


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("<", ["<"]),
        ("a < b", ["a < b"]),
        ("<p>a<p>b &amp;amp; c&nbsp;d", ["a", "b &amp; c d"]),
        ("<p><b>x<br>y<p>z", ["x y", "z"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<div hidden>x</div><p>y", ["y"]),
        ("a<b>c</b>d<script>if (a<b) x</script>e<style>p{}</style>", ["acd", "e"]),
        ("x<!-- <p>no</p> -->y<!-- open", ["xy"]),
        ("<p title='a>b'>t</p></div></p>u", ["t", "u"]),
        ("<h1>A  B\n C</h1>&#x41;&eacute;", ["A B C", "Aé"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>where <math display='inline'><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math>, so</p>", ["where x = 1 2, so"]),
        ("<p>a<object data=x.swf><param name=q>no player</object>b</p>", ["ano playerb"]),
        ("<object><p>one</p><p>two</p></object><p>t", ["one", "two", "t"]),
        ("<p>a</p><noscript><p>see <a href=x>the list</a></p></noscript><p>t", ["a", "see the list", "t"]),
        ("<p>chart <svg viewBox='0 0 1 1'><title>tip</title><style>g{}</style><path d='M0'/><text>north</text><text>south</text></svg> end", ["chart north south end"]),
        ("<p>a<svg><path d='M0'/><p>b</p><p>c", ["a", "b", "c"]),
        ("<p>a <svg aria-hidden=true><text>no</text></svg>b<p>c<svg hidden><p>d", ["a b", "c", "d"]),
        ("<p>a<object><p>b<math><p>c", ["a", "b", "c"]),
        ("<p>a</p><select><option>1<p>b", ["a", "1", "b"]),
        ("<p>a</p><iframe src=x><p>b<template><p>c<title>d", ["a", "b", "c", "d"]),
        ("<p>a</p><select><option>1</select><iframe>x</iframe><template><p>y</template><p>b", ["a", "b"]),
        ("<p>a</p><script>var b = '<p>c'", ["a"]),
        ("<p>a</p><style>p{}", ["a"]),
        ("<p>a</p><svg/><math/><p>b", ["a", "b"]),
    ],
)
def test_only_scripts_styles_and_forms_are_raw(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("page", ["<select>" * 40_000, "<svg>" * 3_000 + "x", "<p " * 50_000, "<a href=\"x" * 5_000, "<!--" * 20_000, "<div>" * 3_000 + "x", "x" * 300_000])
def test_broken_pages_end(page):
    blocks(page)


def test_paths_and_links():
    b = blocks('<div class="mainMenu top-2" id=nav><ul><li><a href=x>one two</a> t</li></ul></div>')[0]
    assert b.path == ("t:div", "n:main", "n:menu", "n:top", "n:2", "n:nav", "t:ul", "t:li") and b.leaf == "li" and b.linked == 7


@pytest.mark.parametrize(
    "attrs",
    ['class="overflow-hidden"', 'style="overflow:hidden"', 'class="md:hidden"', 'id="hidden-costs"', 'data-title="The hidden cost"', 'aria-hidden="false"', "aria-hidden", 'hidden="until-found"', 'data-hidden="x"', 'class=hidden', 'data-style="display:none"', 'style="display:none;display:block"', "style='background:url(x;display:none)'", 'title="display: none"', 'alt="a > b" class="x hidden"'],
)
def test_shown_elements(attrs):
    assert texts(f"<article {attrs}><p>shown</p></article><p>t") == ["shown", "t"]


@pytest.mark.parametrize(
    "attrs",
    ["hidden", "HIDDEN=''", "class=x hidden", 'hidden="hidden"', 'aria-hidden="true"', "aria-hidden=TRUE", 'style="color:red; Display : none"', "style='display:none !important;display:block'", "style=display:none", "style='display&#58;none'", "class=\"a\"hidden", 'title="x=\'y" hidden'],
)
def test_hidden_elements(attrs):
    assert texts(f"<div {attrs}><p>not shown</p></div><p>t") == ["t"]


def test_main_text_of_a_page_whose_wrapper_says_hidden():
    body = "".join(f"<p>{'The river rose again in the night, and the road was closed. ' * 4}</p>" for _ in range(5))
    page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='{}'><article><h1>The flood</h1>" + body + "</article></div></body></html>"
    found = [blocks(page.format(c)) for c in ("page overflow-hidden", "page")]
    a, b = html_lstm.BlockLabeller.load().label(found)
    assert [x.text for x in found[0]] == [x.text for x in found[1]] and len(found[0]) == 7 and (a >= 0.5).sum() >= 5


def test_features_read_whole_blocks_and_names():
    made = lambda words, names: html_lstm.features(blocks(f"<div class='{names}'>{words}</div>"))
    plain = made("a " * 60, "u " * 20)
    assert (made("a " * 60 + "advertisement", "u " * 20) != plain)[0, html_lstm.PATH_DIM : html_lstm.PATH_DIM + html_lstm.WORD_DIM].sum() >= 2
    assert (made("a " * 60, "u " * 20 + "sidebar") != plain)[0, : html_lstm.PATH_DIM].sum() == 1
    assert blocks(f"<div class='{'u ' * 20}sidebar'>x</div>")[0].path[-1] == "n:sidebar"


def test_gradient():
    r = random.Random(9)
    data = [html_lstm.lesson(r) for _ in range(3)]
    xs, ys = [x for x, _, _ in data], [y for _, y, _ in data]
    m = html_lstm.BlockLabeller.fresh(1)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    _, g = m.gradients(xs, ys)
    for k, v in m.w.items():
        at = np.unravel_index(np.argmax(np.abs(g[k])), v.shape)
        was, e = v[at], 1e-3
        v[at] = was + e
        up = m.gradients(xs, ys)[0]
        v[at] = was - e
        down = m.gradients(xs, ys)[0]
        v[at] = was
        assert g[k][at] == pytest.approx((up - down) / (2 * e), rel=1e-2)


def test_pages_never_seen():
    r, m = random.Random(4242), html_lstm.BlockLabeller.load()
    hit = miss = false = 0
    for _ in range(150):
        _, y, found = html_lstm.lesson(r)
        p = m.label([found])[0] >= 0.5
        hit, miss, false = hit + (p & (y > 0)).sum(), miss + (~p & (y > 0)).sum(), false + (p & (y == 0)).sum()
    assert miss < 0.02 * hit and false < 0.02 * hit


#: Pages written by hand, with the text a reader would take for the article.
GOLD = [
    ("<article><p>The ferry leaves the harbour at six every morning and returns late in the evening.</p><p>Most of the passengers are students who live on the island.</p></article>",
     ["The ferry leaves the harbour at six every morning and returns late in the evening.", "Most of the passengers are students who live on the island."]),
    ("<article class='overflow-hidden'><h1>Winter on the island</h1><p>The ferry leaves the harbour at six every morning and returns late in the evening.</p><p>Most of the passengers are students who live on the island.</p><p>In January the sea freezes and the crossing takes twice as long.</p></article><div class='comments'><h3>2 comments</h3><div class='comment'><p>I took this ferry once, great view.</p></div><div class='comment'><p>Too cold for me!</p></div></div>",
     ["Winter on the island", "The ferry leaves the harbour at six every morning and returns late in the evening.", "Most of the passengers are students who live on the island.", "In January the sea freezes and the crossing takes twice as long."]),
    ("<html><body><div class='mx-auto'><nav class='navbar'><ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li></ul></nav><main class='hidden-xs p-4'><h1>Bread without yeast</h1><p>Mix the flour with water and let it stand for a day.</p><p>Bake it in a hot oven until the crust is dark.</p></main><footer>&copy; 2020 The Baker. All rights reserved.</footer></div></body></html>",
     ["Bread without yeast", "Mix the flour with water and let it stand for a day.", "Bake it in a hot oven until the crust is dark."]),
    ("<html><body><header class='site-header'><h1><a href='/'>My Blog</a></h1></header><div id='content'><article class='post hentry'><h2>The last steam line</h2><div class='entry-content'><p>It was raining when we reached the station.</p><p>The driver told us that the <b>line</b> would close in the spring.</p><ul><li>Three engines are left.</li><li>Two of them still run.</li></ul></div><div class='share'><a href='#'>Tweet</a></div></article><section id='comments'><h3>Leave a reply</h3><p>Anna: lovely story, thank you for writing it down!</p></section></div><aside id='sidebar'><h3>Recent posts</h3><ul><li><a href='/a'>A bridge in the north</a></li></ul></aside><footer>Powered by a press</footer></body></html>",
     ["The last steam line", "It was raining when we reached the station.", "The driver told us that the line would close in the spring.", "Three engines are left.", "Two of them still run."]),
    ("<body><div class='cookie-banner'><p>We use cookies to improve your experience. Accept all</p></div><div class='wrapper'><div class='main'><div class='story'><h1>Council votes on new bridge</h1><p>The city council voted on Tuesday to build a second bridge over the river.</p><div class='ad'><p>Advertisement: buy two lamps, get one free.</p></div><p>Work is to begin next year and will cost forty million.</p><blockquote><p>We have waited for this for twenty years, said the mayor.</p></blockquote></div></div><div class='related'><h3>Related articles</h3><p><a href='/1'>Old bridge closed</a></p></div></div></body>",
     ["Council votes on new bridge", "The city council voted on Tuesday to build a second bridge over the river.", "Work is to begin next year and will cost forty million.", "We have waited for this for twenty years, said the mayor."]),
    ("<article><h1>Heights</h1><p>These are the two highest hills of the county, measured last summer.</p><table><tr><td>Red Hill</td><td>412 m</td></tr></table><pre>north = 3</pre></article>",
     ["Heights", "These are the two highest hills of the county, measured last summer.", "Red Hill", "412 m", "north = 3"]),
    ("<article><p>A short note.</p></article>", ["A short note."]),
    ("<html><body><p>The ferry leaves the harbour at six every morning and returns late in the evening.</p><p>Most of the passengers are students who live on the island.</p></body></html>",
     ["The ferry leaves the harbour at six every morning and returns late in the evening.", "Most of the passengers are students who live on the island."]),
    ("<div><div>The river rose by two metres in the night, and the lower town was flooded by the morning.</div><div>Boats were brought from the coast to reach the people on the roofs.</div></div>",
     ["The river rose by two metres in the night, and the lower town was flooded by the morning.", "Boats were brought from the coast to reach the people on the roofs."]),
    ("<html><body><div class='overflow-hidden mx-auto'><nav class='navbar'><ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li><li><a href='/about'>About</a></li></ul></nav><main class='hidden-xs p-4'><h1>Bread without yeast</h1><p>Mix the flour with water and let it stand for a day.</p><p>Bake it in a hot oven until the crust is dark.</p></main><footer>&copy; 2020 The Baker. All rights reserved.</footer></div></body></html>",
     ["Bread without yeast", "Mix the flour with water and let it stand for a day.", "Bake it in a hot oven until the crust is dark."]),
    ("<body><form><label>Name</label><input><button>Send</button></form></body>", []),
]


@pytest.mark.parametrize(("page", "want"), GOLD)
def test_pages_written_by_hand(page, want):
    found = blocks(page)
    p = html_lstm.BlockLabeller.load().label([found])[0]
    assert [b.text for b, x in zip(found, p, strict=True) if x >= html_lstm.THRESHOLD] == want


def test_training_learns():
    m = html_lstm.train(rounds=120, batch=12)
    r = random.Random(1)
    good = total = 0
    for _ in range(40):
        _, y, found = html_lstm.lesson(r)
        good += ((m.label([found])[0] >= 0.5) == (y > 0)).sum()
        total += len(y)
    assert good > 0.85 * total


def test_page_query(spark, sf):
    rows = html_lstm.op9_html_extract(spark, sf).collect()
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    right = 0
    for r in rows:
        page = html[r["page_id"]]
        body = page[page.index("<article>") + 9 : page.index("</article>")]
        right += r["text"] == "\n\n".join(texts(body))
        assert r["n_chars"] == len(r["text"])
    assert len(rows) == len(html) and right >= 0.98 * len(rows)


def test_page_edges(spark):
    df = spark.createDataFrame([(1, None, "u", 1), (2, "", None, 2), (2, "", None, 2), (None, "<article><p>Some words of a text.</p></article>", "u", 3)], "page_id long, html string, url string, text int")
    rows = html_lstm.extract(df, ("url",)).collect()
    assert len(rows) == 4 and [r["text"] for r in rows if r["page_id"]] == ["", "", ""]
    assert html_lstm.extract(df.limit(0)).count() == 0
    both = html_lstm.extract(df.select("page_id", "html", "text", "url"), ("text", "html", "page_id"))
    assert both.columns == ["page_id", "text_", "html", "page_id_", "text"] and both.count() == 4


# ---- recordings


def bits(a, b):
    n = min(len(a), len(b))
    return np.unpackbits((a[:n] ^ b[:n]).view(np.uint8)).mean()


def test_codes_withstand_noise_and_crops():
    r, s = np.random.default_rng(3), audio.Settings()
    x = audio.tones(r.integers(0, 36, 40), s, 0.5)
    c = audio.codes(x, s)
    assert (audio.codes(x, s) == c).all() and bits(c, audio.codes(0.2 * x, s)) < 0.01
    assert bits(c, audio.codes(x + 0.05 * r.normal(size=len(x)), s)) < 0.1
    assert bits(c[10:], audio.codes(x[10 * s.hop :], s)) < 0.01
    assert 0.4 < bits(c, audio.codes(audio.tones(r.integers(0, 36, 40), s, 0.5), s)) < 0.6
    assert len(audio.codes(x[:100], s)) == 0 and len(audio.codes(np.zeros(60_000), s)) > 0


def test_integral_image_equals_sums():
    r = np.random.default_rng(5)
    c = r.random((24, 12))
    got = audio.responses(c, 16)
    wide = np.concatenate([c, c], axis=1)
    for k, (kind, p, h, w) in enumerate(audio.filters(16)):
        if kind == 1:
            for t in range(9):
                a, b = wide[t : t + w, p + h // 2 : p + h].sum(), wide[t : t + w, p : p + h // 2].sum()
                assert got[t, k] == pytest.approx(np.log((a + 0.5) / (b + 0.5)))


def brute_best(codes, q, bit_error, overlap):
    """The best recording other than q over all offsets."""
    best = None
    for other, c in codes.items():
        if other == q or (len(c) == len(codes[q]) and (c == codes[q]).all()):
            continue
        for off in range(overlap - len(codes[q]), len(c) - overlap + 1):
            a = codes[q][max(0, -off) :]
            b = c[max(0, off) :]
            n = min(len(a), len(b))
            if n >= overlap and (e := bits(a[:n], b[:n])) <= bit_error and (best is None or (e, other) < best):
                best = e, other
    return best


def test_search_recall(spark):
    r, s = np.random.default_rng(8), audio.SHORT
    songs = [audio.tones(r.integers(0, 36, 60), s, 0.15) for _ in range(12)]
    made = {}
    for i, x in enumerate(songs):
        made[10 * i] = x
        made[10 * i + 1] = x[int(r.integers(2, 8)) * s.hop :] + 0.02 * r.normal(size=1)
        made[10 * i + 2] = x + 0.03 * r.normal(size=len(x))
    made[500], made[501] = songs[0], songs[0]
    pcm = [(i, bytearray((np.clip(x / 2, -1, 1) * 32767).astype("<i2").tobytes())) for i, x in made.items()]
    df = spark.createDataFrame([*pcm, (900, None), (901, bytearray(b"x")), (None, None)], "id long, pcm binary")
    prints = audio.fingerprints(df, "id", "pcm", settings=s)
    codes = {x["rec_id"]: np.array(x["codes"], dtype=np.int32) for x in prints.collect() if x["codes"]}
    rows = {x["rec_id"]: x for x in audio.align(prints, F.coalesce(F.col("rec_id") % 10 == 0, F.lit(False))).collect()}
    assert len(rows) == len(made) + 3 and rows[500]["class_id"] == rows[501]["class_id"] == 0 and rows[900]["n_codes"] == 0
    assert rows[1]["n_matches"] == 0 and rows[1]["match_id"] is None
    found = wanted = 0
    for q in range(0, 120, 10):
        want = brute_best(codes, q, audio.BIT_ERROR, audio.OVERLAP)
        wanted += want is not None
        found += want is not None and rows[q]["match_id"] is not None and rows[q]["error"] == pytest.approx(want[0], abs=0.03)
        assert rows[q]["match_id"] is None or rows[q]["match_id"] // 10 == q // 10
    assert wanted == 12 and found >= 0.9 * wanted


def test_recall_of_the_query(spark):
    """Every lookup of the query's own table against all recordings at all offsets."""
    folder = "/root/testdata/sf0.01"
    got = {r["rec_id"]: r for r in audio.op2_audio_fingerprint(spark, folder).collect()}
    rows = sorted((r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect())
    index = np.stack([audio.codes(audio.sonify(v), audio.SHORT).view(np.uint32) for _, v in rows])
    pairs = found = own = 0
    for q, v in rows:
        if q % 50:
            continue
        c = audio.codes(audio.excerpt(v), audio.SHORT).view(np.uint32)
        near = np.ones(len(rows))
        for off in range(audio.OVERLAP - len(c), index.shape[1] - audio.OVERLAP + 1):
            a, b = c[max(0, -off) :], index[:, max(0, off) :]
            n = min(len(a), b.shape[1])
            near = np.minimum(near, np.bitwise_count(a[:n] ^ b[:, :n]).sum(1) / (32 * n))
        pairs += int((near <= audio.BIT_ERROR).sum())
        found += got[q]["n_matches"]
        own += got[q]["match_id"] == got[q]["class_id"] and got[q]["offset"] > 0
    lookups = sum(q % 50 == 0 for q, _ in rows)
    assert lookups >= 10 and pairs >= lookups and 0.9 * pairs <= found <= pairs and own >= 0.9 * lookups


def test_audio_query(spark, sf):
    out = audio.op2_audio_fingerprint(spark, sf)
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert out.count() == n and out.where("is_query").count() == n // 50
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert audio.align(audio.fingerprints(empty, "vec_id", "embedding", audio.sonify, audio.SHORT), F.lit(True)).count() == 0
