"""Main text of pages: a bidirectional LSTM in numpy labels every leaf block.

Training pages are made here from layouts and made-up words; running this module fits the
numbers that lie beside it."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, table
from .html_blocks import Block, blocks

PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 384, 128, 8, 24
DIM = PATH_DIM + WORD_DIM + NUMBERS
WEIGHTS = Path(__file__).with_name("html_lstm.npz")
#: Blocks of at least this probability are main text; on made pages from 0.3 to 0.5 as many are missed as
#: wrongly taken.
THRESHOLD = 0.35


def slot(s: str, dim: int) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % dim


WORD_SLOTS: dict[str, int] = {}


def word_slots(words: list[str]) -> list[int]:
    """Slots of words; a bounded number is remembered."""
    got = list(map(WORD_SLOTS.get, words))
    if None in got:
        if len(WORD_SLOTS) > 200_000:
            WORD_SLOTS.clear()
        got = [WORD_SLOTS.setdefault(w, slot(w, WORD_DIM)) for w in words]
    return got


def features(page: list[Block]) -> np.ndarray:
    """One row a block: hashed tag path (each element and name word, the leaf apart), hashed
    words of the whole text, and numbers: length, link share, marks, place, depth."""
    x = np.zeros((len(page), DIM), dtype=np.float32)
    known: dict[tuple, list[int]] = {}
    for i, b in enumerate(page):
        key = (b.path, b.leaf)
        if (at := known.get(key)) is None:
            at = known[key] = sorted({slot(p, PATH_DIM) for p in b.path} | {slot(f"leaf:{b.leaf}", PATH_DIM)})
        x[i, at] = 1
        words = b.text.lower().split()
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(word_slots(words), minlength=WORD_DIM) / (np.sqrt(len(words)) * 2)
        n = len(b.text)
        marks = sum(b.text.count(c) for c in ".,;:!?")
        x[i, -NUMBERS:] = (np.log1p(n) / 6, min(1, b.linked / n), min(1.0, 20 * marks / n), i / len(page), 1 - i / len(page), b.depth / 10, min(n, 500) / 500, 1)
    return x


class BlockLabeller:
    """h = BiLSTM(x W + b); P(content) = sigmoid(u h + c). Pages of like length run side by side."""

    NAMES = ("wf", "rf", "bf", "wb", "rb", "bb", "u", "c")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(weights[k], dtype=np.float32) for k in self.NAMES}

    @classmethod
    def fresh(cls, seed: int = 0) -> BlockLabeller:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"w{d}"] = r.normal(0, 0.1, (DIM, 4 * HIDDEN))
            w[f"r{d}"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            b = np.zeros(4 * HIDDEN)
            b[HIDDEN : 2 * HIDDEN] = 1
            w[f"b{d}"] = b
        w["u"], w["c"] = r.normal(0, 0.2, (2 * HIDDEN,)), np.zeros(1)
        return cls(w)

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> BlockLabeller:
        with np.load(path) as z:
            return cls({k: z[k] for k in cls.NAMES})

    def _run(self, z: np.ndarray, live: np.ndarray, r: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states over steps of z (steps, pages, 4 gates); dead steps pass the state on."""
        steps, pages, _ = z.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out = np.empty((steps, pages, HIDDEN), np.float32)
        sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
        for t in range(steps):
            g = z[t] + h @ r
            i, f, o = sig(g[:, :HIDDEN]), sig(g[:, HIDDEN : 2 * HIDDEN]), sig(g[:, 2 * HIDDEN : 3 * HIDDEN])
            a = np.tanh(g[:, 3 * HIDDEN :])
            c2 = f * c + i * a
            tc = np.tanh(c2)
            m = live[t][:, None]
            if keep is not None:
                keep.append((h, c, i, f, o, a, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c2, c)
            out[t] = h
        return out

    def logits(self, xs: list[np.ndarray], keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in xs])
        steps = int(n.max())
        live = np.arange(steps)[:, None] < n
        z = {}
        cat = np.concatenate(xs)
        page = np.repeat(np.arange(len(xs)), n)
        step = np.concatenate([np.arange(k) for k in n])
        for d in "fb":
            v = np.zeros((steps, len(xs), 4 * HIDDEN), np.float32)
            v[step, page] = cat @ self.w[f"w{d}"] + self.w[f"b{d}"]
            z[d] = v
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = self._run(z["f"], live, self.w["rf"], kf)
        hb = self._run(z["b"][::-1], live[::-1], self.w["rb"], kb)[::-1]
        h = np.concatenate([hf, hb], axis=2)
        if keep is not None:
            keep |= {"cat": cat, "page": page, "step": step, "kf": kf, "kb": kb, "h": h, "live": live}
        return h @ self.w["u"] + self.w["c"], live

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            take = max(1, min(64, 60_000 // len(pages[order[-1]])))
            part, order = order[-take:], order[:-take]
            y, _ = self.logits([features(pages[i]) for i in part])
            for k, i in enumerate(part):
                out[i] = 1 / (1 + np.exp(-y[: len(pages[i]), k]))
        return out

    def _back(self, dh: np.ndarray, kept: list, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps, pages, _ = dh.shape
        dz, dr = np.zeros((steps, pages, 4 * HIDDEN), np.float32), np.zeros_like(r)
        gh, gc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, a, tc, m = kept[t]
            g = gh + dh[t]
            k = gc * m + g * m * o * (1 - tc * tc)
            d = np.concatenate([k * a * i * (1 - i), k * c * f * (1 - f), g * m * tc * o * (1 - o), k * i * (1 - a * a)], axis=1)
            dz[t] = d
            dr += h.T @ d
            gh = d @ r.T + g * ~m
            gc = k * f + gc * ~m
        return dz, dr

    def gradients(self, xs: list[np.ndarray], ys: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the blocks and its gradient, by backpropagation through time."""
        kept: dict = {}
        logit, live = self.logits(xs, kept)
        y = np.zeros_like(logit)
        for k, v in enumerate(ys):
            y[: len(v), k] = v
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        n = live.sum()
        loss = -float((np.log(np.where(y > 0, p, 1 - p) + 1e-9) * live).sum() / n)
        d = ((p - y) * live / n).astype(np.float32)
        dh = d[:, :, None] * self.w["u"]
        g = {"u": np.einsum("sp,sph->h", d, kept["h"]), "c": np.array([d.sum()])}
        for way, part, k in (("f", dh[:, :, :HIDDEN], kept["kf"]), ("b", dh[::-1, :, HIDDEN:], kept["kb"])):
            dz, g[f"r{way}"] = self._back(part, k, self.w[f"r{way}"])
            dz = dz if way == "f" else dz[::-1]
            flat = dz[kept["step"], kept["page"]]
            g[f"w{way}"], g[f"b{way}"] = kept["cat"].T @ flat, flat.sum(0)
        return loss, g


#: Layout parts of made training pages: elements and names that pages commonly give them.
AROUND = {
    "nav": (["nav", "div.nav", "ul.menu", "div#menu", "div.navbar", "div.breadcrumbs", "div.navigation", "ol.breadcrumb", "div.main-menu", "nav.site-nav"], "links"),
    "header": (["header", "div.header", "div#header", "div.site-header", "div.masthead", "div.top-bar", "header.page-header"], "short"),
    "footer": (["footer", "div.footer", "div#footer", "div.site-footer", "div.copyright", "footer.page-footer"], "short"),
    "side": (["aside", "div.sidebar", "div#sidebar", "div.widget", "div.related", "section.related-posts", "div.recommended", "aside.side", "div.trending", "section.more"], "mixed"),
    "ad": (["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "div.banner", "aside.ad", "section.sponsor", "p.ad"], "text"),
    "notice": (["div.cookie", "div.cookie-banner", "div.notice", "div#consent", "div.alert", "div.gdpr", "div.newsletter", "div.popup", "div.paywall", "div.subscribe"], "text"),
    "form": (["form", "form.search", "div.search", "form.login", "form.signup", "fieldset"], "form"),
    "comments": (["div.comments", "section.comments", "div#comments", "div#disqus_thread", "ol.comment-list", "section#responses", "div.discussion", "div.reader-comments"], "comments"),
    "share": (["div.share", "div.social", "ul.share-buttons", "div.tags", "div.author-bio", "div.byline", "div.meta"], "links"),
}
CONTENT = ["article", "div.article", "div.content", "main", "div#content", "section.post", "div.entry-content", "div.post-body", "main article", "div.main div.story", "article div.body", "div", "div#main", "div.text", "section"]
ASKING = ["to improve your experience.", "on this site. Accept", "by using this site you agree.", "every week in your inbox.", "to continue reading.", "and our partners."]
SAYINGS = "we use cookies|this site uses cookies|your privacy matters|news about contact|sign in|home news sports|subscribe to our newsletter|all rights reserved|advertisement|sponsored content|share this|read more|log in|sign up|privacy policy|terms of use|accept all|related articles|leave a reply|posted by|contact us|follow us|menu|home|search|about|copyright".split("|")
#: Words of plain English prose, and names that say nothing about what they wrap.
PLAIN = "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if will each about how up out them then many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know river house garden night morning letter city train bread music history weather children street mountain question answer winter bridge market".split()
UTILITY = ["overflow-hidden", "mx-auto", "col-md-8", "hentry", "is-visible", "container-fluid", "md:flex", "p-4", "has-sidebar", "js-loaded", "lang-en", "hidden-xs", "clearfix"]


def made_page(r: random.Random) -> tuple[str, list[str]]:
    """A page and the blocks of its main text, in order."""
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "es", "ti", "en", "ie", "que", "de", "la", "sch", "au", "ch", "ment", "ció", "ó", "é", "ü", "tion", "ing", "st"]
    vocab = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(120)]
    # some pages are poor writing: marks between or behind words, capitals, one word again and again
    odd = r.choice([""] * 6 + ["|", "mark", "caps", "same"])
    marks = [r.choice("*#$%&@~+=") * r.randint(1, 4) for _ in range(4)]
    if r.random() < 0.45:
        vocab = PLAIN if r.random() < 0.7 else PLAIN + vocab
    bare = r.random() < 0.4  # little or nothing stands round the main text
    para = "div" if r.random() < (0.3 if bare else 0.12) else "p"
    nameless = r.random() < 0.2  # names are made by a machine, or there are none

    def text(lo: int, hi: int) -> str:
        words = [r.choice(vocab) + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(lo, hi))]
        if odd == "mark":
            words = [w + r.choice(marks) for w in words]
        elif odd == "same":
            words = [w for w in words[: 1 + len(words) // 8] for _ in range(8)]
        s = ((" | " if odd == "|" else " ").join(words) + r.choice([".", ".", "", "!"])).replace("&", "+")
        return s.upper() if odd == "caps" else s[:1].upper() + s[1:]

    def junk(lo: int, hi: int) -> str:
        if r.random() < (0.8 if nameless else 0.35):
            return r.choice(SAYINGS).capitalize() + r.choice(["", ". " + text(lo, hi), f" {r.choice(ASKING)}"])
        return text(lo, hi)


    def wrap(spec: str, inner: str) -> str:
        for s in reversed(spec.split()):
            tag, _, name = s.replace("#", ".#").partition(".")
            name = name.replace(".#", "#")
            if nameless:
                tag = tag if tag in ("ul", "ol", "li", "form", "fieldset") or r.random() < 0.3 else "div"
                name = r.choice(["", f"css-{r.randrange(36**5):x}", f"c{r.randint(1, 40)}", f"sc-{r.randrange(36**4):x} {r.choice(vocab)}"])
            attr = (f' class="{r.choice(UTILITY)}"' if r.random() < 0.15 else "") if not name else f' id="{name[1:]}"' if name[0] == "#" else f' class="{name}{r.choice(["", "", " clearfix", " wrap", " x" + str(r.randint(1, 99)), " " + r.choice(UTILITY)])}"'
            inner = f"<{tag}{attr}>{inner}</{tag}>"
        return inner

    def around(kind: str) -> str:
        specs, form = AROUND[kind]
        link = lambda: f'<a href="/{r.choice(vocab)}">{junk(1, 4)}</a>'
        items = range(r.randint(1, 7))
        if form == "links":
            inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in items) + "</ul>" if r.random() < 0.7 else " | ".join(link() for _ in items)
        elif form == "short":
            inner = r.choice([f"<p>{junk(1, 12)}</p>", f"&copy; {junk(1, 12)}", f"<h1>{text(1, 6)}</h1><ul><li>{link()}</li><li>{link()}</li></ul>", f"<div>{junk(1, 9)}</div><p>{link()}</p>"])
        elif form == "form":
            inner = f'<label>{junk(1, 3)}</label><input name="q"><button>{junk(1, 2)}</button><p>{junk(2, 10)}</p>'
        elif form == "comments" and r.random() < 0.4:
            tag, said = r.choice(["ol", "ul"]), lambda: f"<p>{text(3, 40)}</p>" if r.random() < 0.8 else text(3, 40)
            head = f"<h{r.choice('234')}>{r.choice(['Comments', f'{r.randint(2, 90)} comments', 'Responses', f'{r.randint(1, 30)} thoughts on this', text(1, 4)])}</h{r.choice('234')}>"
            inner = head + f"<{tag}>" + "".join(f"<li>{r.choice(['', '', f'<cite>{text(1, 2)}</cite> ', f'<div>{text(1, 2)} says:</div>'])}{said()}{r.choice(['', '', '<a href=#>Reply</a>'])}</li>" for _ in items) + f"</{tag}>"
        elif form == "comments":
            inner = f"<h3>{r.choice(['Comments', 'Responses', text(1, 2)])}</h3>" + "".join(wrap(r.choice(["div.comment", "li", "div", "article.comment"]), r.choice(["", "", f"<b>{text(1, 2)}</b>", f"<span>{text(1, 2)} says:</span>"]) + f"<p>{text(3, 40)}</p>" + r.choice(["", "", "<a href='#'>Reply</a>"])) for _ in items)
        elif form == "mixed":
            inner = f"<h3>{junk(1, 4)}</h3>" + r.choice(["<ul>" + "".join(f"<li>{link()}</li>" for _ in items) + "</ul>", "".join(f"<p>{junk(3, 25)}</p>" for _ in items)])
        else:
            inner = r.choice([junk(3, 25), f"<p>{junk(3, 30)}</p>", f"<p>{junk(3, 20)}</p><a href='/x'>{junk(1, 2)}</a>"])
        return wrap(r.choice(specs), inner)

    kept: list[str] = []

    def say(tag: str, s: str) -> str:
        kept.append(s)
        if tag == "p" and r.random() < 0.15:
            return f"<p><b>{s}<br>"
        if r.random() < 0.15:
            a, _, b = s.partition(" ")
            s = f"{a} <{(w := r.choice(['em', 'b', 'i', 'span']))}>{b}</{w}>" if b else s
        elif r.random() < 0.1:
            a, _, b = s.partition(" ")
            s = f"<a href='/r'>{a}</a> {b}"
        return f"<{tag}>{s}</{tag}>"

    inner = [say(r.choice(["h1", "h1", "h2"]), text(2, 12))] if r.random() < (0.65 if bare else 0.85) else []
    short = r.random() < (0.5 if bare else 0.25)
    for _ in range(r.randint(1, 3) if short else r.randint(15, 90) if r.random() < 0.08 else r.randint(1, 14)):
        kind = r.random()
        if kind < 0.78:
            inner.append(say(para, text(1, 12) if r.random() < 0.3 else text(8, 70)))
        elif kind < 0.84:
            inner.append(say(r.choice(["h2", "h3"]), text(1, 7)))
        elif kind < 0.89:
            tag = r.choice(["ul", "ol"])
            inner.append(f"<{tag}>" + "".join(say("li", text(2, 20)) for _ in range(r.randint(1, 5))) + f"</{tag}>")
        elif kind < 0.92:
            inner.append("<blockquote>" + say("p", text(5, 40)) + "</blockquote>")
        elif kind < 0.94:
            inner.append(say("pre", text(3, 20)))
        elif kind < 0.96:
            inner.append("<table><tr>" + "".join(say("td", text(1, 5)) for _ in range(3)) + "</tr></table>")
        else:
            inner.append(around(r.choice(["ad", "share", "ad", "notice"])))
    body = wrap(r.choice([*CONTENT[:8], "", "", "", "div", "main"] if bare else [*CONTENT, "main", "main", "article", "article"]), "".join(inner))
    if r.random() < (0.1 if bare else 0.3):
        body = wrap(r.choice(["div.container", "div#page", "div.wrapper", "div.row div.col"]), body)
    often = 0.07 if bare else 0.4
    top = [around(k) for k in ("notice", "header", "nav", "ad", "form", "side") if r.random() < often]
    end = [around(k) for k in ("share", "side", "comments", "form", "ad", "footer", "notice") if r.random() < (0.35 if bare and k == "comments" else often)]
    if r.random() < 0.08:
        # laid out as a table: menus, the main text and what stands beside it are cells
        cell = lambda x: f"<td>{x}</td>"
        links = lambda: r.choice([" ", " | ", "<br>"]).join(f'<a href="/{r.choice(vocab)}">{junk(1, 2)}</a>' for _ in range(r.randint(1, 6)))
        rows = [f"<tr>{cell(r.choice([junk(1, 6), links()]))}</tr>"] * (r.random() < 0.5)
        rows.append("<tr>" + (cell(links()) if r.random() < 0.8 else "") + cell(body) + (cell(r.choice([links(), around("side")])) if r.random() < 0.4 else "") + "</tr>")
        rows += [f"<tr>{cell(junk(1, 8))}</tr>"] * (r.random() < 0.5)
        body, top, end = f"<table>{''.join(rows)}</table>", top[:1], end[-1:]
    if bare and r.random() < 0.5:
        return "".join(top) + body + "".join(end), kept
    page = f"<!DOCTYPE html><html><head><title>{text(2, 8)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>" + "".join(top) + body + "".join(end) + "</body></html>"
    return page, kept


def lesson(r: random.Random) -> tuple[np.ndarray, np.ndarray, list[Block]]:
    """Features and labels of a made page's blocks; the main text's blocks follow in order."""
    page, kept = made_page(r)
    found = blocks(page)
    y, at = np.zeros(len(found), np.float32), 0
    for i, b in enumerate(found):
        if at < len(kept) and b.text == " ".join(kept[at].split()):
            y[i] = 1
            at += 1
    return features(found), y, found


def train(rounds: int = 3000, batch: int = 32, seed: int = 5, rate: float = 4e-3) -> BlockLabeller:
    """Fit on made pages with Adam; the same seed gives the same numbers."""
    r, model = random.Random(seed), BlockLabeller.fresh(seed)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    s = {k: np.zeros_like(v) for k, v in model.w.items()}
    for step in range(1, rounds + 1):
        data = [x for x in (lesson(r) for _ in range(batch)) if len(x[0])]
        # name words are at times unknown, so that layout and place count too
        for x, _, _ in data:
            if r.random() < 0.25:
                x[:, :PATH_DIM] *= np.random.default_rng(step).random(PATH_DIM) > 0.15
        loss, g = model.gradients([x for x, _, _ in data], [y for _, y, _ in data])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        lr = rate * min(1, step / 50) * (1 - 0.9 * step / rounds)
        for k, v in g.items():
            v = v * min(1, 1 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * v
            s[k] = 0.999 * s[k] + 0.001 * v * v
            model.w[k] = (model.w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if step % 100 == 0:
            print(step, round(loss, 4), flush=True)
    return model


def extract(pages: DataFrame, keep: tuple[str, ...] = (), labeller: BlockLabeller | None = None, threshold: float = THRESHOLD, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, the columns of keep unchanged, text. text is the blocks that
    the labeller takes for main text, in page order, joined by two line feeds; empty if none. Null
    html counts as empty. Whole pages are read; repeated rows give repeated results; no markup can
    fail; an empty table gives no rows. A kept column whose name is taken, in any case
    of letters, gets lines behind it; other columns stay behind."""
    model = labeller or BlockLabeller.load()
    taken, kept = {"page_id", "text"}, []
    for c in keep:
        name = c
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        kept.append(F.col(c).alias(name))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col), F.lit("")), *kept)
    schema = T.StructType([f for i, f in enumerate(base.schema) if i != 1]).add("text", "string")

    def run(batches):
        for b in batches:
            for rows, htmls in chunks(list(range(b.num_rows)), b.column(1).to_pylist()):
                found = [blocks(h) for h in htmls]
                texts = ["\n\n".join(x.text for x, p in zip(bs, ps, strict=True) if p >= threshold) for bs, ps in zip(found, model.label(found), strict=True)]
                part = b.slice(rows[0], len(rows))
                yield pa.RecordBatch.from_arrays([c for i, c in enumerate(part.columns) if i != 1] + [pa.array(texts, pa.string())], names=schema.names)

    return base.mapInArrow(run, schema)


def op9_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ("url",)).withColumn("n_chars", F.char_length("text").cast("long"))


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in train().w.items()})
