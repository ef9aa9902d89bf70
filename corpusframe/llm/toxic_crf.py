"""Toxic spans by a linear-chain conditional random field, and document scores from them."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, filter_texts, id_text, map_texts, table
from .labelled import PER_CLASS, Logistic, sample

WORD = re.compile(r"\w+")
#: Weights; words remembered by a worker; documents that run side by side, and their tokens.
DIM, CACHE, BATCH, CELLS = 1 << 18, 200_000, 512, 1_000_000
#: Documents that a word must be in for a weight of its own; rarer ones share those of their parts.
OWN = 5
#: A form marks tokens in toxic documents if its share of documents is so much larger there,
#: and if chance would give that with a log probability of SEED_LOG at most.
SEED_SHARE, SEED_LOG = 0.8, -11.5
THRESHOLD, SPAN = 0.5, 0.5


def forms(word: str) -> list[str]:
    """What stands for a word: itself, its beginnings, its end."""
    return [f"={word}", *(f"^{word[:k]}" for k in range(3, min(8, len(word)) + 1)), f"{word[-3:]}$"]


def places(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "replace")) % DIM for f in forms(word)]


def marginals(emit: list[np.ndarray], trans: np.ndarray, pairs: bool = False):
    """P(toxic) of every token of each sequence by forward-backward; with pairs also the
    expected numbers of the four transitions. Sequences of like length run side by side, and
    two labels need one number a step: the odds of the toxic label.

    trans[i, j] is the weight of label i before label j, 1 for toxic; trans[0, 0] is 0."""
    out: list[np.ndarray] = [np.zeros(0)] * len(emit)
    expected = np.zeros((2, 2))
    order = sorted(range(len(emit)), key=lambda i: len(emit[i]))
    (_, ot), (to, tt) = np.exp(trans)
    while order:
        steps = len(emit[order[-1]])
        if not steps:
            break
        take = max(1, min(BATCH, CELLS // steps))
        part, order = order[-take:], order[:-take]
        n = np.array([len(emit[i]) for i in part])
        e = np.zeros((steps, len(part)))
        for k, i in enumerate(part):
            e[: n[k], k] = emit[i]
        e = np.exp(np.clip(e, -40, 40))
        a, b = np.empty_like(e), np.ones_like(e)
        a[0] = e[0]
        for t in range(1, steps):
            a[t] = e[t] * (a[t - 1] * tt + ot) / (a[t - 1] * to + 1)
        for t in range(steps - 2, -1, -1):
            x = e[t + 1] * b[t + 1]
            b[t] = np.where(t + 1 < n, (x * tt + to) / (x * ot + 1), 1)
        p = a * b
        p /= 1 + p
        for k, i in enumerate(part):
            out[i] = p[: n[k], k].copy()
        if pairs and steps > 1:
            live = np.arange(1, steps)[:, None] < n
            x, y = a[:-1], (e * b)[1:]
            w = np.stack([np.ones_like(x), y * ot, x * to, x * y * tt])
            expected += ((w / w.sum(0)) * live).sum((1, 2)).reshape(2, 2)
    return (out, expected) if pairs else out


class ToxicField:
    """A fitted field, its document calibration, and what workers need to apply them."""

    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, calibration: Logistic | None):
        keep = np.flatnonzero(weights)
        self.keep, self.value = keep, weights[keep]
        self.bias, self.trans, self.calibration = bias, trans, calibration
        self.table = self.cache = None

    @classmethod
    def fit(cls, texts: list[str], y: list[int], prior: float = 0.5, steps: int = 30) -> ToxicField:
        """Labels of documents become labels of tokens: in toxic documents those tokens are
        toxic that have a form found nearly only in toxic ones. Then half of the documents fit the
        field (ascent with per-weight steps), the other half calibrates document scores."""
        same: dict[str, str] = {}  # one string a distinct word: the driver holds all lists
        words = [[same.setdefault(w, w) for w in map(str.lower, WORD.findall(t))] for t in texts]
        half = len(texts) // 2 if sum(y[: len(texts) // 2]) >= 2 else len(texts)
        groups: tuple[dict, dict] = ({}, {})
        for k, (ws, v) in enumerate(zip(words, y, strict=True)):
            # near copies mostly agree in the three words of the smallest hash: they count once
            least = min((zlib.crc32(" ".join(ws[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(ws) - 2))), default=0)
            if ws:
                groups[v].setdefault(least, k)
        n = [max(1, len(g)) for g in groups]
        rate = n[1] / (n[0] + n[1])
        seen = [Counter(), Counter()]
        for k in groups[1].values():
            seen[1].update({f for w in set(words[k]) for f in forms(w)})
        # too few documents for any chance to be small enough
        seen[1] = Counter({f: c for f, c in seen[1].items() if c * math.log(rate) <= SEED_LOG})
        for k in groups[0].values():
            seen[0].update({f for w in set(words[k]) for f in forms(w) if f in seen[1]})
        share = lambda f: (r := seen[1][f] / n[1]) / (r + (seen[0][f] + 0.5) / n[0])

        def chance(f: str) -> float:
            c, all_ = seen[1][f], seen[1][f] + seen[0][f]
            q = c / all_
            far = c * math.log(q / rate) + ((all_ - c) * math.log((1 - q) / (1 - rate)) if q < 1 else 0)
            return -far if q > rate else 0.0

        seeds = {f for f in seen[1] if share(f) >= SEED_SHARE and chance(f) <= SEED_LOG}
        strong = lambda w: any(f in seeds for f in forms(w))
        vocab: dict[str, int] = {}
        seqs, tags = [], []
        for ws, v in zip(words[:half], y, strict=False):
            seqs.append(np.array([vocab.setdefault(w, len(vocab)) for w in ws], dtype=np.int64))
            tags.append(np.array([v and strong(w) for w in ws], dtype=float))
        often = np.bincount(np.concatenate([np.unique(q) for q in seqs]), minlength=len(vocab)) if vocab else []
        where = [places(w)[int(n < OWN) :] for w, n in zip(vocab, often, strict=True)]
        flat = np.array([i for p in where for i in p], dtype=np.int64)
        of = np.repeat(np.arange(len(where)), [len(p) for p in where])
        weights, bias, trans = np.zeros(DIM), -3.0, np.zeros((2, 2))
        total, seq = np.zeros(DIM), np.concatenate(seqs) if seqs else np.zeros(0, int)
        gold = np.concatenate(tags) if tags else np.zeros(0)
        if gold.sum():
            seen_pairs = np.zeros((2, 2))
            for t in tags:
                k = (t[:-1] * 2 + t[1:]).astype(int)
                seen_pairs += np.bincount(k, minlength=4).reshape(2, 2)
            scale = len(gold) / gold.sum()
            t_total, b_total = np.zeros((2, 2)), 0.0
            for _ in range(steps):
                score = np.bincount(of, weights=weights[flat], minlength=len(where)) + bias
                p, pairs = marginals([score[s] for s in seqs], trans, True)
                off = gold - np.concatenate(p)
                by_word = np.bincount(seq, weights=off, minlength=len(where))
                g = np.bincount(flat, weights=by_word[of], minlength=DIM) - 0.05 * weights
                total += g * g
                weights += 0.6 * g / (np.sqrt(total) + 1e-3)
                g = off.sum()
                b_total += g * g
                bias += 0.5 * g / (math.sqrt(b_total) + 1e-3)
                g = (seen_pairs - pairs) * np.array([[0, 1], [1, 1]])
                t_total += g * g
                trans += 0.3 * g / (np.sqrt(t_total) + 1e-3)
            weights[np.abs(weights) < 1e-3] = 0
        field = cls(weights, bias, trans, None)
        rest = slice(half, None) if half < len(texts) else slice(0, None)
        y2 = np.array(y[rest])
        if gold.sum() and 0 < y2.sum() < len(y2):
            x = np.array([field.summary(p) for p in field.tag([w for w in words[rest]])])
            field.calibration = Logistic(x, y2, 2e-4).shift(y2.mean(), prior)
        return field

    def __getstate__(self):
        return self.__dict__ | {"table": None, "cache": None}

    def emission(self, word: str) -> float:
        if self.table is None:
            self.table = np.zeros(DIM)
            self.table[self.keep] = self.value
            self.cache = {}
        if (v := self.cache.get(word)) is None:
            if len(self.cache) >= CACHE:
                self.cache = dict(list(self.cache.items())[CACHE // 2 :])
            v = self.cache[word] = float(self.table[places(word)].sum() + self.bias)
        return v

    def tag(self, words: list[list[str]]) -> list[np.ndarray]:
        if self.cache is None:
            self.emission("")
        emit = []
        for ws in words:
            got = list(map(self.cache.get, ws))
            if None in got:
                got = [self.emission(w) if g is None else g for w, g in zip(ws, got, strict=True)]
            emit.append(np.array(got))
        return marginals(emit, self.trans)

    @staticmethod
    def summary(p: np.ndarray) -> list[float]:
        if not len(p):
            return [0.0, 0.0, 0.0, 0.0]
        top = np.sort(p)[-3:]
        return [float(top[-1]), float(np.log1p((p * (p > 0.2)).sum())), float(top.sum() / 3), float(min(1.0, 20 * (p * (p > 0.2)).mean()))]

    def document(self, ps: list[np.ndarray]) -> np.ndarray:
        if self.calibration is None or not ps:
            return np.zeros(len(ps))
        return self.calibration(np.array([self.summary(p) for p in ps]))


def toxicity(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "toxic", per_class: int = PER_CLASS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted, n_spans, spans (array of start, end:
    character offsets of runs of words whose marginal is SPAN or more).

    Fits on a bounded sample (per_class whole documents of each class) of the labelled documents
    where train holds: half of them fits the field, the other half calibrates. Without toxic ones, or
    none of their words telling, all scores are 0. Whole texts are tagged, in memory bounded by one
    text or part of a batch. Null and empty texts have no spans and the score of none. Repeated
    rows give repeated results; an empty table gives no rows; other columns, whatever their names,
    stay behind."""
    texts, y, prior = sample(docs, labels, label_col, train, per_class, id_col, text_col)
    field = ToxicField.fit(texts, y, prior)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_spans", pa.int64()), ("spans", span)])

    def make():
        def spans(text: str, p: np.ndarray) -> list[dict]:
            if not len(p) or p.max() < SPAN:
                return []
            hot = np.flatnonzero(p >= SPAN)
            at = [(m.start(), m.end()) for m in WORD.finditer(text)]
            runs = np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1)
            return [{"start": at[r[0]][0], "end": at[r[-1]][1]} for r in runs]

        def work(ids: list, part: list[str]) -> list:
            ps = field.tag([[w.lower() for w in WORD.findall(t)] for t in part])
            found = [spans(t, p) for t, p in zip(part, ps, strict=True)]
            return [ids, field.document(ps), [len(s) for s in found], found]

        return work

    made = map_texts(id_text(docs, id_col, text_col), make, schema, "doc_id long, score double, n_spans long, spans array<struct<start:long,end:long>>")
    return made.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_spans", "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "toxic", per_class: int = PER_CLASS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all columns, without those whose score by toxicity() reaches threshold."""
    field = ToxicField.fit(*sample(docs, labels, label_col, train, per_class, id_col, text_col))

    def make():
        words = lambda part: [[w.lower() for w in WORD.findall(t)] for t in part]
        return lambda part: (field.document(field.tag(words(part))) < threshold).tolist()

    return filter_texts(docs, make, text_col)


def held_out() -> Column:
    return crc_mod(F.col("doc_id"), 5) == 0


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    made = toxicity(docs, labels, ~held_out())
    return made.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_spans", "spans")
