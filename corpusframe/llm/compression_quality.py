"""Quality scores from zstandard dictionaries of good and of bad labelled text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, filter_texts, id_text, map_texts, table
from .labelled import PER_CLASS, Logistic, sample

#: Bytes of a dictionary; compression level; bytes of a text that are compressed at once, so that
#: a long text meets the dictionaries as often as a short one and not only its own beginning.
DICT_BYTES, LEVEL, PART = 1 << 20, 7, 512
#: Bytes that every size is taken to have besides: short texts tell less.
SHORT = 64
THRESHOLD = 0.7


def dictionary(texts: list[str], size: int = DICT_BYTES, part: int = PART) -> bytes:
    """A zstandard dictionary of raw content: parts of all texts, spread evenly over the whole of
    them, as many as size takes."""
    parts = [raw[i : i + part] for t in texts for raw in [t.encode("utf-8", "replace")] for i in range(0, len(raw), part)]
    room = size // part
    if len(parts) > room:
        parts = [parts[k * len(parts) // room] for k in range(room)]
    return b"".join(parts)


class CompressionScorer:
    """score(text) = calibrated normalised difference of the text's sizes under both dictionaries.

    The difference (bad - good) / (bytes + SHORT) is the only number a score is made of. Two thirds
    of the labelled sample make the dictionaries, the rest fits the logistic curve that turns the
    difference into a probability, for the share of good documents among the labelled ones. Equal
    texts get equal scores; an empty text has the difference 0."""

    def __init__(self, good: bytes, bad: bytes, calibration: Logistic | None, level: int = LEVEL):
        self.good, self.bad, self.calibration, self.level = good, bad, calibration, level
        self.ready = None

    @classmethod
    def fit(cls, texts: list[str], y: list[int], prior: float = 0.5) -> CompressionScorer:
        good = [t for t, v in zip(texts, y, strict=True) if v == 1]
        bad = [t for t, v in zip(texts, y, strict=True) if v == 0]
        cut = lambda ts: (ts[: (2 * len(ts) + 2) // 3], ts[(2 * len(ts) + 2) // 3 :] or ts)
        (g1, g2), (b1, b2) = cut(good), cut(bad)
        scorer = cls(dictionary(g1), dictionary(b1), None)
        if g2 and b2:
            x = np.array([[scorer.difference(t)] for t in g2 + b2])
            scorer.calibration = Logistic(x, np.r_[np.ones(len(g2)), np.zeros(len(b2))], 1e-4).shift(len(g2) / len(x), prior)
        scorer.ready = None
        return scorer

    def _open(self):
        def with_(raw: bytes):
            if not raw:
                return zstandard.ZstdCompressor(level=self.level, write_content_size=False)
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=self.level)
            return zstandard.ZstdCompressor(level=self.level, dict_data=held, write_content_size=False, write_dict_id=False)

        return with_(self.good), with_(self.bad)

    def difference(self, text: str) -> float:
        self.ready = self.ready or self._open()
        raw = text.encode("utf-8", "replace")
        good, bad = (sum(len(c.compress(raw[i : i + PART])) for i in range(0, len(raw), PART)) for c in self.ready)
        return (bad - good) / (len(raw) + SHORT)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(texts), 0.5)
        return self.calibration(np.array([[self.difference(t)] for t in texts]).reshape(-1, 1))


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality", per_class: int = PER_CLASS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted.

    Fits on a bounded sample (per_class whole documents of each class) of the labelled documents
    where train holds; without both classes every score is 0.5. The fitted dictionaries (1 MiB
    each) go to the workers; whole texts are scored there, in memory of one text. Null texts count as
    empty, and empty ones score as the calibration says of no difference. Repeated rows give
    repeated results, equal texts equal scores; an empty table gives no rows. Other columns, whatever
    their names, stay behind."""
    texts, y, prior = sample(docs, labels, label_col, train, per_class, id_col, text_col)
    scorer = CompressionScorer.fit(texts, y, prior)

    def make():
        return lambda ids, part: [ids, scorer.scores(part)]

    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    made = map_texts(id_text(docs, id_col, text_col), make, schema, "doc_id long, score double")
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality", per_class: int = PER_CLASS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all columns whatever their names, whose score by quality_scores() reaches
    threshold; repeated rows stay or go together."""
    scorer = CompressionScorer.fit(*sample(docs, labels, label_col, train, per_class, id_col, text_col))
    return filter_texts(docs, lambda: lambda part: (scorer.scores(part) >= threshold).tolist(), text_col)


def held_out() -> Column:
    return crc_mod(F.col("doc_id"), 4) == 2


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    made = quality_scores(docs, labels, ~held_out())
    return made.select("doc_id", held_out().alias("held_out"), "score", "predicted")
