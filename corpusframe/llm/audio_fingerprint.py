"""Chroma fingerprints of recordings, and their alignment by offset histograms and bit errors."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small, table

SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
#: Recordings align if so few bits differ over so many codes, found by so many codes equal
#: but for one bit.
BIT_ERROR, OVERLAP, HITS = 0.15, 16, 2


@dataclass(frozen=True)
class Settings:
    """Samples a second, samples a frame and from frame to frame, frames that a code looks at."""

    rate: int = 11025
    frame: int = 4096
    hop: int = 1365
    window: int = 16
    low: float = 60.0
    high: float = 3520.0


#: For the short recordings of the query.
SHORT = Settings(rate=4000, frame=1024, hop=341, high=1800.0)


@lru_cache(maxsize=8)
def pitch_map(s: Settings) -> np.ndarray:
    """(spectrum bins, 12): which pitch class a bin's energy counts for."""
    f = np.fft.rfftfreq(s.frame, 1 / s.rate)
    use = (f >= s.low) & (f <= s.high)
    note = np.round(12 * np.log2(np.maximum(f, 1e-9) / 440)).astype(int) % 12
    m = np.zeros((len(f), 12))
    m[np.flatnonzero(use), note[use]] = 1
    return m


def chroma(x: np.ndarray, s: Settings) -> np.ndarray:
    """(frames, 12): energies of the pitch classes, smoothed over five frames, each frame of unit
    length; silent frames are zero."""
    if len(x) < s.frame:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, s.frame)[:: s.hop]
    energy = np.empty((len(frames), 12))
    window = np.hamming(s.frame)
    for lo in range(0, len(frames), 256):
        energy[lo : lo + 256] = np.abs(np.fft.rfft(frames[lo : lo + 256] * window)) ** 2 @ pitch_map(s)
    if len(energy) < len(SMOOTH):
        return np.zeros((0, 12))
    soft = sum(w * energy[i : len(energy) - len(SMOOTH) + 1 + i] for i, w in enumerate(SMOOTH))
    norm = np.linalg.norm(soft, axis=1, keepdims=True)
    return np.where(norm > 1e-6, soft / np.maximum(norm, 1e-6), 0)


def filters(window: int) -> list[tuple[int, int, int, int]]:
    """Sixteen (kind, first pitch class, classes, frames), spread over kinds, places and widths."""
    widths = (window, window * 3 // 4, window // 2)
    return [(i % 6, (5 * i) % 12 if i % 6 else 0, 12 if i % 6 == 0 else 2 + (i * 7) % 4 * 2, max(4, widths[i // 6])) for i in range(16)]


def responses(c: np.ndarray, window: int) -> np.ndarray:
    """(places, 16): log ratios of two areas of the chroma image for each filter, from sums of its
    integral image. Kinds: all against nothing, upper/lower half, earlier/later half, the two
    diagonals, middle/outer frames, middle/outer classes. Pitch classes wrap around."""
    places = len(c) - window + 1
    if places < 1:
        return np.zeros((0, 16))
    image = np.zeros((len(c) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.concatenate([c, c], axis=1), axis=0), axis=1)
    t = np.arange(places)

    def area(t1: int, t2: int, p1: int, p2: int) -> np.ndarray:
        return image[t + t2, p2] - image[t + t1, p2] - image[t + t2, p1] + image[t + t1, p1]

    out = np.empty((places, 16))
    for k, (kind, p, h, w) in enumerate(filters(window)):
        q, m, half = p + h, p + h // 2, w // 2
        if kind == 0:
            a, b = area(0, half, 0, 6) + area(half, w, 6, 12), area(0, half, 6, 12) + area(half, w, 0, 6)
        elif kind == 1:
            a, b = area(0, w, m, q), area(0, w, p, m)
        elif kind == 2:
            a, b = area(half, w, p, q), area(0, half, p, q)
        elif kind == 3:
            a, b = area(0, half, p, m) + area(half, w, m, q), area(0, half, m, q) + area(half, w, p, m)
        elif kind == 4:
            a, b = area(w // 3, w - w // 3, p, q), area(0, w // 3, p, q) + area(w - w // 3, w, p, q)
        else:
            a, b = area(0, w, p + h // 4 or p, q - h // 4), area(0, w, q, min(24, q + h))
        out[:, k] = np.log((a + 0.5) / (b + 0.5))
    return out


@lru_cache(maxsize=8)
def thresholds(s: Settings) -> np.ndarray:
    """(3, 16): quartiles of the responses over made recordings of chance tones."""
    r = np.random.default_rng(11)
    notes = [np.clip(np.rint(r.normal(18, 5, 48)), 0, 35) for _ in range(24)]
    got = [responses(chroma(tones(n, s, s.window * s.hop / s.rate / 13), s), s.window) for n in notes]
    return np.quantile(np.concatenate(got), [0.25, 0.5, 0.75], axis=0)


def tones(notes: np.ndarray, s: Settings, seconds: float) -> np.ndarray:
    """A recording of one tone after the other, with an overtone; note 0 is 110 Hz."""
    n = int(s.rate * seconds)
    phase = 2 * np.pi * np.arange(n) / s.rate
    f = 110 * 2 ** (np.asarray(notes, float) / 12)
    x = np.sin(f[:, None] * phase) + 0.3 * np.sin(2 * f[:, None] * phase)
    return (x * np.hanning(n)).ravel()


def codes(x: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """Packed 32-bit codes of a recording: for each filter two bits, the quartile in Gray code, so
    that neighbouring quartiles differ in one bit. Recordings shorter than one window have none."""
    r = responses(chroma(x, s), s.window)
    level = (r[:, :, None] > thresholds(s).T).sum(2)
    gray = np.array([0, 1, 3, 2], dtype=np.uint32)[level]
    out = np.zeros(len(r), dtype=np.uint32)
    for k in range(16):
        out = out << np.uint32(2) | gray[:, k]
    return out.view(np.int32)


def pcm16(raw: bytes) -> np.ndarray:
    """Little-endian 16-bit samples; an odd last byte is left out."""
    return np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<i2") / 32768.0


def sonify(vector: list) -> np.ndarray:
    """A vector as 0.1-second tones, one for each component, on three octaves."""
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], float))
    return tones(np.clip(np.floor(18 + 40 * v), 0, 35), SHORT, 0.1)


def fingerprints(recordings: DataFrame, id_col: str, source_col: str, decode: Callable = pcm16, settings: Settings = Settings()) -> DataFrame:
    """One row per input row: rec_id, codes (array of int). decode makes samples of source_col's
    values (PCM bytes as they stand); null sources have no codes."""
    base = recordings.select(F.col(id_col).cast("long").alias("rec_id"), F.col(source_col).alias("source"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = [codes(decode(v), settings) if v is not None and len(v) else [] for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.int32()))], names=["rec_id", "codes"])

    return base.mapInArrow(run, "rec_id long, codes array<int>")


@lru_cache(maxsize=8)
def silence(s: Settings) -> int:
    """The code of a window in which nothing sounds."""
    return int(codes(np.zeros(s.frame + s.hop * (s.window + len(SMOOTH))), s)[0])


def align(prints: DataFrame, is_query: Column, bit_error: float = BIT_ERROR, overlap: int = OVERLAP, hits: int = HITS, silent: int | None = None, is_indexed: Column | None = None) -> DataFrame:
    """One row per row of prints: rec_id, class_id, n_codes, is_query, n_matches, match_id,
    offset, error.

    Recordings of equal codes are one class, of which only the smallest id is compared. Codes of
    the classes that hold a query are joined with those of all classes; for each pair a histogram
    of place differences names the offsets where at least `hits` codes are equal but for one bit (a
    lookup's codes are asked for with each bit turned), and at each of them the bits that differ over
    the overlap decide. The code `silent` says nothing about a recording:
    it finds no pairs, but counts in overlaps. is_indexed says which rows may be found; by default
    all. n_matches counts other classes that align; match_id is
    the best of them (fewest errors, then smallest id), offset its place less the query's. Rows
    that are no query, or have no codes or no match, have 0 and nulls there. Every row is indexed
    and nothing is capped. Recordings of any length are taken whole; repeated rows give repeated
    results, an empty table none."""
    digest = F.sha2(F.concat_ws(",", F.col("codes").cast("array<string>")), 256)
    rows = materialize(prints.withColumn("digest", digest).withColumns({"q": is_query, "ix": F.lit(True) if is_indexed is None else is_indexed}))
    groups = rows.where("size(codes) > 0").groupBy("digest").agg(F.min("rec_id").alias("class_id"), F.max("q").alias("asked"), F.max("ix").alias("listed"), F.count("*").alias("n"))
    groups = materialize(groups.where("class_id is not null"))
    n_groups = groups.count()
    reps = materialize(rows.join(small(groups, n_groups), "digest").where("rec_id = class_id").select("class_id", "asked", "listed", "codes").dropDuplicates(["class_id"]))
    placed = reps.select("class_id", "asked", "listed", F.posexplode("codes").alias("at", "code"))
    if silent is not None:
        placed = placed.where(F.col("code") != silent)
    asked = placed.where("asked").select(F.col("class_id").alias("a"), F.col("at").alias("i"), "code")
    masks = [0, *(1 << k for k in range(31)), -(1 << 31)]
    asked = asked.select("a", "i", "code", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select("a", "i", F.col("code").bitwiseXOR(F.col("mask")).alias("code"))
    found = asked.join(placed.where("listed").select(F.col("class_id").alias("b"), F.col("at").alias("j"), "code"), "code").where("a <> b")
    offsets = found.groupBy("a", "b", (F.col("j") - F.col("i")).alias("offset")).agg(F.count("*").alias("k")).where(F.col("k") >= hits)
    offsets = materialize(offsets.select("a", "b", "offset"))
    side = lambda c: reps.select(F.col("class_id").alias(c), F.col("codes").alias(f"codes_{c}"))
    both = offsets.join(side("a"), "a").join(side("b"), "b")
    x = F.expr("slice(codes_a, greatest(0, -offset) + 1, greatest(0, least(size(codes_a) + least(0, offset), size(codes_b) - greatest(0, offset))))")
    y = F.expr("slice(codes_b, greatest(0, offset) + 1, greatest(0, least(size(codes_a) + least(0, offset), size(codes_b) - greatest(0, offset))))")
    both = both.withColumns({"x": x, "y": y})
    wrong = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    judged = both.withColumn("error", wrong / (32 * F.greatest(F.size("x"), F.lit(1)))).where((F.size("x") >= overlap) & (F.col("error") <= bit_error))
    top = judged.groupBy("a").agg(F.count_distinct("b").alias("n_matches"), F.min(F.struct("error", "b", "offset")).alias("m"))
    top = materialize(top.select(F.col("a").alias("class_id"), "n_matches", F.col("m.b").alias("match_id"), F.col("m.offset").alias("offset"), F.col("m.error").alias("error")))
    out = rows.select("rec_id", "digest", F.size("codes").cast("long").alias("n_codes"), "q").join(small(groups.select("digest", "class_id"), n_groups), "digest", "left")
    out = out.join(small(top, top.count()), "class_id", "left")
    only = lambda c: F.when(F.col("q"), F.col(c)).alias(c)
    return out.select("rec_id", F.coalesce("class_id", "rec_id").alias("class_id"), "n_codes", F.col("q").alias("is_query"), F.coalesce(only("n_matches"), F.lit(0)).cast("long").alias("n_matches"), only("match_id"), F.when(F.col("q"), F.col("offset").cast("long")).alias("offset"), only("error"))


#: How much of a lookup's recording is cut off ahead, and the noise laid over the rest.
CUT, NOISE = 0.3, 0.03


def excerpt(vector: list) -> np.ndarray:
    """A recording as a listener may hold it: begun late, with noise over it. Equal vectors give equal
    excerpts."""
    x = sonify(vector)
    x = x[int(len(x) * CUT) :]
    seed = zlib.crc32(np.round(np.nan_to_num(np.array([0.0 if v is None else v for v in vector], float)), 6).tobytes())
    return x + NOISE * np.random.default_rng(seed).normal(size=len(x))


def op2_audio_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Each vector of embeddings is a recording, and all are indexed. Of every id divisible by 50 a
    noisy excerpt is looked up; its own recording is what it should find, offset codes later."""
    table_ = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    whole = fingerprints(table_, "vec_id", "embedding", sonify, SHORT)
    asked = F.coalesce(F.col("rec_id") % 50 == 0, F.lit(False))
    looked = fingerprints(table_.where("vec_id % 50 = 0"), "vec_id", "embedding", excerpt, SHORT)
    both = whole.unionByName(looked.select((-1 - F.col("rec_id")).alias("rec_id"), "codes"))
    made = materialize(align(both, F.col("rec_id") < 0, silent=silence(SHORT), is_indexed=F.coalesce(F.col("rec_id") >= 0, F.lit(True))))
    found = made.where("is_query").select((-1 - F.col("rec_id")).alias("rec_id"), "n_matches", "match_id", "offset", "error").dropDuplicates(["rec_id"])
    own = made.where("not coalesce(rec_id < 0, false)").select("rec_id", "class_id", "n_codes", asked.alias("is_query"))
    out = own.join(small(found, found.count()), "rec_id", "left")
    return out.select("rec_id", "class_id", "n_codes", "is_query", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), "match_id", "offset", "error")
