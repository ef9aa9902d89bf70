"""Whole corpus builds, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, metrics, numbering, quality, segments, select


def keep_ids(manifest: DataFrame, problems: DataFrame, min_dur: float, videos: DataFrame | None = None) -> DataFrame:
    """Ids of (id, dialect, duration) that are no problem and long enough, of named videos only if
    those are given (the first eleven characters of an id name its video)."""
    rows = joins.resume(manifest.where(F.col("duration") >= min_dur), problems, "id")
    return rows if videos is None else joins.keep_prefix(rows, videos, F.substring("id", 1, 11), "id")


def remaining_budget(rows: DataFrame, real: DataFrame | None, target_s: float, min_dur: float | None = None, subset_min: float | None = None, seed: int = 0) -> DataFrame:
    """Converted rows (id, dialect, duration) that a dialect takes besides its real ones: rows of at
    least min_dur (else subset_min, else 3) seconds, in a chance order, from where real rows end up to
    target_s. real holds (dialect, have) seconds; without that table every long enough row is
    taken, and a dialect that it lacks has none yet."""
    rows = select.long_enough(rows, "duration", min_dur, subset_min)
    if real is None:
        return rows
    cols = rows.columns
    rows = rows.join(real.select("dialect", "have"), "dialect", "left")
    start = F.coalesce("have", F.lit(0.0))
    return numbering.budget_prefix(rows, ["dialect"], numbering.key_of(seed, F.col("id")), ["id"], F.col("duration"), F.lit(target_s), start).select(*cols)


def balanced_hours(real: DataFrame, extra: DataFrame, converted: DataFrame | None, target_s: float, seed: int = 0) -> DataFrame:
    """Rows (id, dialect, duration, origin) up to target_s seconds a dialect: real clips first, then
    extra ones from where real ones end, then converted ones for what is still missing. The
    seconds reached are an explicit table between the steps."""

    def fill(rows: DataFrame, have: DataFrame | None) -> DataFrame:
        rows = rows if have is None else rows.join(have, "dialect", "left")
        start = F.lit(0.0) if have is None else F.coalesce("have", F.lit(0.0))
        key = numbering.key_of(seed, F.col("id"))
        return numbering.budget_prefix(rows, ["dialect"], key, ["id"], F.col("duration"), F.lit(target_s), start).select("id", "dialect", "duration")

    chosen = fill(real, None).withColumn("origin", F.lit("real"))
    for name, more in (("extra", extra), ("converted", converted)):
        if more is not None:
            have = chosen.groupBy("dialect").agg(F.sum("duration").alias("have"))
            chosen = chosen.unionByName(fill(more, have).withColumn("origin", F.lit(name)))
    return chosen


def train_set(real: DataFrame, problems: DataFrame, converted: DataFrame | None, segments_: DataFrame, target_s: float, min_dur: float, videos: DataFrame | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The segments that a training run reads, and their summary: real clips that are no problem, up to
    target_s seconds a dialect, converted ones for what is missing, joined to the segment table
    (id, dialect, start_s, dur_s) by id; segments of other clips fall away and are counted."""
    kept = balanced_hours(keep_ids(real, problems, min_dur, videos), real.limit(0), None, target_s, seed).select("id", "dialect", "duration")
    if converted is not None:
        have = kept.groupBy("dialect").agg(F.sum("duration").alias("have"))
        kept = kept.unionByName(remaining_budget(converted, have, target_s, min_dur, seed=seed).select("id", "dialect", "duration"))
    return joins.segment_join(segments_, kept.select("id"), "id"), joins.segment_summary(segments_, kept, "id", "dur_s")


def short_clip_build(base: DataFrame, short: DataFrame, alignments: DataFrame, mode: str, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """base (audio, text, dialect) and, by mode, the short clips (audio, text, dialect, src, span, gap)
    whose weaker boundary and edge words are wide enough (filtered), all of them (identity) or none;
    and the checks: spans within their words, no short clip twice, files that are not there. A short
    clip without an alignment fails the query."""
    return built_of(base, met_short_clips(short, alignments), mode, files)


def met_short_clips(short: DataFrame, alignments: DataFrame) -> DataFrame:
    """Short clips (audio, text, dialect) with __inside (is the span within its words?) and __ok (are its
    boundary and edge words wide enough?): all that a build asks of alignments, in narrow rows."""
    words = segments.usable(F.col("words"))
    met = joins.required_join(short, alignments.select("audio", words.alias("words")).withColumnRenamed("audio", "__src"), "src", "__src", "alignment")
    i, j = F.col("span")[0], F.col("span")[1]
    inside = (i >= 0) & (i <= j) & (j < F.size("words"))
    return met.select("audio", "text", "dialect", inside.alias("__inside"), segments.boundary_ok(F.col("words"), i, j, F.col("gap")).alias("__ok"))


def built_of(base: DataFrame, met: DataFrame, mode: str, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """short_clip_build()'s rows and checks from met_short_clips(). Kept as a table, that serves all modes."""
    kept = quality.chosen(met, mode, F.col("__ok")).select("audio", "text", "dialect")
    rows = base.select("audio", "text", "dialect").unionByName(kept)
    checks = [quality.violations(met, span_inside=F.col("__inside")), quality.duplicate_rows(kept, ["audio"])]
    if files is not None:
        checks.append(quality.missing_files(rows, files, "audio"))
    return rows, quality.together(*checks)


def base_build(originals: DataFrame, clean_files: DataFrame, converted: DataFrame, transcripts: DataFrame, per_group: int, times: int = 3, seed: int = 0) -> DataFrame:
    """(audio, text, dialect, origin): original clips (audio, dialect) that have a transcript (stem,
    text, row) `times` times, their clean counterparts (path) as often where the file is there, and
    per_group converted clips of each group whose source has a transcript."""
    from ..functions.text import stem_simple

    real = joins.transcripts_to_clips(originals, transcripts, stem_simple(F.col("audio")), "stem", ["row"]).withColumn("origin", F.lit("original"))
    other = F.replace("audio", F.lit("/audio/original/"), F.lit("/audio/clean-neural/"))
    clean = joins.with_counterparts(real, clean_files, other, "path").withColumn("audio", other).withColumn("origin", F.lit("clean"))
    drawn = select.hash_sample(converted, ["dialect"], ["audio"], per_group, seed)
    made = joins.converted_to_sources(drawn, transcripts, F.element_at(F.split("audio", "/"), -1), "stem", ["row"]).withColumn("origin", F.lit("converted"))
    cols = ["audio", "text", "dialect", "origin"]
    return select.replicate(real.select(*cols).unionByName(clean.select(*cols)), times).unionByName(made.select(*cols))


def segment_build(first: DataFrame, second: DataFrame, length: float, hop: float, shortest: float, cap: int | None = None, balance: bool = False, seed: int = 0) -> DataFrame:
    """Segments of two corpora (id, dialect, duration): an id of both counts for the first; then
    windows, and if asked for the same number of segments a dialect."""
    clips = first.withColumn("source", F.lit("first")).unionByName(joins.resume(second, first, "id").withColumn("source", F.lit("second")))
    out = segments.segment_table(clips, "duration", length, hop, shortest)
    if balance:
        return select.balance(out, "dialect", ["id", "start_s"], cap, seed)
    return select.hash_sample(out, ["dialect"], ["id", "start_s"], cap, seed) if cap else out


def segment_totals(built: DataFrame) -> DataFrame:
    """Per dialect: segments, their share of all, hours."""
    total = built.agg(F.count("*").alias("all"))
    per = built.groupBy("dialect").agg(F.count("*").alias("n"), (F.sum("dur_s") / 3600).alias("hours"))
    return per.crossJoin(F.broadcast(total)).select("dialect", "n", (F.col("n") / F.col("all")).alias("share"), "hours")


def short_clips(alignments: DataFrame, quotas: DataFrame, worst: float = 0.1) -> DataFrame:
    """Spans chosen from aligned clips (audio, dialect, words, duration, score): the worst-scoring
    tenth of each dialect goes, spans are listed, quotas (dialect, nw, bin, quota) are filled."""
    good = metrics.percentile_gate(alignments, "dialect", "score", worst).drop("gate")
    listed = segments.word_spans(good, "words", "duration").withColumn("utt", F.col("audio"))
    cols = ["dialect", "utt", "i", "j", "nw", "bin", "tier", "gap", "score", "t0", "t1", "dur", "span_text"]
    return select.quota_fill(listed.select(*cols), quotas, "dialect")


def assemble(parts: list[DataFrame], held_out: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The union of manifests as (audio, text, dialect), and its checks: texts begin as they must,
    nothing is of the held-out audio, no row lacks a part."""
    rows = quality.together(*[p.select("audio", "text", "dialect") for p in parts])
    checks = quality.together(
        quality.violations(rows, whole=F.col("audio").isNotNull() & F.col("text").isNotNull(), begins=F.startswith("text", F.lit(prefix)), original=~F.contains("audio", F.lit("original_val"))),
        quality.leaked_rows(rows, held_out, ["audio"]),
    )
    return rows, checks
