"""Named joins of corpora: durations, segments, submissions, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def override_durations(listed: DataFrame, measured: DataFrame, key: str, duration: str) -> DataFrame:
    """(key, duration) of both: a measured positive one goes before a listed one."""
    m = measured.select(key, F.col(duration).alias("__m"))
    out = listed.select(key, F.col(duration).alias("__l")).join(m, key, "full_outer")
    return out.select(key, F.coalesce(F.when(F.col("__m") > 0, F.col("__m")), "__l").alias(duration)).where(F.col(duration).isNotNull())


def segment_join(segments: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return segments.join(rows, key)


def segment_coverage(segments: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """One row: matched segments, segments without a row, rows without a segment, their share."""
    s, r = segments.select(key), rows.select(key).distinct()
    matched = s.join(r, key, "left_semi").agg(F.count("*").alias("matched"))
    missed = s.join(r, key, "left_anti").agg(F.count("*").alias("missed"))
    bare = r.join(s.distinct(), key, "left_anti").agg(F.count("*").alias("uncovered"))
    n = r.agg(F.count("*").alias("rows"))
    out = matched.crossJoin(missed).crossJoin(bare).crossJoin(n)
    return out.withColumn("uncovered_share", F.when(F.col("rows") > 0, F.col("uncovered") / F.col("rows")).otherwise(0.0))


def submission(manifest: DataFrame, hyps: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Every manifest row with its hypothesis on one line ('' without one) and status MISSING,
    EMPTY or OK."""
    from ..functions.text import one_line

    h = hyps.select(*keys, F.col(text).alias("__h"), F.lit(True).alias("__there"))
    line = one_line(F.coalesce("__h", F.lit("")))
    out = manifest.join(h, keys, "left").withColumn("line", line)
    return out.withColumn("status", F.when(F.col("__there").isNull(), "MISSING").when(F.col("line") == "", "EMPTY").otherwise("OK")).drop("__h", "__there")


def keep_prefix(df: DataFrame, allowed: DataFrame, prefix: Column, key: str) -> DataFrame:
    """Rows whose prefix is among allowed's keys."""
    return df.withColumn("__p", prefix).join(allowed.select(F.col(key).alias("__p")).distinct(), "__p", "left_semi").drop("__p")


def resume(plan: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What the plan has and done has not."""
    return plan.join(done.select(key).distinct(), key, "left_anti")


def transcripts_to_clips(clips: DataFrame, transcripts: DataFrame, stem: Column, key: str, order: list[str], text: str = "text") -> DataFrame:
    """clips with the text of their file's stem, whatever their group; of a stem's several transcripts
    the last by order counts, and clips without one fall away."""
    said = transcripts.groupBy(F.col(key).alias("__stem")).agg(F.max_by(text, F.struct(*order)).alias(text))
    return clips.withColumn("__stem", stem).join(said, "__stem").drop("__stem")


def converted_to_sources(clips: DataFrame, transcripts: DataFrame, name: Column, key: str, order: list[str], text: str = "text") -> DataFrame:
    """Converted clips with the text of their source, which their name holds before '__'."""
    return transcripts_to_clips(clips, transcripts, F.substring_index(name, "__", 1), key, order, text)


def with_counterparts(rows: DataFrame, files: DataFrame, counterpart: Column, path: str) -> DataFrame:
    """Rows whose counterpart's path is among files."""
    return keep_prefix(rows, files.select(F.col(path).alias("__file")), counterpart, "__file")


def required_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, what: str) -> DataFrame:
    """The inner join of left_key to right_key's rows; a left row without one fails the query."""
    r = right.withColumn("__there", F.lit(True)).withColumnRenamed(right_key, "__key")
    out = left.join(r, F.col(left_key) == F.col("__key"), "left")
    guard = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit(f"no {what} for "), F.col(left_key).cast("string"))).cast("boolean")).otherwise(True)
    return out.where(guard).drop("__there", "__key")


def rebuilt_metadata(files: DataFrame, log: DataFrame, key: str, duration: str, measure: Column) -> DataFrame:
    """files (key, and what measure needs) with the log's duration, else a measured one."""
    return files.join(log.select(key, F.col(duration).alias("__log")), key, "left").withColumn(duration, F.coalesce("__log", measure)).drop("__log")


def segment_summary(segments: DataFrame, rows: DataFrame, key: str, dur: str) -> DataFrame:
    """One row: segments whose clip is there, clips they cover, their hours, segments without a clip,
    and the share of clips without a segment."""
    r = rows.select(key).distinct().withColumn("__there", F.lit(True))
    met = segments.select(key, dur).join(r, key, "full_outer")
    matched = F.col("__there") & F.col(dur).isNotNull()
    out = met.agg(
        F.count(F.when(matched, 1)).alias("segments"),
        F.count_distinct(F.when(matched, F.col(key))).alias("clips"),
        (F.coalesce(F.sum(F.when(matched, F.col(dur))), F.lit(0.0)) / 3600).alias("hours"),
        F.count(F.when(F.col("__there").isNull(), 1)).alias("missed"),
        F.count(F.when(F.col(dur).isNull(), 1)).alias("uncovered"),
    )
    return out.withColumn("uncovered_share", F.when(F.col("clips") + F.col("uncovered") > 0, F.col("uncovered") / (F.col("clips") + F.col("uncovered"))).otherwise(0.0))
