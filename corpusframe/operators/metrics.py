"""Error rates, classification measures, duration statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .percentiles import exact_percentiles, same_groups

from ..functions.edit import char_edits, utterance_rate, word_edits
from ..functions.text import fixed_places


def with_edits(df: DataFrame, ref: Column, hyp: Column) -> DataFrame:
    """df with edits, n_ref, n_hyp of two word-list columns. Pairs that are equal are not counted in
    Python, which sees nulls for them."""
    same = ref == hyp
    edits = F.when(same, 0).otherwise(word_edits(F.when(~same, ref), F.when(~same, hyp)))
    return df.withColumns({"edits": edits, "n_ref": F.size(ref), "n_hyp": F.size(hyp)})


def with_char_edits(df: DataFrame, ref: Column, hyp: Column) -> DataFrame:
    """df with edits and n_ref in characters of two normalized texts. Equal texts are not counted in Python."""
    same = ref == hyp
    edits = F.when(same, 0).otherwise(char_edits(F.when(~same, ref), F.when(~same, hyp)))
    return df.withColumns({"edits": edits, "n_ref": F.char_length(ref)})


def corpus_rate(df: DataFrame, group: str, keep_empty: bool = True) -> DataFrame:
    """Per group and pooled (group null): edits, n_ref, n, rate = edits / n_ref over rows whose
    reference is not empty. A group without such rows has rate 0 and n 0, or is left out."""
    used = F.col("n_ref") > 0
    out = df.groupingSets([[F.col(group)], []], F.col(group)).agg(
        F.coalesce(F.sum(F.when(used, F.col("edits"))), F.lit(0)).alias("edits"),
        F.coalesce(F.sum(F.when(used, F.col("n_ref"))), F.lit(0)).alias("units"),
        F.count(F.when(used, True)).alias("n"),
        F.grouping(group).alias("pooled"),
    )
    out = out.withColumn("rate", F.when(F.col("units") > 0, F.col("edits") / F.col("units")).otherwise(0.0))
    return out if keep_empty else out.where("n > 0")


def macro_micro(rates: DataFrame) -> DataFrame:
    """One row: the plain mean of the groups' rates and the pooled rate, from corpus_rate."""
    return rates.agg(
        F.avg(F.when(F.col("pooled") == 0, F.col("rate"))).alias("macro"),
        F.max(F.when(F.col("pooled") == 1, F.col("rate"))).alias("micro"),
        F.max(F.when(F.col("pooled") == 1, F.col("n"))).alias("n"),
    )


def best_reference(df: DataFrame, keys: list[str], edits: str = "edits", n_ref: str = "n_ref", place: str = "place") -> DataFrame:
    """Of rows (keys, place, edits, n_ref), one per reference, the counts of the reference of the
    smallest rate, the first of equal ones; empty references don't count, none at all gives 0, 0."""
    rate = F.col(edits) / F.col(n_ref)
    pick = F.struct(rate.alias("rate"), F.col(place).alias("place"), F.col(edits).alias("e"), F.col(n_ref).alias("n"))
    got = df.groupBy(*keys).agg(F.min(F.when(F.col(n_ref) > 0, pick)).alias("m"))
    return got.select(*keys, F.coalesce("m.e", F.lit(0)).alias("best_edits"), F.coalesce("m.n", F.lit(0)).alias("best_n"))


def dev_report(df: DataFrame, domain: str, group: str, none: str = "_nondialect") -> DataFrame:
    """One row: mean utterance rate; macro over domains and over groups of corpus rates. Rows of
    no group count for the group macro only where no other group exists."""
    d = df.withColumns({"u": utterance_rate(F.col("edits"), F.col("n_ref"), F.col("n_hyp")), "__g": F.when(F.col(group) == "", none).otherwise(F.col(group))})
    used = F.col("n_ref") > 0
    # all sums by one reading: edits are long work and few rows come of them
    per = d.groupingSets([[domain], ["__g"], []], domain, "__g").agg(
        F.avg("u").alias("__u"),
        (F.sum(F.when(used, F.col("edits"))) / F.sum(F.when(used, F.col("n_ref")))).alias("__r"),
        F.grouping_id().alias("__of"),
    )
    rate = lambda of: F.when(F.col("__of") == of, F.col("__r"))
    return per.agg(
        F.max(F.when(F.col("__of") == 3, F.col("__u"))).alias("utterance_rate"),
        F.avg(rate(1)).alias("macro_domain"),
        F.coalesce(F.avg(F.when(F.col("__g") != none, rate(2))), F.avg(rate(2))).alias("macro_group"),
    )


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def classification(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: n, accuracy, error, macro precision, recall and F1 over the classes seen in truth
    or prediction; no rows give error 1."""
    c = confusion(df, truth, predicted).where("truth is not null and predicted is not null")
    sides = c.select(F.col("truth").alias("k"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("truth") != F.col("predicted"), F.col("n")).otherwise(0).alias("fn"))
    sides = sides.unionByName(c.where("truth <> predicted").select(F.col("predicted").alias("k"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("long").alias("fn")))
    k = sides.groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    m = k.agg(F.avg(p).alias("macro_precision"), F.avg(r).alias("macro_recall"), F.avg(f).alias("macro_f1"), F.coalesce(F.sum("tp"), F.lit(0)).alias("hit"), F.coalesce(F.sum(F.col("tp") + F.col("fn")), F.lit(0)).alias("n"))
    acc = F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(0.0)
    return m.select("n", acc.alias("accuracy"), (1 - acc).alias("error"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1")])


def expected_risk(df: DataFrame, key: str, log_prob: str, rate: str) -> DataFrame:
    """Per utterance's list of hypotheses: their error rates weighted by the softmax of their log
    probabilities, less the rates' mean."""
    top = df.groupBy(key).agg(F.max(log_prob).alias("top"), F.avg(rate).alias("mean"))
    w = df.join(top, key).withColumn("w", F.exp(F.col(log_prob) - F.col("top")))
    return w.groupBy(key).agg((F.sum(F.col("w") * (F.col(rate) - F.col("mean"))) / F.sum("w")).alias("risk"))


def duration_stats(df: DataFrame, group: str, total: Column, speech: Column) -> DataFrame:
    """Per group: n, hours, speech hours, share of speech (ratio of sums), mean and median of the
    clips' shares in percent."""
    share = 100 * speech / total
    sums = df.groupBy(group).agg(
        F.count("*").alias("n"),
        (F.sum(total) / 3600).alias("total_h"),
        (F.sum(speech) / 3600).alias("speech_h"),
        (100 * F.sum(speech) / F.sum(total)).alias("speech_pct"),
        F.avg(share).alias("mean_pct"),
    )
    medians = exact_percentiles(df, [group], share, [0.5]).alias("r")
    return sums.alias("l").join(medians, same_groups([group])).select("l.*", F.get("r.percentiles", F.lit(0)).alias("median_pct"))


def ratio_histogram(df: DataFrame, ratio: Column, bins: int = 39) -> DataFrame:
    """Counts of [0, 1] in equal bins, the last one closed."""
    at = F.least(F.floor(ratio * bins), F.lit(bins - 1)).cast("int")
    return df.where((ratio >= 0) & (ratio <= 1)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def percentile_gate(df: DataFrame, group: str, score: str, share: float) -> DataFrame:
    """Rows whose score reaches their group's percentile (linear interpolation)."""
    gate = exact_percentiles(df, [group], F.col(score), [share]).select(group, F.get("percentiles", F.lit(0)).alias("gate"))
    return df.join(gate, group).where(F.col(score) >= F.col("gate"))


def duration_summary(df: DataFrame, value: str) -> DataFrame:
    """One row: n, min, upper median, max, mean. The upper median is the value at place n div 2 of
    the sorted values: found by counting values, so that no task holds them all."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    total = counts.agg(F.sum("k").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"))
    n = total.select("n")
    coarse = counts.withColumn("b", F.floor(F.col("v")))
    per = coarse.groupBy("b").agg(F.sum("k").alias("s"))
    before = per.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hit = before.crossJoin(F.broadcast(n)).where("before <= n div 2 and before + s > n div 2").select("b", "before", "n")
    w = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    at = coarse.join(F.broadcast(hit), "b").withColumn("upto", F.col("before") + F.sum("k").over(w)).where("upto > n div 2").agg(F.min("v").alias("upper_median"))
    return total.crossJoin(at).select("n", "min", "upper_median", "max", "mean")


def class_counts(df: DataFrame, label: str, classes: list) -> DataFrame:
    """(label, n) of every class, 0 for those that no row has; classes are few."""
    spark = df.sparkSession
    all_ = spark.createDataFrame([(c,) for c in classes], [label])
    return F.broadcast(all_).join(df.groupBy(label).agg(F.count("*").alias("n")), label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def top_values(df: DataFrame, value: str, k: int = 3) -> DataFrame:
    """The k most frequent values (errors, say) with their counts, ties by value; nulls and '' don't
    count."""
    return df.where((F.col(value) != "") & F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), value).limit(k)


def coverage(df: DataFrame, cue: str) -> DataFrame:
    """One row: rows, and the share of them whose cue is neither null nor ''."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.avg(F.coalesce(F.col(cue) != "", F.lit(False)).cast("double")), F.lit(0.0)).alias("share"))


def hour_accounts(df: DataFrame, group: str, source: str, seconds: str, sources: list[str]) -> DataFrame:
    """Per group the hours of each source and of all, largest total first."""
    hours = [(F.coalesce(F.sum(F.when(F.col(source) == s, F.col(seconds))), F.lit(0.0)) / 3600).alias(f"{s}_h") for s in sources]
    return df.groupBy(group).agg(*hours, (F.sum(seconds) / 3600).alias("total_h")).orderBy(F.col("total_h").desc(), group)


def by_total(df: DataFrame, group: str, amount: str) -> DataFrame:
    """Groups by falling total of amount, ties by name."""
    return df.groupBy(group).agg(F.sum(amount).alias("total")).orderBy(F.col("total").desc(), group)


def problems(df: DataFrame, total: str, speech: str, reason: Column, id_: str = "id") -> DataFrame:
    """Flagged clips (their columns, ratio, reason), the lowest ratio first: clips that failed (a
    negative duration) have ratio -1 and reason decode_fail."""
    failed = (F.col(total) < 0) | (F.col(speech) < 0)
    ratio = F.when(failed, -1.0).otherwise(F.when(F.col(total) > 0, F.col(speech) / F.col(total)).otherwise(0.0))
    rows = df.withColumn("speech_ratio", ratio).withColumn("reason", F.when(failed, "decode_fail").otherwise(reason))
    return rows.where("reason is not null").orderBy("speech_ratio", id_)


def problem_summary(flagged: DataFrame, clips: DataFrame) -> DataFrame:
    """(reason, n, share of all clips) and the same for all reasons together (reason null)."""
    total = clips.agg(F.count("*").alias("__all"))
    per = flagged.groupingSets([["reason"], []], "reason").agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(total)).select("reason", "n", F.when(F.col("__all") > 0, F.col("n") / F.col("__all")).otherwise(0.0).alias("share"))


def bank_summary(voices: DataFrame, clips: DataFrame, group: str, min_dur: float = 30.0, long: float = 60.0) -> DataFrame:
    """Per group and for all (group null): clips, hours, voices of min_dur and of long seconds or more
    and their minutes. clips has (group, dur), voices (group, dur)."""
    c = clips.groupingSets([[group], []], group).agg(F.count("*").alias("clips"), (F.sum("dur") / 3600).alias("hours"))
    ok, more = F.col("dur") >= min_dur, F.col("dur") >= long
    v = voices.groupingSets([[group], []], group).agg(
        F.count(F.when(more, 1)).alias("long_voices"),
        (F.coalesce(F.sum(F.when(more, F.col("dur"))), F.lit(0.0)) / 60).alias("long_minutes"),
        F.count(F.when(ok, 1)).alias("voices"),
        (F.coalesce(F.sum(F.when(ok, F.col("dur"))), F.lit(0.0)) / 60).alias("minutes"),
    )
    v = v.withColumnRenamed(group, "__g")
    out = c.join(v, c[group].eqNullSafe(v["__g"]), "left").drop("__g")
    return out.fillna(0, ["long_voices", "long_minutes", "voices", "minutes"])


def named_values(**values: Column) -> Column:
    """One line of 'name=value' with two decimals for doubles, two spaces apart; counts as they are."""
    parts = [F.concat(F.lit(f"{k}="), v) for k, v in values.items()]
    return F.concat_ws("  ", *parts)


def two_decimals(x: Column) -> Column:
    return fixed_places(2)(x.cast("double"))
