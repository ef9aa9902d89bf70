"""Where queries register themselves, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name; sql is what DuckDB runs for the same rows."""

    def keep(f: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


#: Fragments of SQL that several queries share.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
DIACRITICS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
PUNCTUATION = r"[\x{060C}\x{061B}\x{061F}\x{066A}-\x{066D}\x{06D4}\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]"


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{BLANK}'), lambda t: t <> '')"


def sql_normalized(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '{DIACRITICS}', '', 'g'), '{PUNCTUATION}', ' ', 'g'), '{BLANK}', ' ', 'g'))"


#: Sentences of all documents as utterances: (doc_id, lang, source, pos, ref, hyp) with ref the
#: normalized words and hyp the same without some words and with others replaced.
SENTENCES = f"""
split AS (SELECT doc_id, lang, source, unnest(string_split_regex(text, '[.\\n]')) AS s, generate_subscripts(string_split_regex(text, '[.\\n]'), 1) AS pos FROM documents),
refs AS (SELECT doc_id, lang, source, pos, {sql_tokens(sql_normalized("s"))} AS ref FROM split),
pairs AS (SELECT *, list_filter([CASE WHEN (i + doc_id + pos) % 7 = 3 THEN NULL WHEN (i + doc_id + pos) % 11 = 5 THEN 'unk' ELSE ref[i] END FOR i IN range(1, len(ref) + 1)], lambda x: x IS NOT NULL) AS hyp FROM refs)
"""


def sql_edits(a: str, b: str) -> str:
    """Word edit distance: words of the pair as single-byte characters, then levenshtein."""
    d = f"list_distinct(list_concat({a}, {b}))"
    spell = lambda x: f"array_to_string(list_transform({x}, lambda w: chr(list_position({d}, w)::INT)), '')"
    return f"levenshtein({spell(a)}, {spell(b)})"
