"""Exact duplicates by two passes over a blocked Bloom filter, in DataFrame functions only."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, id_text, materialize, small, table, without

#: Filter bits a row: with two bits a row, about one unrepeated row in a hundred is suspected, however
#: many rows there are. Of the filter, words that hold a repeated cell are kept; MAX_WORDS of them, 16
#: bytes each, are broadcast at once. More of them are tested range after range.
BITS_PER_ROW, MAX_WORDS = 16, 1 << 20
#: Groups of about 90 bytes that may be broadcast.
GROUPS_BOUND = 200_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Pass 1 hashes every text to two bits of one 64-bit filter word and keeps the bits that
    more than one row sets; what moves is one cell of 16 bytes a distinct hash and task. Pass 2
    tests each row against that filter: a row whose bits were set once has no equal and goes straight
    through; only (doc_id, digest) of suspected rows shuffle, never a text, and their SHA-256 digests
    decide. The filter has as many words as the rows need; it is broadcast in ranges of at most
    max_words words with repeats, and rows written by range meet their own range only. A
    false suspicion costs a shuffled row and never changes a result.

    Null texts equal empty ones. Of equal texts the largest doc_id stays; a null doc_id is
    smaller than any other. Rows repeated with id and text are all counted and all marked
    kept. Texts of any length are hashed whole. An empty table gives no rows; other columns, whatever
    their names, stay behind.
    """
    marked = suspects_marked(docs, id_col, text_col, max_words)
    alone = marked.where("not suspect").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    suspects = marked.where("suspect").select("doc_id", "text_sha256")
    groups = materialize(suspects.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    again = suspects.join(small(groups, groups.count(), GROUPS_BOUND), "text_sha256")
    return alone.unionByName(again).select(
        "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256"
    )


def suspects_marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, text_sha256, suspect (could another row have the same text?) of every row."""
    base = id_text(docs, id_col, text_col)
    digits = max(10, math.ceil(math.log2(max(1, docs.count()) * BITS_PER_ROW / 64)))
    h = F.xxhash64("text")
    bit = lambda shift: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {shift}) & 63 AS INT))")
    hashed = base.select("doc_id", "text", h.alias("h"))
    cell = [F.expr(f"h & {(1 << min(digits, 50)) - 1}L").alias("w"), bit(52).bitwiseOR(bit(58)).alias("bits")]

    seen = hashed.select(*cell).groupBy("w", "bits").agg(F.count("*").alias("n"))
    repeated = materialize(seen.where("n > 1").groupBy("w").agg(F.bit_or("bits").alias("again")))
    rows = hashed.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), *cell)

    def tested(rows: DataFrame, words: DataFrame) -> DataFrame:
        said = F.expr("coalesce(again & bits = bits, false)").alias("suspect")
        return rows.join(F.broadcast(words), "w", "left").select("doc_id", "text_sha256", said)

    n = repeated.count()
    if n <= max_words:
        marked = materialize(tested(rows, repeated))
        discard(repeated)
        return marked
    # words are spread evenly by the hash; twice as many ranges leave room for chance
    ranges = 1 << math.ceil(math.log2(2 * n / max_words))
    at = (F.col("w") % ranges).cast("int").alias("range")
    held = materialize(rows.select("*", at), by="range")
    parts = []
    for k in range(ranges):
        parts.append(materialize(tested(held.where(F.col("range") == k).drop("range"), repeated.where(at == k))))
    discard(repeated, held)
    return functools.reduce(DataFrame.unionByName, parts)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all columns, one row of each group of equal texts: that of the largest id. Rows
    repeated with id and text keep one of them. Only ids and digests of rows to go are moved,
    unless they are too many to be broadcast."""
    made = materialize(exact_dedup(docs, id_col, text_col))
    id_, sha, n = fresh(docs, "id", "sha", "n")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    name = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit("")).alias(id_)
    keyed = docs.withColumns({id_: name(id_col), sha: digest})
    key = [id_, sha]
    gone = made.where("not kept").select(name("doc_id"), F.col("text_sha256").alias(sha))
    twice = made.where("kept and group_size > 1").groupBy(name("doc_id"), F.col("text_sha256").alias(sha)).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(*key)
    left = without(keyed, gone, key)
    if k := twice.count():
        again = left.join(small(twice, k), key, "left_semi").dropDuplicates(key)
        left = without(left, twice, key).unionByName(again)
    return left.select(*docs.columns)


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
