"""Text rules as Column expressions: normalizers, folds, tokens, prefixes, path-derived fields."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes and names that results depend on.
DIACRITICS = "[ؐ-ًؚ-ٰٟۖ-ۭ]"
PUNCTUATION = "[،؛؟٪-٭۔\\x21-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7e]"
UNKNOWN_MARK = "< ⁇ n ⁇ >"
COUNTRIES = ("Algeria", "Egypt", "Jordan", "Mauritania", "Morocco", "Palestine", "UAE", "Yemen")
EMPHATIC = "صضطظقعحخ"
TEXT_MARK = "<asr_text>"


def _any_of(low: list[int], high: str) -> str:
    """A pattern for one letter: code points under 256 one by one, which Java finds in a table, and a class of
    others from U+0600 to U+3000, whose ranges it tries for letters of that range only."""
    return f"[{''.join(f'\\x{c:02x}' for c in low)}[\\u0600-\\u3000&&[{high}]]]"


#: White space as Python's str.split() takes it, but for the space itself; Java's \\s alone misses some of it.
LOW_BLANKS, HIGH_BLANKS = [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0], "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BLANK = _any_of(LOW_BLANKS, HIGH_BLANKS)
#: PUNCTUATION, or white space.
BREAK = _any_of([*LOW_BLANKS, *range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)], "،؛؟٪-٭۔" + HIGH_BLANKS)

#: The punctuation that Rule B takes out, or white space.
TRAINING_BREAK = _any_of([*LOW_BLANKS, *map(ord, ",.;@#?!&$_[]()")], "،؛؟ـ" + HIGH_BLANKS)


def _between_spaces(text: Column) -> Column:
    """Words between spaces. A single letter to split at is found without a pattern, which Spark would
    compile for every row."""
    return F.array_remove(F.split(text, " "), "")


def tokens(text: Column) -> Column:
    """Words between white space, none of them empty."""
    return _between_spaces(F.regexp_replace(text, BLANK, " "))


def one_line(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def scoring_words(text: Column) -> Column:
    """The words of normalize_scoring(), by one split."""
    return _between_spaces(F.regexp_replace(F.regexp_replace(text, DIACRITICS, ""), BREAK, " "))


def normalize_scoring(text: Column) -> Column:
    """Rule A: diacritics go, punctuation becomes a space, white space collapses; letters stay."""
    return F.array_join(scoring_words(text), " ")


def training_words(text: Column, asmo: bool = False, remove_punctuation: bool = True) -> Column:
    """The words of normalize_training(), by one split. Steps for tags are taken by texts that have a bracket,
    and letters are replaced one by one, which leaves a text without them as it is."""
    x = F.replace(F.regexp_replace(text, "(?U)<\\w+>", ""), F.lit(UNKNOWN_MARK), F.lit(""))
    x = F.replace(F.replace(x, F.lit("<"), F.lit(" <")), F.lit(">"), F.lit("> "))
    parts = F.split(F.replace(x, F.lit("▁"), F.lit(" ")), " ", -1)
    x = F.array_join(F.filter(parts, lambda t: ~(t.startswith("<") | t.endswith(">"))), " ")
    x = F.when(F.contains(text, F.lit("<")) | F.contains(text, F.lit(">")), x).otherwise(F.replace(text, F.lit("▁"), F.lit(" ")))
    if asmo:
        x = F.translate(x, "iIEBC", "jgGGG")
    else:
        for old, new in zip("ىةإأآ", "يهااا", strict=True):
            x = F.replace(x, F.lit(old), F.lit(new))
        x = F.replace(F.lower(x), F.lit("سين"), F.lit("س"))
        x = F.replace(x, F.lit("جيم"), F.lit("ج"))
    return _between_spaces(F.regexp_replace(x, TRAINING_BREAK if remove_punctuation else BLANK, " "))


def normalize_training(text: Column, asmo: bool = False, remove_punctuation: bool = True) -> Column:
    """Rule B: tags and bracketed tokens go, letters fold and become lower case (or the ASMO
    substitutions apply instead), two letter names shrink, punctuation becomes a space."""
    return F.array_join(training_words(text, asmo, remove_punctuation), " ")


def fold_letters(text: Column) -> Column:
    """Rule C: letters that are spelled in several ways become one; the ligature becomes two."""
    x = F.translate(text, "ىةإأآ", "يهااا")
    return F.replace(x, F.lit("ﻻ"), F.lit("لا"))


def normalize_letters(text: Column) -> Column:
    """Rule D: folds as well as hamza carriers, and only letters stay."""
    x = F.regexp_replace(text, "[ً-ْٰـ]", "")
    x = F.translate(x, "أإآىةؤئ", "ااايهوي")
    return one_line(F.regexp_replace(x, "(?U)[^ء-ي\\s\\x1c-\\x1f]", " "))


def count_characters(text: Column, of: str = EMPHATIC) -> Column:
    """How many characters of text are among `of`."""
    return F.char_length(text) - F.char_length(F.translate(text, of, ""))


def after_first(text: Column, mark: str = TEXT_MARK) -> Column:
    """What follows the first mark; the whole text without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + len(mark))).otherwise(text)


def after_last(text: Column, mark: str = TEXT_MARK) -> Column:
    return F.substring_index(text, mark, -1)


def _name(path: Column) -> Column:
    """What follows the last slash: the rules below would try every letter of the folders first."""
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot begins no extension."""
    return F.regexp_extract(_name(path), "([^/]*?[^/.][^/]*?|\\.*[^/.]*)(\\.[^./]*)?$", 1)


def stem_simple(path: Column) -> Column:
    return F.regexp_extract(_name(path), "([^/]+?)(\\.[^./]*)?$", 1)


def _first_known(parts: Column, names: tuple[str, ...], any_case: bool) -> Column:
    key = (lambda p: F.lower(p)) if any_case else (lambda p: p)
    known = F.create_map(*[F.lit(x) for n in names for x in (n.lower() if any_case else n, n)])
    hit = F.filter(F.transform(parts, lambda p: known[key(p)]), lambda p: p.isNotNull())
    return F.coalesce(F.get(hit, F.lit(0)), F.lit(""))


def group_from_path(path: Column, anchor: str = "audio", names: tuple[str, ...] = COUNTRIES) -> Column:
    """The first path component after the last anchor component that is a known name, in any case."""
    parts = F.split(path, "/", -1)
    last = F.size(parts) - F.array_position(F.reverse(parts), anchor) + 1
    after = F.when(F.array_contains(parts, anchor), F.slice(parts, last + 1, F.size(parts))).otherwise(parts)
    return _first_known(after, names, True)


def group_from_path_exact(path: Column, anchor: str = "/audio/", names: tuple[str, ...] = COUNTRIES) -> Column:
    """The first component behind the last anchor text that is a known name as written."""
    return _first_known(F.split(F.substring_index(path, anchor, -1), "/", -1), names, False)


def group_of(explicit: list[Column], path: Column, names: tuple[str, ...] = COUNTRIES) -> Column:
    """The first explicit field that holds a known name, else the path's, else ''."""
    known = F.create_map(*[F.lit(x) for n in names for x in (n.lower(), n)])
    return F.coalesce(*[known[F.lower(F.trim(c))] for c in explicit], group_from_path(path, names=names))


def seconds_from_id(uid: Column) -> Column:
    """Duration from a suffix _<start>-<end> in hundredths of a second, else 0."""
    at = lambda i: F.regexp_extract(uid, "_(\\d+)-(\\d+)$", i)
    return F.when(at(1) != "", (at(2).cast("double") - at(1).cast("double")) / 100).otherwise(F.lit(0.0))


def fixed_places(n: int):
    """A function of a double column: its text with n decimals, from the exact binary value (which
    format_string rounds otherwise at ties); null for null and NaN."""

    @F.arrow_udf(T.StringType())
    def said(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None or v != v else f"{v:.{n}f}" for v in x.to_pylist()], pa.string())

    return said
