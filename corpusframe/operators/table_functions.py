"""Functions of tables, for SQL: windows over clips, spans of words."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .segments import EDGE, EDGE_GAP, LONGEST, MAX_WORDS, PAD, SHORTEST


def _table(argument: AnalyzeArgument) -> T.StructType:
    if not argument.isTable:
        raise ValueError("the first argument must be a table: TABLE(name) or TABLE(SELECT ...)")
    return argument.dataType


def _named(argument: AnalyzeArgument, table: T.StructType, what: str) -> list[str]:
    """The columns that a constant text names, with commas between them."""
    if not argument.isConstantExpression or not isinstance(argument.value, str):
        raise ValueError(f"{what} must be a constant text")
    names = [n.strip() for n in argument.value.split(",")]
    if missing := [n for n in names if n not in table.names]:
        raise ValueError(f"{what}: the table has no column {', '.join(missing)}")
    return names


class SegmentWindows:
    """segment_windows(TABLE(clips), 'duration', length, hop, shortest): the table's columns and one row
    for each window of a clip, start_s and dur_s, as segments.windows() has them. A null duration
    gives no window."""

    @staticmethod
    def analyze(clips: AnalyzeArgument, duration: AnalyzeArgument, length: AnalyzeArgument, hop: AnalyzeArgument, shortest: AnalyzeArgument) -> AnalyzeResult:
        table = _table(clips)
        _named(duration, table, "duration")
        if hop.value is not None and float(hop.value) <= 0:
            raise ValueError("hop must be more than 0")
        return AnalyzeResult(T.StructType([*table.fields, T.StructField("start_s", T.DoubleType()), T.StructField("dur_s", T.DoubleType())]))

    def eval(self, clip: Row, duration: str, length: float, hop: float, shortest: float) -> Iterator[tuple]:
        d, length, hop = clip[duration], float(length), float(hop)
        if d is None or d < shortest:
            return
        d = float(d)
        if d <= length:
            yield (*clip, 0.0, round(d, 3))
            return
        n = math.floor((d + 1e-6 - length) / hop) + 1
        for k in range(max(n, 1)):
            yield (*clip, round(k * hop, 3), round(length, 3))
        if (left := d - n * hop) >= shortest:
            yield (*clip, round(n * hop, 3), round(left, 3))


class WordSpans:
    """word_spans(TABLE(words), 'clip columns', 'place', 'duration'): for each clip, the runs of its
    usable words whose padded duration is that of a short clip, as segments.word_spans() has them:
    the clip columns, i, j, nw, t0, t1, gap, span_text. words holds one row a word: w, start, end,
    maybe aligned.

    Spark brings a clip's words together, in order of place, as this function asks it to. A clip is
    read as a stream: MAX_WORDS + 2 words are held, however long it is, and HELD spans or a few more, as
    Spark takes what each word gives as a message of its own."""

    HELD = 256

    @staticmethod
    def analyze(words: AnalyzeArgument, clip: AnalyzeArgument, place: AnalyzeArgument, duration: AnalyzeArgument) -> AnalyzeResult:
        table = _table(words)
        keys = _named(clip, table, "clip columns")
        _named(duration, table, "duration")
        if missing := [n for n in ("w", "start", "end") if n not in table.names]:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        made = [("i", T.IntegerType()), ("j", T.IntegerType()), ("nw", T.IntegerType()), ("t0", T.DoubleType()), ("t1", T.DoubleType()), ("gap", T.DoubleType()), ("span_text", T.StringType())]
        return AnalyzeResult(
            T.StructType([*[table[k] for k in keys], *[T.StructField(n, t) for n, t in made]]),
            partitionBy=[PartitioningColumn(k) for k in keys],
            orderBy=[OrderingColumn(n) for n in _named(place, table, "place")],
        )

    def __init__(self):
        self.held: deque[tuple[str, float, float]] = deque(maxlen=MAX_WORDS + 2)
        self.made: list[tuple] = []
        self.n, self.places, self.end = 0, None, 0.0

    def eval(self, word: Row, clip: str, place: str, duration: str) -> Iterable[tuple]:
        if self.places is None:
            names = word.__fields__
            self.places = [names.index(n) for n in ("w", "start", "end", duration.strip())]
            self.aligned = names.index("aligned") if "aligned" in names else None
            self.key = tuple(word[k.strip()] for k in clip.split(","))
        at = tuple.__getitem__
        w, start, end, self.end = (at(word, k) for k in self.places)
        if (self.aligned is not None and at(word, self.aligned) is False) or w is None or start is None or end is None:
            return ()
        if end - start <= 1e-6 or not w.strip(" "):
            return ()
        self.held.append((w, start, end))
        self.n += 1
        if self.n > 1:
            self.spans(self.n - 2, len(self.held) - 2)
        return self.handed_on() if len(self.made) >= self.HELD else ()

    def terminate(self) -> Iterable[tuple]:
        if self.n:
            self.spans(self.n - 1, len(self.held) - 1)
        return self.handed_on()

    def handed_on(self) -> list[tuple]:
        made, self.made = self.made, []
        return made

    def spans(self, j: int, at: int) -> None:
        """Make the spans that end with word j, which is held at place `at`."""
        words, last, text = self.held, at + 1 == len(self.held), None
        _, _, end = words[at]
        if last:
            t1, right = min(self.end, end + EDGE), EDGE_GAP
        else:
            right = words[at + 1][1] - end
            t1 = min(words[at + 1][1], end + right / 2 + PAD)
        for back in range(min(MAX_WORDS, j + 1)):
            i, first = j - back, words[at - back]
            text = first[0] if text is None else f"{first[0]} {text}"
            if i == 0:
                t0, left = max(0.0, first[1] - EDGE), EDGE_GAP
            else:
                before = words[at - back - 1][2]
                left = first[1] - before
                t0 = max(before, before + left / 2 - PAD)
            if SHORTEST <= t1 - t0 <= LONGEST:
                self.made.append((*self.key, i, j, back + 1, t0, t1, min(left, right), text))


def register(spark: SparkSession) -> None:
    """Make the functions callable from the session's SQL, as segment_windows and word_spans."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("segment_windows", udtf(SegmentWindows))
    spark.udtf.register("word_spans", udtf(WordSpans))
