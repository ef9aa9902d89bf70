"""Edit distances between word lists, and their alignment, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_distance(a, b) -> int:
    """Edit distance of two sequences of hashable items. A column of the table of distances is held
    as two integers, whose bits say where it rises and where it falls, so one step takes a whole
    column; equal ends are skipped first."""
    end = min(len(a), len(b))
    k = 0
    while k < end and a[-1 - k] == b[-1 - k]:
        k += 1
    lead = 0
    while lead < end - k and a[lead] == b[lead]:
        lead += 1
    a, b = a[lead : len(a) - k], b[lead : len(b) - k]
    if not len(a) or not len(b):
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    mask, last = (1 << len(a)) - 1, 1 << len(a) - 1
    rises, falls, distance = mask, 0, len(a)
    for x in b:
        same = places.get(x, 0)
        level = same | falls
        across = ((same & rises) + rises ^ rises) | same
        up, down = falls | ~(across | rises) & mask, rises & across
        distance += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        rises, falls = (down | ~(level | up)) & mask, up & level
    return distance


def falling_bits(pivot: list, other: list) -> tuple[list[bytes], list[bytes]]:
    """The table of distances, pivot items down, other's across, by its falls alone. For each column
    from 0 on, bit i of the first says that the cell below row i is one less than the cell of row i;
    bit i of the second, that the cell of row i is one less than that of the column before. Both are
    found for a whole column at once, in integers as long as pivot."""
    places: dict = {}
    for i, x in enumerate(pivot):
        places[x] = places.get(x, 0) | 1 << i
    mask, size = (1 << len(pivot)) - 1, -(-len(pivot) // 8)
    rises, falls = mask, 0
    down_in, across_in = [falls.to_bytes(size, "little")], [bytes(size)]
    for x in other:
        same = places.get(x, 0)
        level = same | falls
        across = ((same & rises) + rises ^ rises) | same
        up, down = falls | ~(across | rises) & mask, rises & across
        up, down = up << 1 | 1, down << 1
        rises, falls = (down | ~(level | up)) & mask, up & level & mask
        down_in.append(falls.to_bytes(size, "little"))
        across_in.append((down & mask).to_bytes(size, "little"))
    return down_in, across_in


def align(pivot: list, other: list) -> list[int]:
    """For each pivot item the place of the aligned item of other, -1 where it has none; items of
    other between pivot items fall away. Of equal costs the path back goes diagonally first, then
    drops a pivot item, then one of other.

    Equal ends always pair up, and are not put in the table. The path needs two bits a cell: a
    neighbour that is one less than the diagonal one is the way to go, and only then."""
    k, end = 0, min(len(pivot), len(other))
    while k < end and pivot[-1 - k] == other[-1 - k]:
        k += 1
    i, j = len(pivot) - k, len(other) - k
    out = [-1] * i + list(range(j, j + k))
    if not i or not j:
        return out
    down, across = falling_bits(pivot[:i], other[:j])
    while i and j:
        at, bit = (i - 1) >> 3, 1 << (i - 1 & 7)
        if pivot[i - 1] == other[j - 1] or not (down[j - 1][at] & bit or across[j][at] & bit):
            i, j = i - 1, j - 1
            out[i] = j
        elif across[j][at] & bit:
            i -= 1
        else:
            j -= 1
    return out


def aligned_words(pivot: list[str], other: list[str]) -> list[str]:
    """For each pivot word the aligned word of other, '' where it has none."""
    return [other[k] if k >= 0 else "" for k in align(pivot, other)]


#: Pairs whose shorter side has more blocks of 64 items are counted one by one, in long integers; so are those of
#: lengths that few have: a step of words costs as much as one of long integers for so many pairs.
BLOCKS, FEWEST = 16, 12
#: Cells of the tables that a step holds for its pairs, and pairs of a step.
CELLS, PAIRS = 1 << 19, 4096


def within(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of so many items the items' rows and their places in them."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def _few_codes(a: np.ndarray, a_row: np.ndarray, b: np.ndarray, b_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Items as numbers from 0 that only need to be told apart within a row, and how many there are;
    where rows have fewer items of a than there are numbers, b's others are the last one."""
    n = int(max(a.max(initial=-1), b.max(initial=-1))) + 1
    if n <= 128:
        return a, b, n
    names, a = np.unique(a_row * n + a, return_inverse=True)
    first = np.searchsorted(names, np.arange(a_row[-1] + 1) * n)
    most = int(np.diff(np.r_[first, len(names)]).max())
    wanted = b_row * n + b
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return a - first[a_row], np.where(names[at] == wanted, at - first[b_row], most), most + 1


def _columns(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, blocks: int):
    """The tables of distances of many pairs at once, a's items down and b's across, rows by falling n
    and all of them of as many blocks: for each column (live, shifted) per block, live being the rows
    that have it, and shifted the words of bits (rises, falls) across and down: how the cell below
    differs from that of the column before, and each cell of the column from the one above it."""
    (a_row, a_at), (b_row, b_at), rows = within(m), within(n), len(m)
    a, b, few = _few_codes(a, a_row, b, b_row)
    same = np.zeros((blocks, rows * few), np.uint64)
    np.bitwise_or.at(same.reshape(-1), (a_at >> 6) * (rows * few) + a_row * few + a, np.uint64(1) << (a_at & 63).astype(np.uint64))
    codes = np.zeros((int(n[0]), rows), np.int64)
    codes[b_at, b_row] = b_row * few + b
    one, top = np.uint64(1), np.uint64(63)
    rises, falls = np.full((blocks, rows), ~np.uint64(0)), np.zeros((blocks, rows), np.uint64)
    lives = rows - np.searchsorted(n[::-1], np.arange(int(n[0])), "right")
    for column, live in enumerate(lives.tolist()):
        at = codes[column, :live]
        up_in, down_in = one, np.uint64(0)
        said = []
        for k in range(blocks):
            p, q = rises[k, :live], falls[k, :live]
            here = same[k].take(at)
            level = here | q
            if k:
                here |= down_in
            across = here & p
            across += p
            across ^= p
            across |= here
            down = p & across
            across |= p
            up = np.invert(across, out=across)
            up |= q
            if k < blocks - 1:
                up_out, down_out = up >> top, down >> top
            ends = up, down
            up, down = up << one, down << one
            up |= up_in
            if k:
                down |= down_in
            np.bitwise_and(up, level, out=q)
            level |= up
            np.invert(level, out=level)
            np.bitwise_or(level, down, out=p)
            if k < blocks - 1:
                up_in, down_in = up_out, down_out
            said.append((*ends, down))
        yield live, said, falls


def _by_blocks(blocks: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """(blocks, rows) to take together, and rows to take one by one."""
    together = [(k, rows) for k in range(1, BLOCKS + 1) if len(rows := np.flatnonzero(blocks == k)) >= FEWEST * k]
    alone = blocks > 0
    for _, rows in together:
        alone[rows] = False
    return together, np.flatnonzero(alone)


def _steps(rows: np.ndarray, m: np.ndarray, n: np.ndarray, cells: int):
    """rows in parts for _columns(), by falling n, whose tables have about so many cells."""
    rows = rows[np.argsort(-n[rows], kind="stable")]
    at = 0
    while at < len(rows):
        took = max(1, min(PAIRS, cells // int(n[rows[at]] + m[rows[at : at + PAIRS]].max() + 64)))
        yield rows[at : at + took]
        at += took


def _taken(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    row, at = within(size)
    return flat[start[row] + at]


def edit_distances(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edit distances of many pairs of sequences: a and b hold their items as numbers from 0, one row
    after the other, m and n the rows' lengths. Columns of edit_distance()'s table, whose steps are taken
    for thousands of pairs at once, in words of 64 bits."""
    a_start, b_start = np.cumsum(m) - m, np.cumsum(n) - n
    swap = m > n
    flat = np.concatenate([a, b])
    short, long_ = np.where(swap, b_start + len(a), a_start), np.where(swap, a_start, b_start + len(a))
    m, n = np.minimum(m, n), np.maximum(m, n)
    out = n.copy()
    together, alone = _by_blocks(-(-m // 64))
    for r in alone:
        out[r] = edit_distance(flat[short[r] : short[r] + m[r]].tolist(), flat[long_[r] : long_[r] + n[r]].tolist())
    for k, rows in together:
        for part in _steps(rows, m, n, CELLS):
            size, length = m[part], n[part]
            last, distance = ((size - 1) & 63).astype(np.uint64), size.astype(np.uint64)
            for live, said, _ in _columns(_taken(flat, short[part], size), size, _taken(flat, long_[part], length), length, k):
                up, down, _ = said[-1]
                distance[:live] += up >> last[:live] & np.uint64(1)
                distance[:live] -= down >> last[:live] & np.uint64(1)
            out[part] = distance.astype(np.int64)
    return out


def aligned_places(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """align() of many pairs, given as in edit_distances(): for each item of a the place of b's aligned
    item in its row, or -1. Columns are those of thousands of pairs, and so are the steps of their paths back."""
    a_start, b_start = np.cumsum(m) - m, np.cumsum(n) - n
    out = np.full(len(a), -1)
    together, alone = _by_blocks(np.where(n > 0, -(-m // 64), 0))
    for r in alone:
        out[a_start[r] : a_start[r] + m[r]] = align(a[a_start[r] : a_start[r] + m[r]].tolist(), b[b_start[r] : b_start[r] + n[r]].tolist())
    for k, rows in together:
        for part in _steps(rows, m, n, CELLS // k):
            size, length, width = m[part], n[part], len(part)
            down, across = np.zeros((2, int(length[0]) + 1, k, width), np.uint64)
            own, other = _taken(a, a_start[part], size), _taken(b, b_start[part], length)
            for column, (live, said, falls) in enumerate(_columns(own, size, other, length, k), 1):
                down[column, :, :live] = falls[:, :live]
                for j, (_, _, shifted) in enumerate(said):
                    across[column, j, :live] = shifted
            down, across = down.reshape(-1), across.reshape(-1)
            pair, i, j = np.arange(width), size.copy(), length.copy()
            while len(pair):
                bit = (i - 1 & 63).astype(np.uint64)
                cell = (j * k + (i - 1 >> 6)) * width + pair
                left = across[cell] >> bit & np.uint64(1) == 1
                # the column's own falls are those of the column before
                right = down[cell - k * width] >> bit & np.uint64(1) == 1
                x, y = a_start[part[pair]] + i - 1, b_start[part[pair]] + j - 1
                diagonal = (a[x] == b[y]) | ~(left | right)
                out[x[diagonal]] = j[diagonal] - 1
                i, j = i - (diagonal | left), j - (diagonal | ~left)
                on = (i > 0) & (j > 0)
                pair, i, j = pair[on], i[on], j[on]
    return out


def numbered_words(*lists: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], pa.Array]:
    """Columns of word lists as numbers, one row after the other, with the rows' lengths, and the words
    that the numbers stand for; equal words of any of them have equal numbers, '' is among them."""
    arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in lists]
    flat = [pc.list_flatten(a).cast(pa.string()) for a in arrays]
    words = pc.dictionary_encode(pa.concat_arrays([*flat, pa.array([""])]), null_encoding="encode")
    numbers = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum([len(f) for f in flat])
    sizes = [pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64) for a in arrays]
    return list(zip(np.split(numbers, ends)[:-1], sizes, strict=True)), words.dictionary


def numbered_letters(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of texts as code points, one row after the other, and the rows' lengths."""
    text = pc.fill_null((text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text).cast(pa.string()), "")
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
    whole = bytes(memoryview(text.buffers()[2])[ends[0] : ends[-1]]) if ends[-1] > ends[0] else b""
    return np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32).astype(np.int64), pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)


def parts_of(size: np.ndarray, most: int) -> list[int]:
    """Where parts of rows end that have `most` items together, or are one row."""
    total = np.cumsum(size)
    ends, at = [], 0
    while at < len(size):
        at = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        ends.append(at)
    return ends


def in_parts(size: np.ndarray, columns: list[pa.Array], most: int, made: Callable[..., pa.Array], kind: pa.DataType) -> pa.Array:
    """made() of columns' rows, in parts of bounded size."""
    out, at = [], 0
    for end in parts_of(size, most):
        out.append(made(*(c.slice(at, end - at) for c in columns)))
        at = end
    return pa.concat_arrays(out) if out else pa.array([], kind)


#: Words, or letters, that a Python worker compares at once.
ITEMS = 1_000_000


def _distances(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], ref: pa.Array, hyp: pa.Array) -> pa.Array:
    there = pc.and_(ref.is_valid(), hyp.is_valid()).to_numpy(zero_copy_only=False)
    return pa.array(edit_distances(*a, *b).astype(np.int32), mask=~there)


@F.arrow_udf(T.IntegerType())
def word_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Word edit distance of two lists of any length; null if either is null."""

    def made(r: pa.Array, h: pa.Array) -> pa.Array:
        (a, b), _ = numbered_words(r, h)
        return _distances(a, b, r, h)

    size = pc.add(pc.fill_null(pc.list_value_length(ref), 0), pc.fill_null(pc.list_value_length(hyp), 0))
    return in_parts(size.to_numpy(zero_copy_only=False), [ref, hyp], ITEMS, made, pa.int32())


@F.arrow_udf(T.IntegerType())
def char_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Edit distance in characters; spaces count. Null if either is null."""

    def made(r: pa.Array, h: pa.Array) -> pa.Array:
        a, b = numbered_letters(r), numbered_letters(h)
        codes = np.concatenate([a[0], b[0]])
        used = np.zeros(int(codes.max(initial=0)) + 1, bool)
        used[codes] = True
        codes = (np.cumsum(used) - 1)[codes]
        return _distances((codes[: len(a[0])], a[1]), (codes[len(a[0]) :], b[1]), r, h)

    size = pc.add(pc.fill_null(pc.binary_length(ref), 0), pc.fill_null(pc.binary_length(hyp), 0))
    return in_parts(size.to_numpy(zero_copy_only=False), [ref, hyp], ITEMS, made, pa.int32())


def utterance_rate(edits: Column, n_ref: Column, n_hyp: Column) -> Column:
    """Error rate of one utterance; with an empty reference 0 for an empty hypothesis, else 1."""
    return F.when(n_ref == 0, F.when(n_hyp == 0, 0.0).otherwise(1.0)).otherwise(edits / n_ref)
