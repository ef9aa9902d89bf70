"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_texts, table

#: Pre-tokens whose counts a worker remembers; then the older half is dropped.
CACHE = 400_000
#: Rounds over whole pre-tokens, enough for nearly all words.
ROUNDS = 48
LIMIT = 1024


def shown_bytes() -> list[str]:
    """The character that stands for each byte in byte-level files: itself where it shows, else one
    from 256 on."""
    odd = [c for c in range(256) if not (33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255)]
    return [chr(256 + odd.index(c)) if c in odd else chr(c) for c in range(256)]


class RankMerger:
    """Byte-level BPE counts of many pre-tokens at once.

    The symbols of all pre-tokens lie in one array; beside each stand its pre-token's number and
    the rank of the pair that it begins. In every round each pre-token merges its own lowest-ranked
    pair, at all its places from the left without overlap, simultaneously with all others, and
    only ranks round a merge are looked up again. A pair made by a merge always ranks after that
    merge, so this equals merging one pair at a time.

    Finding the lowest rank reads a pre-token's symbols. The few pre-tokens that are not done after
    ROUNDS rounds go on with their places held by rank (finish), in time near linear in the length."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.result = keys[order], order.astype(np.int64), made
        self.byte_id = np.array([vocab[s] for s in shown_bytes()], dtype=np.int64)
        self.special = [t["content"] for t in said["added_tokens"]]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; as many as there are merges for no merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.rank))

    @staticmethod
    def apart(places: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Of places in order, of which follows says whether each overlaps the one before: every
        second one of a run."""
        run = np.flatnonzero(~follows)
        nth = np.arange(len(places)) - run[np.searchsorted(run, np.arange(len(places)), side="right") - 1]
        return places[nth % 2 == 0]

    def counts(self, words: list[bytes]) -> np.ndarray:
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        out = lengths.copy()
        ids = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(words)), lengths)
        none = len(self.rank)
        rank = np.full(len(ids), none)
        rank[:-1] = np.where(seq[:-1] == seq[1:], self.ranks(ids[:-1], ids[1:]), none)
        for _ in range(ROUNDS):
            if not len(ids):
                return out
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(ids)])
            places = np.flatnonzero((rank == np.repeat(best, size)) & (rank < none))
            places = self.apart(places, np.diff(places, prepend=-2) == 1)
            ids[places] = self.result[rank[places]]
            out -= np.bincount(seq[places], minlength=len(out))
            stay = np.repeat(best < none, size)
            stay[places + 1] = False
            now = (np.cumsum(stay) - 1)[places]
            ids, seq, rank = ids[stay], seq[stay], rank[stay]
            near = np.unique(np.r_[now, now - 1])
            near = near[near >= 0]
            rank[near] = none
            near = near[near + 1 < len(ids)]
            near = near[seq[near] == seq[near + 1]]
            rank[near] = self.ranks(ids[near], ids[near + 1])
        for k in np.unique(seq):
            out[k] = self.finish(ids[seq == k])
        return out

    def finish(self, ids: np.ndarray) -> int:
        """The number of symbols left of one pre-token. Symbols are linked, so that none moves; places
        wait by the rank of their pair, and a place whose pair has changed meanwhile is passed over."""
        n, none = len(ids), len(self.rank)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.r_[self.ranks(ids[:-1], ids[1:]), none]
        left, waiting, turn = n, [], 0

        def wait(places: np.ndarray) -> None:
            nonlocal turn
            places = places[np.argsort(rank[places], kind="stable")]
            places = places[: np.searchsorted(rank[places], none)]
            for group in np.split(places, np.flatnonzero(np.diff(rank[places])) + 1) if len(places) else ():
                turn += 1
                heapq.heappush(waiting, (int(rank[group[0]]), turn, group))

        wait(np.arange(n))
        while waiting:
            lowest, _, group = heapq.heappop(waiting)
            groups = [group]
            while waiting and waiting[0][0] == lowest:
                groups.append(heapq.heappop(waiting)[2])
            places = np.unique(np.concatenate(groups)) if len(groups) > 1 else group
            places = places[rank[places] == lowest]
            if not len(places):
                continue
            places = self.apart(places, np.r_[False, after[places[:-1]] == places[1:]])
            gone = after[places]
            ids[places], rank[gone] = self.result[lowest], none
            after[places] = end = after[gone]
            inside = end < n
            before[end[inside]] = places[inside]
            left -= len(places)
            near = np.unique(np.r_[places, before[places]])
            near = near[near >= 0]
            rank[near] = none
            near = near[after[near] < n]
            rank[near] = self.ranks(ids[near], ids[after[near]])
            wait(near)
        return left


def counter(path: str, pattern: str, cache: int = CACHE):
    merger = RankMerger(path)
    find = regex.compile(pattern).findall
    special = merger.special
    young: dict[str, int] = {}

    def split(text: str) -> tuple[list[str], int]:
        for s in special:
            if s in text:
                parts = regex.split("|".join(map(regex.escape, special)), text)
                return [w for p in parts for w in find(p)], len(parts) - 1
        return find(text), 0

    def work(ids: list, texts: list[str]) -> list:
        nonlocal young
        cut = [split(t) for t in texts]
        new = list(set().union(*(w for w, _ in cut)).difference(young))
        if new:
            if len(young) + len(new) > cache:
                young = dict(list(young.items())[len(young) // 2 :]) if len(new) < cache // 2 else {}
                new = list(set().union(*(w for w, _ in cut)).difference(young))
            young.update(zip(new, merger.counts([w.encode("utf-8") for w in new]).tolist(), strict=True))
        get = young.__getitem__
        n = [sum(map(get, w)) + extra for w, extra in cut]
        return [ids, [len(t.encode("utf-8")) for t in texts], n]

    return work


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    path: a byte-level BPE file (vocabulary, merges, added tokens); pattern: its pre-token
    pattern. Added tokens inside a text count as one token each, as the library does by default.
    Each worker counts a part's new distinct pre-tokens with RankMerger and remembers a bounded
    number. Null texts count as empty (0 tokens); repeated rows give repeated results; texts are
    read whole, also those that are one unbroken word; an empty table gives no rows; other columns,
    whatever their names, stay behind."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    made = map_texts(id_text(docs, id_col, text_col), lambda: counter(path, pattern), schema, "doc_id long, n_bytes long, n_tokens long")
    return made.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_count(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
