"""SentencePiece-style BPE encoding by a table of each prefix's last token, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_texts, table

SPACE = "▁"
#: Chunks whose codes a worker remembers, and pairs whose compatibility it remembers.
CACHE, PAIRS = 1_500_000, 1_000_000
IDS, SAID = itemgetter(0), itemgetter(1)


class PieceCodec:
    """Codes of a BPE piece model with byte fallback and a leading space mark.

    For every prefix of a text, BPE's code ends in one certain token. An automaton gives all
    pieces that end at a place; the last token there is the one piece that is its own code and
    that is compatible with the last token of the prefix before it, where two tokens are
    compatible if the code of their joined text is just those two. The table is filled from
    left to right and ids are recovered from its end backwards, in time linear in the text.

    Pieces of one score (runs of the space mark) break that uniqueness, so chunks that hold
    such a run are coded by merging with a heap instead."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.value = {i: b for b, i in enumerate(self.byte)}
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.auto = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.auto.add_word(p, (i, len(p)))
        self.auto.make_automaton()
        inside = {c for p in self.id for c in p}
        self.pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.known = {c for c in inside if c in self.id}
        self.partial = inside - self.known
        self.own: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        # no piece has a space mark after another character, so a code never reaches across
        joined = any(p[1] == SPACE != p[0] for p in self.pairs)
        self.cut = re.compile("(?s).+" if joined else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def split(self, chunk: str) -> list[str]:
        """Cut where two characters stand side by side that do so in no piece; letters alone
        are left together."""
        if chunk[1:].isalpha():
            return [chunk]
        pairs, at, out = self.pairs, 0, []
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in pairs:
                out.append(chunk[at:i])
                at = i
        out.append(chunk[at:])
        return out

    def merged(self, text: str) -> list[int]:
        """The code by its definition: of all neighbours, the pair whose joined piece scores
        highest merges first, and of equal ones the leftmost."""
        sym: list[str | None] = list(text)
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (s := self.score.get(joined := sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (-s, i, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if sym[i] is None or (j := after[i]) >= n or sym[i] + sym[j] != joined:
                continue
            sym[i], sym[j] = joined, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        out: list[int] = []
        for s in sym:
            if s is not None:
                out += [self.id[s]] if s in self.id else [self.byte[b] for c in s for b in c.encode("utf-8", "replace")]
        return out

    def whole(self, i: int) -> bool:
        """Is this piece its own code?"""
        if (own := self.own.get(i)) is None:
            own = self.own[i] = self.merged(self.pieces[i]) == [i]
        return own

    def compatible(self, a: int, b: int) -> bool:
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        fit = self.fits[a << 32 | b] = self.whole(b) and self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
        return fit

    def prefixes(self, text: str) -> list[int]:
        """The code of a text of known characters, from its prefix table."""
        last, size = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        known = self.fits.get
        for end, (i, length) in self.auto.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            if at := end - length:
                if (left := last[at]) < 0:
                    continue
                if (fit := known(left << 32 | i)) is None:
                    fit = self.compatible(left, i)
            else:
                fit = self.whole(i)
            if fit:
                last[end], size[end] = i, length
        out, at = [], len(text)
        while at:
            if last[at] < 0:
                return self.merged(text)
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode(self, chunk: str) -> list[int]:
        if SPACE * 2 in chunk or self.partial and not self.partial.isdisjoint(chunk):
            return self.merged(chunk)
        if self.known.issuperset(chunk):
            return self.prefixes(chunk)
        out: list[int] = []
        at = 0
        for i, c in enumerate(chunk):
            if c not in self.known:
                out += self.prefixes(chunk[at:i]) if i > at else []
                out += [self.byte[b] for b in c.encode("utf-8")]
                at = i + 1
        return out + (self.prefixes(chunk[at:]) if at < len(chunk) else [])

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, bytes of fallback ids read as UTF-8, space marks as spaces; control
        ids give nothing. The leading space of a whole text stays here."""
        if self.value.keys().isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids if i != self.bos and i != self.eos]).replace(SPACE, " ")
        out = bytearray()
        for i in ids:
            if (b := self.value.get(i)) is not None:
                out.append(b)
            elif i not in (self.bos, self.eos):
                out += self.pieces[i].encode("utf-8")
        return out.decode("utf-8", "replace").replace(SPACE, " ")


def coder(path: str, cache: int = CACHE):
    """A function from texts to pairs (ids as little-endian unsigned 32-bit, decoded text)."""
    codec = PieceCodec(path)
    words: dict[str, tuple[bytes, str]] = {}
    kept: dict[str, tuple[bytes, str]] = {}
    begin, end = struct.pack("<I", codec.bos), struct.pack("<I", codec.eos)

    def fresh(part: str) -> tuple[bytes, str]:
        nonlocal kept
        subs = codec.split(part)
        if len(subs) > 1:
            each = [kept.get(s) or fresh(s) for s in subs]
            v = b"".join([x[0] for x in each]), "".join([x[1] for x in each])
        else:
            ids = codec.encode(part)
            v = struct.pack(f"<{len(ids)}I", *ids), codec.decode(ids)
        if len(subs) == 1 and len(part) < 64:
            if len(kept) > cache // 5:
                kept = dict(list(kept.items())[len(kept) // 2 :])
            kept[part] = v
        return v

    def code(text: str) -> tuple[bytes, str]:
        nonlocal words
        if not text:
            return begin + end, ""
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            parts = codec.cut.findall(SPACE + text.replace(" ", SPACE))
        else:  # every part is a space mark and a word: kept without the mark
            parts = text.split(" ")
            try:
                found = list(map(words.__getitem__, parts))
            except KeyError:
                new = set(parts).difference(words)
                if len(words) + len(new) > cache:
                    words = dict(list(words.items())[len(words) // 2 :])
                    new = set(parts).difference(words)
                words.update([(w, fresh(SPACE + w)) for w in new])
                found = list(map(words.__getitem__, parts))
                for w in new:
                    if len(w) > 64:
                        del words[w]
            return begin + b"".join(map(IDS, found)) + end, "".join(map(SAID, found))[1:]
        found = [kept.get(p) or fresh(p) for p in parts]
        said = "".join([v[1] for v in found])
        return begin + b"".join([v[0] for v in found]) + end, said[1:] if said[:1] == " " else said

    return code


def encode_decode(docs: DataFrame, path: str, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; with keep also ids
    (array of int) and decoded.

    Each whole text is encoded with begin and end ids and decoded again. Null texts count as
    empty: two ids, an empty decoding. Long runs without a space take linear time. Repeated
    rows give repeated results; an empty table gives none; other columns, whatever their names, stay
    behind."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    said = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        said += ", ids array<int>, decoded string"

    def make():
        code = coder(path)

        def work(ids: list, texts: list[str]) -> list:
            made = [code(t) for t in texts]
            sha = lambda b: hashlib.sha256(b).hexdigest()
            out = [ids, [len(b) // 4 for b, _ in made], [sha(b) for b, _ in made], [sha(s.encode("utf-8")) for _, s in made]]
            return out + ([[list(struct.unpack(f"<{len(b) // 4}I", b)) for b, _ in made], [s for _, s in made]] if keep else [])

        return work

    return map_texts(id_text(docs, id_col, text_col), make, pa.schema(fields), said)


def op5_piece_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
