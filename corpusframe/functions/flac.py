"""FLAC streams in numpy: every subframe kind is read; what is written uses fixed predictors."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

#: Codes of the frame header (fixed values of the format): sample rates, bits of a sample.
RATES = (0, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000)
WIDTHS = (0, 8, 12, 0, 16, 20, 24, 32)
BLOCK = 4096


class Bits:
    """Bits of a buffer, the highest of each byte first."""

    def __init__(self, raw: bytes, at: int = 0):
        self.bits, self.at = np.unpackbits(np.frombuffer(raw, np.uint8)), at
        self.flat = self.bits.tobytes()

    def number(self, n: int, signed: bool = False) -> int:
        if self.at + n > len(self.flat):
            raise EOFError("the stream ends inside a frame")
        v = 0
        for b in self.flat[self.at : self.at + n]:
            v = v << 1 | b
        self.at += n
        return v - (1 << n) if signed and n and v >> n - 1 else v

    def numbers(self, count: int, n: int) -> np.ndarray:
        """count signed numbers of n bits."""
        if self.at + count * n > len(self.flat):
            raise EOFError("the stream ends inside a frame")
        m = self.bits[self.at : self.at + count * n].reshape(count, n).astype(np.int64)
        self.at += count * n
        v = m @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64)) if n else np.zeros(count, np.int64)
        return np.where(v >> n - 1 & 1, v - (1 << n), v) if n else v

    def unary(self) -> int:
        end = self.flat.find(b"\x01", self.at)
        if end < 0:
            raise EOFError("the stream ends inside a frame")
        n, self.at = end - self.at, end + 1
        return n

    def rice(self, count: int, k: int) -> np.ndarray:
        """count Rice-coded signed numbers: only the ends of the unary parts are searched one by one."""
        find, at = self.flat.find, self.at
        begin, end = np.empty(count, np.int64), np.empty(count, np.int64)
        for i in range(count):
            begin[i] = at
            at = find(b"\x01", at)
            if at < 0:
                raise EOFError("the stream ends inside a frame")
            end[i] = at
            at += 1 + k
        self.at = at
        if at > len(self.flat):
            raise EOFError("the stream ends inside a frame")
        low = self.bits[end[:, None] + 1 + np.arange(k)].astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else 0
        v = (end - begin << k) + low
        return v >> 1 ^ -(v & 1)


def residual(bits: Bits, n: int, order: int) -> np.ndarray:
    wide = 5 if bits.number(2) else 4
    parts = 1 << bits.number(4)
    out = []
    for p in range(parts):
        count, k = n // parts - (order if p == 0 else 0), bits.number(wide)
        out.append(bits.numbers(count, bits.number(5)) if k == (1 << wide) - 1 else bits.rice(count, k))
    return np.concatenate(out)


def fixed(start: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Samples of which rest are the differences of order len(start): sums of sums."""
    order = len(start)
    tails = [np.diff(start, i)[-1] if len(start) > i else 0 for i in range(order)]
    for tail in reversed(tails):
        rest = tail + np.cumsum(rest)
    return np.concatenate([start, rest])


def predicted(start: np.ndarray, rest: np.ndarray, weights: np.ndarray, shift: int) -> np.ndarray:
    out, w = start.tolist(), weights.tolist()
    for r in rest.tolist():
        s = 0
        for i, c in enumerate(w, 1):
            s += c * out[-i]
        out.append(r + (s >> shift))
    return np.array(out, np.int64)


def subframe(bits: Bits, n: int, width: int) -> np.ndarray:
    bits.number(1)
    kind = bits.number(6)
    waste = bits.unary() + 1 if bits.number(1) else 0
    width -= waste
    if kind == 0:
        x = np.full(n, bits.number(width, True), np.int64)
    elif kind == 1:
        x = bits.numbers(n, width)
    elif 8 <= kind <= 12:
        start = bits.numbers(kind - 8, width)
        x = fixed(start, residual(bits, n, kind - 8))
    elif kind >= 32:
        start = bits.numbers(kind - 31, width)
        precision = bits.number(4) + 1
        shift = bits.number(5, True)
        weights = bits.numbers(kind - 31, precision)
        x = predicted(start, residual(bits, n, kind - 31), weights, shift)
    else:
        raise ValueError("a reserved kind of subframe")
    return x << waste


def header(raw: bytes) -> tuple[int, int, int, int, int]:
    """(rate, channels, bits of a sample, samples or 0, where the frames begin)."""
    if raw[:4] != b"fLaC":
        raise ValueError("not FLAC")
    at, said = 4, None
    while True:
        kind, size = raw[at], int.from_bytes(raw[at + 1 : at + 4], "big")
        if kind & 127 == 0:
            v = int.from_bytes(raw[at + 14 : at + 22], "big")
            said = v >> 44, (v >> 41 & 7) + 1, (v >> 36 & 31) + 1, v & (1 << 36) - 1
        at += 4 + size
        if kind & 128:
            break
    if said is None:
        raise ValueError("no stream information")
    return *said, at


def decode(raw: bytes, start: int = 0, count: int | None = None) -> tuple[np.ndarray, int]:
    """((samples, channels) floats from -1 to 1, rate): count samples from start on. Frames behind
    the window are not read."""
    rate, channels, width, total, at = header(raw)
    bits, at = None, at
    out, done, until = [], 0, None if count is None else start + count
    while at + 6 < len(raw) and (until is None or done < until) and (not total or done < total):
        bits = Bits(raw[at : at + 8 * channels * 70_000])
        if bits.number(14) != 0x3FFE:
            raise ValueError("a frame does not begin where it must")
        bits.number(2)
        size, rate_code, kind, width_code = bits.number(4), bits.number(4), bits.number(4), bits.number(3)
        bits.number(1)
        lead = 0
        while bits.number(1):
            lead += 1
        bits.at += 7 - lead + 8 * max(0, lead - 1)
        n = 192 if size == 1 else 576 << size - 2 if size <= 5 else bits.number(8) + 1 if size == 6 else bits.number(16) + 1 if size == 7 else 256 << size - 8
        bits.at += {12: 8, 13: 16, 14: 16}.get(rate_code, 0) + 8
        own = WIDTHS[width_code] or width
        sides = (kind == 9, kind in (8, 10)) if kind >= 8 else (False,) * (kind + 1)
        x = [subframe(bits, n, own + s) for s in sides]
        if kind == 8:
            x[1] = x[0] - x[1]
        elif kind == 9:
            x[0] = x[0] + x[1]
        elif kind == 10:
            mid = x[0] << 1 | x[1] & 1
            x = [mid + x[1] >> 1, mid - x[1] >> 1]
        at += -(-bits.at // 8) + 2
        if done + n > start:
            out.append(np.stack(x, axis=1)[max(0, start - done) :])
        done += n
    x = np.concatenate(out) if out else np.zeros((0, channels), np.int64)
    return (x if count is None else x[:count]).astype(np.float64) / (1 << width - 1), rate


@lru_cache(maxsize=64)
def _passed(k: int, size: int, poly: int) -> np.ndarray:
    """Every checksum of so many bits after 2**k bytes of zeros."""
    if k:
        half = _passed(k - 1, size, poly)
        return half[half]
    crc = np.arange(1 << size)
    for _ in range(8):
        crc = np.where(crc >> size - 1 & 1, crc << 1 ^ poly, crc << 1) & (1 << size) - 1
    return crc.astype(np.uint16)


def _crc(raw: bytes, size: int, poly: int) -> int:
    """Neighbours' checksums are put together, all pairs at once; zeros in front change nothing."""
    crc, k = _passed(0, size, poly)[np.frombuffer(raw, np.uint8).astype(int) << size - 8], 0
    while len(crc) > 1:
        crc = np.r_[np.zeros(len(crc) % 2, np.uint16), crc]
        crc, k = _passed(k, size, poly)[crc[::2]] ^ crc[1::2], k + 1
    return int(crc[0]) if len(crc) else 0


def _as_bits(v: int, n: int) -> np.ndarray:
    return (v >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8)


def _frame(x: np.ndarray, number: int, rate: int) -> bytes:
    order = min(2, len(x) - 1)
    rest = np.diff(x, order) if order else x
    v = rest << 1 ^ rest >> 63
    k = min(14, max(0, int(np.log2(v.mean() + 1))))
    size = (v >> k) + 1 + k
    ends = np.cumsum(size)
    code = np.zeros(int(ends[-1]), np.uint8)
    code[ends - k - 1] = 1
    if k:
        code[(ends - k)[:, None] + np.arange(k)] = v[:, None] >> np.arange(k - 1, -1, -1) & 1
    name = b"" if number < 128 else None
    utf = bytes([number]) if name is not None else chr(number).encode("utf-8", "surrogatepass")
    rate_code = RATES.index(rate) if rate in RATES[1:] else 0
    head = (0x3FFE << 18 | 7 << 12 | rate_code << 8 | 4 << 1).to_bytes(4, "big") + utf + (len(x) - 1).to_bytes(2, "big")
    head += bytes([_crc(head, 8, 0x07)])
    body = [_as_bits(8 + order << 1, 8), *[_as_bits(int(s) & 0xFFFF, 16) for s in x[:order]], _as_bits(0, 6), _as_bits(k, 4), code]
    raw = head + np.packbits(np.concatenate(body)).tobytes()
    return raw + _crc(raw, 16, 0x8005).to_bytes(2, "big")


def encode(x: np.ndarray, rate: int) -> bytes:
    """One channel of floats from -1 to 1 as 16-bit FLAC."""
    s = (np.clip(x, -1, 1 - 2**-15) * 32768).round().astype(np.int64)
    info = BLOCK.to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | 15 << 36 | len(s)).to_bytes(8, "big") + hashlib.md5(s.astype("<i2").tobytes()).digest()
    frames = [_frame(s[i : i + BLOCK], n, rate) for n, i in enumerate(range(0, len(s), BLOCK))]
    return b"fLaC" + bytes([128]) + len(info).to_bytes(3, "big") + info + b"".join(frames)
