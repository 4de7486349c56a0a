"""Media columns: bytes as 8-bit mono FLAC streams, decoded to PCM blocks with seekable offsets.

A stream has its sample count and MD5, a seek table with one point per frame, and frames whose
subframes are verbatim, fixed or linear predictors with Rice-coded residuals. Reading verifies
every frame header (CRC-8), every frame (CRC-16) and the whole stream (MD5). Frames of many
streams are encoded and decoded in step: one numpy operation handles one sample of each frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.substring import byte_slices

BLOCK = 512  # samples of a frame, but for the last
RATE = 8000
ORDER = 4  # of the linear predictors that are tried
PRECISION = 8  # bits of their coefficients
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
AT_ONCE = 4096  # frames in step


class DamagedStream(ValueError):
    """A checksum or a sync code is wrong."""


def _crc_table(poly: int, width: int, bits: int) -> np.ndarray:
    """Checksums of ``width`` bits of every value of ``bits`` bits (``width`` at most)."""
    c = np.arange(1 << bits, dtype=np.int64) << width - bits
    for _ in range(bits):
        c = np.where(c >> width - 1, c << 1 ^ poly, c << 1) & (1 << width) - 1
    return c


CRC8, CRC16, CRC16_PAIRS = _crc_table(0x07, 8, 8), _crc_table(0x8005, 16, 8), _crc_table(0x8005, 16, 16).astype(np.uint16)


@lru_cache(1 << 14)
def crc8(head: bytes) -> int:
    c = 0
    for b in head:
        c = int(CRC8[c ^ b])
    return c


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches of data, all in step, two bytes at a time."""
    order = np.argsort(-size, kind="stable")
    at, n, c = start[order], size[order], np.zeros(len(size), np.uint16)
    pairs = np.append(data[:-1].astype(np.uint16) << 8 | data[1:], np.uint16(0))
    live = np.searchsorted(-(n // 2), -np.arange(int(n.max(initial=0)) // 2), "left").tolist()  # stretches with more than t pairs
    for t, k in enumerate(live):
        c[:k] = CRC16_PAIRS[c[:k] ^ pairs[at[:k] + 2 * t]]
    odd = np.flatnonzero(n & 1)
    x = c[odd].astype(np.int64)
    c[odd] = (x << 8 & 0xFFFF) ^ CRC16[x >> 8 ^ data[at[odd] + n[odd] - 1]]
    out = np.empty_like(c)
    out[order] = c
    return out


@lru_cache(1 << 14)
def frame_header(number: int, samples: int) -> bytes:
    """Sync, block size, number and CRC-8 of an 8-bit mono frame."""
    if samples == BLOCK:
        size, extra = 0b1001, b""
    elif samples <= 256:
        size, extra = 0b0110, bytes([samples - 1])
    else:
        size, extra = 0b0111, struct.pack(">H", samples - 1)
    head = bytes([0xFF, 0xF8, size << 4, 0b001 << 1])
    if number < 0x80:
        coded = bytes([number])
    else:
        n = next(k for k in range(2, 8) if number < 1 << 5 * k + 1)  # bytes, as UTF-8 is carried on
        coded = bytes([(0xFF00 >> n & 0xFF) | number >> 6 * (n - 1), *(0x80 | number >> 6 * i & 0x3F for i in range(n - 2, -1, -1))])
    head += coded + extra
    return head + bytes([crc8(head)])


@lru_cache(1 << 14)
def read_header(start: bytes) -> tuple[int, int, int]:
    """(length of the header, frame number, samples) of a frame's first 16 bytes."""
    if start[:2] != b"\xff\xf8" or start[3] >> 4 or start[3] >> 1 & 7 != 1:
        raise DamagedStream("no 8-bit mono frame here")
    first, at = start[4], 5
    if first < 0x80:
        number = first
    else:
        n = next(k for k in range(2, 8) if not first >> (7 - k) & 1)
        number = first & (1 << 7 - n) - 1 if n < 7 else 0
        for b in start[5 : 4 + n]:
            number = number << 6 | b & 0x3F
        at = 4 + n
    size = start[2] >> 4
    if size == 0b0110:
        samples, at = start[at] + 1, at + 1
    elif size == 0b0111:
        samples, at = int.from_bytes(start[at : at + 2], "big") + 1, at + 2
    elif size >= 8:
        samples = 256 << size - 8
    else:
        samples = 192 if size == 1 else 576 << size - 2
    if crc8(start[:at]) != start[at]:
        raise DamagedStream("a frame header's CRC-8 differs")
    return at + 1, number, samples


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parameter, bits) per row, the better of the two that fit the mean."""
    k = np.floor(np.log2(np.maximum(u.mean(axis=1), 1))).astype(np.int32)
    best = np.full(len(u), 1 << 40)
    chosen = k
    for d in (-1, 0):
        p = np.clip(k + d, 0, 14)
        bits = (u >> p[:, None]).sum(axis=1) + u.shape[1] * (p + 1)
        chosen, best = np.where(bits < best, p, chosen), np.minimum(bits, best)
    return chosen, best


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients [frames, ORDER] and shifts, by autocorrelation and Levinson's recursion."""
    y, n = x.astype(np.float32), x.shape[1]
    r = np.stack([np.einsum("ij,ij->i", y[:, : n - j], y[:, j:]) for j in range(ORDER + 1)], axis=1).astype(np.float64)
    error, a = r[:, 0] + 1e-9, np.zeros((len(x), ORDER))
    for i in range(ORDER):
        g = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        before = a[:, :i].copy()
        a[:, i] = g
        a[:, :i] = before - g[:, None] * before[:, ::-1]
        error = np.maximum(error * (1 - g * g), 1e-9)
    top = (1 << PRECISION - 1) - 1
    shift = np.clip(np.floor(np.log2(top / np.maximum(np.abs(a).max(axis=1), 1e-6))), 0, 15).astype(np.int32)
    return np.clip(np.round(a * (1 << shift)[:, None]), -top - 1, top).astype(np.int32), shift


def _packed(codes: np.ndarray, widths: np.ndarray, lengths: np.ndarray, begin: np.ndarray, n_bytes: int) -> np.ndarray:
    """Bytes in which row i's codes follow each other from bit begin[i]; each fills the last ``width`` (24 at most) of its ``length`` bits."""
    place = np.cumsum(lengths, axis=1, dtype=np.int64) + begin[:, None] - widths
    some = lengths > 0
    place, code, width = place[some], codes[some].astype(np.uint64), widths[some]
    code <<= (64 - (place & 31) - width).astype(np.uint64)
    word = place >> 5
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out = np.zeros(n_bytes // 4 + 2, np.uint64)
    out[word[first]] = np.add.reduceat(code >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(code & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").view(np.uint8)[:n_bytes]


def _encode_frames(x: np.ndarray, heads: list[bytes]) -> list[bytes]:
    """Frames of one size: samples [frames, size] and their headers.

    The predictor with the smallest residuals is taken: none, fixed of the first or second order, or
    linear; then a Rice parameter; and plain samples where these are shorter.
    """
    n, size = x.shape
    x = x.astype(np.int32)
    coef, shift = _linear(x)
    guess = coef[:, :1] * x[:, ORDER - 1 : size - 1]
    for j in range(1, ORDER):
        guess += coef[:, j, None] * x[:, ORDER - 1 - j : size - 1 - j]
    first = np.diff(x, axis=1)
    residuals = [x, first, np.diff(first, axis=1), x[:, ORDER:] - (guess >> shift[:, None])]
    orders, extra = np.array([0, 1, 2, ORDER]), (0, 0, 0, 9 + ORDER * PRECISION)
    weights = np.stack([np.abs(r).sum(axis=1) for r in residuals], axis=1) + orders * 64
    which = weights.argmin(axis=1)
    order, kind = orders[which], np.where(which < 3, 8 + which, 31 + ORDER)  # type bits: 1 verbatim, 8 + order fixed, 31 + order linear
    best, k, u = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros((n, size), np.int32)
    for i, r in enumerate(residuals):
        rows = np.flatnonzero(which == i)
        if len(rows):
            z = _zigzag(r[rows])
            k[rows], bits = _rice(z)
            best[rows] = bits + 10 + 8 * orders[i] + extra[i]
            u[rows, orders[i] :] = z
    plain = best >= 8 * size
    kind[plain], best[plain], k[plain] = 1, 8 * size, 0
    coded = ~plain
    linear = coded & (which == 3)

    # columns: type, first samples, precision and shift, coefficients, Rice head, residuals
    lengths, codes = np.zeros((n, 7 + 2 * ORDER + size), np.int32), np.zeros((n, 7 + 2 * ORDER + size), np.int32)
    widths = lengths.copy()
    widths[:, 0], codes[:, 0] = 8, kind << 1
    for o in range(ORDER):
        widths[:, 1 + o], codes[:, 1 + o] = np.where(coded & (order > o), 8, 0), x[:, o] & 255
    at = 1 + ORDER
    widths[linear, at], codes[:, at] = 9, PRECISION - 1 << 5 | shift
    widths[linear, at + 1 : at + 1 + ORDER], codes[:, at + 1 : at + 1 + ORDER] = PRECISION, coef & (1 << PRECISION) - 1
    at += 1 + ORDER
    widths[coded, at], codes[:, at] = 10, k  # method and partition order are 0
    rest = slice(at + 1, at + 1 + size)
    live = np.arange(size) >= order[:, None]
    kk = k[:, None]
    widths[:, rest] = np.where(live, kk + 1, 0)
    codes[:, rest] = 1 << kk | u & (1 << kk) - 1
    lengths[:] = widths
    lengths[:, rest] += np.where(live, u >> kk, 0)
    widths[plain, rest], lengths[plain, rest], codes[plain, rest] = 8, 8, x[plain] & 255

    head_bytes = np.array(list(map(len, heads)))
    total = head_bytes + 1 + -(-best // 8) + 2
    begin = np.r_[0, np.cumsum(total)]
    data = _packed(codes, widths, lengths, 8 * (begin[:-1] + head_bytes), int(begin[-1]))
    places = np.repeat(begin[:-1] - np.cumsum(head_bytes) + head_bytes, head_bytes) + np.arange(int(head_bytes.sum()))
    data[places] = np.frombuffer(b"".join(heads), np.uint8)
    crc = crc16(data, begin[:-1], total - 2)
    data[begin[1:] - 2], data[begin[1:] - 1] = crc >> 8, crc & 255
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(begin[:-1].tolist(), begin[1:].tolist())]


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """Each payload (16 bytes or more) as a FLAC stream of 8-bit samples, byte value 128 being silence."""
    todo: dict[int, list[tuple[int, int]]] = {}
    parts: list[list] = []
    for i, p in enumerate(payloads):
        frames = -(-len(p) // BLOCK)
        parts.append([b""] * frames)
        for f in range(frames):
            todo.setdefault(min(BLOCK, len(p) - f * BLOCK), []).append((i, f))
    for size, places in todo.items():
        for lo in range(0, len(places), AT_ONCE):
            chosen = places[lo : lo + AT_ONCE]
            raw = b"".join(payloads[i][f * BLOCK : f * BLOCK + size] for i, f in chosen)
            x = np.frombuffer(raw, np.uint8).reshape(-1, size).astype(np.int16) - 128
            for (i, f), frame in zip(chosen, _encode_frames(x, [frame_header(f, size) for _, f in chosen])):
                parts[i][f] = frame
    out = []
    for p, frames in zip(payloads, parts):
        pcm = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        sizes = list(map(len, frames))
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        seek, at = [], 0
        for f, n in enumerate(sizes):
            seek.append(struct.pack(">QQH", f * BLOCK, at, min(BLOCK, len(p) - f * BLOCK)))
            at += n
        table = b"".join(seek)
        out.append(b"fLaC\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames))
    return out


class _Bits:
    """Reads bits of one frame, one after the other."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def take(self, width: int) -> int:
        lo, hi = self.at >> 3, self.at + width + 7 >> 3
        if hi > len(self.data):
            raise DamagedStream("a frame ends too early")
        self.at += width
        return int.from_bytes(self.data[lo:hi], "big") >> 8 * hi - self.at & (1 << width) - 1

    def signed(self, width: int) -> int:
        v = self.take(width) if width else 0
        return v - (v >> width - 1 << width) if width else 0

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def decode_subframe(data: bytes, at: int, samples: int) -> tuple[list[int], int]:
    """(samples, byte after the subframe) of any 8-bit subframe: constant, verbatim, fixed or linear, with wasted bits, partitions and escape codes."""
    bits = _Bits(data, at)
    if bits.take(1):
        raise DamagedStream("no subframe here")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = 1 + bits.zeros()
    depth = 8 - wasted
    if kind == 0:
        out = [bits.signed(depth)] * samples
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(samples)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out, coef, shift = [bits.signed(depth) for _ in range(order)], FIXED.get(order, ()), 0
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            coef = [bits.signed(precision) for _ in range(order)]
        method, parts = bits.take(2), 1 << bits.take(4)
        if method > 1 or samples % parts or samples // parts < order:
            raise DamagedStream("reserved residual coding")
        for part in range(parts):
            k = bits.take(4 + method)
            plain = bits.take(5) if k == 15 + 16 * method else None
            for _ in range(samples // parts - (0 if part else order)):
                if plain is None:
                    u = bits.zeros() << k
                    u |= bits.take(k) if k else 0
                    r = u >> 1 ^ -(u & 1)
                else:
                    r = bits.signed(plain)
                out.append(r + (sum(c * out[-1 - j] for j, c in enumerate(coef)) >> shift))
    else:
        raise DamagedStream("a reserved subframe type")
    return [v << wasted for v in out], bits.at + 7 >> 3


PEEK = 13  # bits in which a code's zeros are looked up
_ZEROS = np.array([PEEK - int(v).bit_length() for v in range(1 << PEEK)], np.int64)


def _decode_group(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Samples [longest, frames] (int32) of frames whose subframes begin at bytes ``at``; sizes are in descending order."""
    n, top = len(at), int(sizes.max(initial=0))
    word = np.zeros(len(data) - 7, np.int64)  # 56 bits from each byte on
    for j in range(7):
        word |= data[j : len(data) - 7 + j].astype(np.int64) << 48 - 8 * j

    def bits(p: np.ndarray, width: int) -> np.ndarray:
        return word[p >> 3] >> 56 - width - (p & 7) & (1 << width) - 1

    def signed(v: np.ndarray, width: int) -> np.ndarray:
        return v - (v >> width - 1 << width)

    x = np.zeros((top, n), np.int32)
    kind = data[at].astype(np.int64) >> 1
    linear, fixed, wasted = kind >= 32, (kind >= 8) & (kind <= 12), (data[at] & 1).astype(bool)
    order = np.where(linear, kind - 31, np.where(fixed, kind - 8, 0))
    p = 8 * at + 8 + 8 * order
    coef, shift = np.zeros((32, n), np.int32), np.zeros(n, np.int32)
    for o, c in FIXED.items():
        for j, v in enumerate(c):
            coef[j, fixed & (order == o)] = v
    some = np.flatnonzero(linear & ~wasted)
    precision = bits(p[some], 4) + 1
    shift[some] = signed(bits(p[some] + 4, 5), 5)
    p[some] += 9
    for width in np.unique(precision).tolist():
        rows = some[precision == width]
        for j in range(int(order[rows].max(initial=0))):
            r = rows[order[rows] > j]
            coef[j, r] = signed(bits(p[r], width), width)
            p[r] += width
    coded = (linear | fixed) & ~wasted
    inside = np.where(coded, np.minimum(p, 8 * len(word) - 80), 0)
    other = (wasted | ~coded & (kind != 1)) | coded & ((bits(inside, 6) != 0) | (bits(inside + 6, 4) == 15) | (shift < 0))
    for f in np.flatnonzero(other).tolist():  # subframes of kinds that encode_streams doesn't write, one by one
        x[: sizes[f], f] = decode_subframe(data.tobytes(), int(at[f]), int(sizes[f]))[0]
    for f in np.flatnonzero((kind == 1) & ~other):
        x[: sizes[f], f] = data[at[f] + 1 : at[f] + 1 + sizes[f]].view(np.int8)

    todo = np.flatnonzero(coded & ~other)
    if not len(todo):
        return x
    order, size, k, p = order[todo], sizes[todo], bits(p[todo] + 6, 4), p[todo] + 10
    mask, low = (1 << k) - 1, 55 - k
    res = np.zeros((top, len(todo)), np.int64)
    live = np.searchsorted(-size, -np.arange(top), "left").tolist()  # frames with more than t samples
    late = int(order.max(initial=0))
    for t, m in enumerate(live):
        if t < late:
            begun = np.flatnonzero(order[:m] <= t)
        else:
            begun = slice(0, m)
        place, kk = p[begun], k[begun]
        v = word[place >> 3] << (place & 7)
        q = _ZEROS[v >> 56 - PEEK & (1 << PEEK) - 1]
        u = q << kk | v >> low[begun] - q & mask[begun]
        if q.max(initial=0) == PEEK:
            for i in np.flatnonzero(q == PEEK).tolist():  # a long run of zero bits
                one = _Bits(data, 0)
                one.at = int(place[i])
                q[i] = one.zeros()
                u[i] = q[i] << kk[i] | (one.take(int(kk[i])) if kk[i] else 0)
        res[t, begun] = u
        p[begun] = place + q + kk + 1
    y = (res >> 1 ^ -(res & 1)).astype(np.int32)
    some = np.flatnonzero(order)
    if len(some):
        z, c, s, o = np.ascontiguousarray(y[:, some]), coef[:, todo[some]], shift[todo[some]], order[some]
        first = 8 * at[todo[some]] + 8
        for t in range(late):
            r = np.flatnonzero(o > t)
            z[t, r] = signed(bits(first[r] + 8 * t, 8), 8)
        for t in range(int(o.min()), top):
            guess = c[0] * z[t - 1]
            for j in range(1, min(t, late)):
                guess += c[j] * z[t - 1 - j]
            guess >>= s
            z[t] += guess if t >= late else np.where(t >= o, guess, 0)
        y[:, some] = z
    x[:, todo] = y
    return x


def _metadata(s: bytes) -> tuple[int, bytes, bytes]:
    """(first byte of the frames, MD5 of the samples, seek table) of a stream."""
    if s[:4] != b"fLaC":
        raise DamagedStream("no FLAC stream")
    at, last, seek, md5 = 4, False, b"", bytes(16)
    while not last:
        last, kind, n = s[at] >> 7, s[at] & 127, int.from_bytes(s[at + 1 : at + 4], "big")
        body = s[at + 4 : at + 4 + n]
        if kind == 0:
            md5 = body[18:34]
        elif kind == 3:
            seek = body
        at += 4 + n
    return at, md5, seek


def _frames(s: bytes, at: int, seek: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(sample offset, first byte, byte after, length of the header, samples) of a stream's frames.

    A seek table with a point for each frame says where they are; without one they are read in order.
    """
    points = list(struct.iter_unpack(">QQH", seek))
    if points and points[-1][0] != (1 << 64) - 1:
        ends = [at + x[1] for x in points[1:]] + [len(s)]
        found = [(offset, at + begin, end, *read_header(s[at + begin : at + begin + 16])) for (offset, begin, _), end in zip(points, ends)]
        if found[0][0] == 0 and all(x[4] == f for f, x in enumerate(found)) and all(a[0] + a[5] == b[0] for a, b in zip(found, found[1:])):
            yield from ((offset, begin, end, head, samples) for offset, begin, end, head, _, samples in found)
            return
    offset = 0
    while at < len(s):
        head, _, samples = read_header(s[at : at + 16])
        end = decode_subframe(s, at + head, samples)[1] + 2
        yield offset, at, end, head, samples
        offset, at = offset + samples, end


def decode_streams(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks (sample offset, signed 8-bit PCM) of each stream; raises DamagedStream where a checksum differs."""
    found: list[list] = []
    frames, md5s = [], []
    for i, s in enumerate(streams):
        at, md5, seek = _metadata(s)
        own = list(_frames(s, at, seek))
        found.append([None] * len(own))
        md5s.append(md5)
        frames += [(samples, i, f, offset, begin, end, head) for f, (offset, begin, end, head, samples) in enumerate(own)]
    frames.sort(key=lambda x: -x[0])
    for lo in range(0, len(frames), AT_ONCE):
        chosen = frames[lo : lo + AT_ONCE]
        raw = [streams[i][b:e] for _, i, _, _, b, e, _ in chosen]
        lengths = np.array(list(map(len, raw)))
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        data = np.frombuffer(b"".join(raw) + bytes(16), np.uint8)
        if crc16(data, starts, lengths).any():  # over a frame and its own checksum it is 0
            raise DamagedStream("a frame's CRC-16 differs")
        sizes = np.array([x[0] for x in chosen])
        x = np.ascontiguousarray(_decode_group(data, starts + np.array([x[6] for x in chosen]), sizes).astype(np.int8).T)
        for (samples, i, f, offset, *_), row in zip(chosen, x):
            found[i][f] = (offset, row[:samples].tobytes())
    for blocks, md5 in zip(found, md5s):
        if any(md5) and hashlib.md5(b"".join(b for _, b in blocks)).digest() != md5:
            raise DamagedStream("a stream's MD5 differs")
    return found


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the text as UTF-8 filled up with bytes 0 to a positive multiple of 64)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def _sliced(n_bytes: list[int], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Stretches of a batch with about ``most`` bytes each, so that working memory stays bounded."""
    lo, size = 0, 0
    for i, n in enumerate(n_bytes):
        if size and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(n_bytes):
        yield lo, len(n_bytes)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the text's bytes as a FLAC stream, a row for each row, repeated or null ids included.

    A null or empty text is 64 samples; long texts are coded whole, in slices of a bounded size; an
    empty table gives no rows; other columns are not looked at, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1):
            n_bytes, payloads = zip(*(payload(t.as_py()) for t in b.column(1)))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": pa.array(n_bytes, pa.int64()), "media": pa.array(encode_streams(list(payloads)), pa.binary())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary").withColumnRenamed("doc_id", id_col)


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, block, sample_offset, n_samples, pcm) of a column of streams: a row for each frame, found again by its offset.

    A null stream and an empty table give no rows; repeated rows each give theirs; long streams are decoded frame by frame. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            streams = [x.as_py() for x in b.column(1)]
            for lo, hi in _sliced([8 * len(s) for s in streams]):
                rows = [(doc, f, offset, pcm) for doc, blocks in zip(b.column(0).slice(lo, hi - lo).to_pylist(), decode_streams(streams[lo:hi])) for f, (offset, pcm) in enumerate(blocks)]
                ids, f, offset, pcm = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "block": pa.array(f, pa.int32()), "sample_offset": pa.array(offset, pa.int64()), "n_samples": pa.array(list(map(len, pcm)), pa.int32()), "pcm": pa.array(pcm, pa.binary())})

    rows = media.where(F.col(media_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), media_col)
    return rows.mapInArrow(run, "doc_id long, block int, sample_offset long, n_samples int, pcm binary").withColumnRenamed("doc_id", id_col)


def feature(samples: np.ndarray) -> str:
    """Sum, energy and sign changes of signed samples."""
    x = samples.astype(np.int64)
    return f"sum={int(x.sum())};energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), from the decoded streams.

    Everything but n_bytes comes from the media column that :func:`encode` made: its blocks are
    decoded, verified (CRC-8, CRC-16, MD5) and put together again. Equal texts give equal values; for
    null, empty and long texts, repeated rows, empty tables and other columns see :func:`encode`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            streams = [x.as_py() for x in b.column(2)]
            for lo, hi in _sliced([8 * len(s) for s in streams]):
                rows = []
                for media, blocks in zip(streams[lo:hi], decode_streams(streams[lo:hi])):
                    pcm = np.frombuffer(b"".join(p for _, p in blocks), np.uint8)
                    raw = (pcm ^ 128).tobytes()
                    rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(pcm.view(np.int8))))
                columns = [pa.array(c) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    media = encode(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id")
    out = media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("doc_id", id_col)
