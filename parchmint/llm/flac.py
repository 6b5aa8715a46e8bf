"""FLAC as a media column: lossless storage of 8-bit mono samples and decoding to PCM blocks.

Streams follow the FLAC format (RFC 9639): a STREAMINFO and a SEEKTABLE block, then fixed-size
frames. Encoding picks for each frame the smallest of constant, fixed predictors, a linear
predictor and verbatim, with Rice-coded residuals in partitions. Decoding reads subframe headers,
Rice residuals and predictors of mono streams of 4 to 24 bits, verifies each frame's header CRC-8
and frame CRC-16, and gives one PCM block a frame with its sample offset.

Both directions work on many frames at once: step i handles sample i of every frame in a chunk.

Null media: no blocks. A stream that cannot be read: one row with ok = false and no PCM. A frame
whose checksum fails: ok = false, no PCM; the other frames are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import batch_of, chunks, column, texts

#: Samples of a frame in streams that are written here; payloads are padded to a multiple of it.
BLOCK = 576
SAMPLE_RATE = 8000
#: Order and coefficient bits of the linear predictor that is tried for each frame.
LPC_ORDER, LPC_BITS = 8, 10
#: Rice partitions of a frame: 2 ** PARTITIONS.
PARTITIONS = 2
#: Frames that are coded together.
FRAMES = 2048
#: Points that a SEEKTABLE can hold: its length is a number of 24 bits.
MOST_POINTS = ((1 << 24) - 1) // 18
#: Coefficients of the fixed predictors of order 0 to 4 (fixed values of the format).
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


@cache
def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """(CRC-8 by byte, polynomial 0x07; CRC-16 by byte, polynomial 0x8005)."""

    def made(bits: int, poly: int) -> np.ndarray:
        out = np.arange(256, dtype=np.uint32) << (bits - 8)
        for _ in range(8):
            out = np.where(out >> (bits - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << bits) - 1)
        return out

    return made(8, 0x07).astype(np.uint8), made(16, 0x8005).astype(np.uint16)


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row; leading zero bytes don't count, so shorter frames are right-aligned."""
    table = crc_tables()[1]
    crc = np.zeros(len(rows), np.uint16)
    for col in np.ascontiguousarray(rows.T):
        crc = table[(crc >> 8).astype(np.uint8) ^ col] ^ (crc << np.uint16(8))
    return crc


def crc8(data: bytes) -> int:
    table, crc = crc_tables()[0], 0
    for b in data:
        crc = int(table[crc ^ b])
    return crc


def coded_number(n: int) -> bytes:
    """Frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    out: list[int] = []
    limit = 0x3F
    while n > limit:
        out.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
    return bytes([(0xFF ^ (limit << 1 | 1)) | n, *reversed(out)]) if limit else bytes([0xFE, *reversed(out)])


def frame_header(number: int) -> bytes:
    """Header of a mono 8-bit frame of BLOCK samples."""
    head = b"\xff\xf8" + bytes([0x24, 0x02]) + coded_number(number)
    return head + bytes([crc8(head)])


@cache
def _header(number: int) -> bytes:
    return frame_header(number)


# --- encoding -----------------------------------------------------------------------------------


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(quantised coefficients, shift, usable) of a linear predictor for each row."""
    f = x.astype(np.float32) * np.hanning(x.shape[1]).astype(np.float32)
    auto = np.stack([np.einsum("ij,ij->i", f[:, : f.shape[1] - k], f[:, k:]) for k in range(LPC_ORDER + 1)], 1).astype(np.float64)
    error = auto[:, 0] * (1 + 1e-6) + 1e-6
    coef = np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (auto[:, i + 1] - np.einsum("ij,ij->i", coef[:, :i], auto[:, i:0:-1])) / error
        before = coef[:, :i].copy()
        coef[:, i] = k
        coef[:, :i] = before - k[:, None] * before[:, ::-1]
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = np.abs(coef).max(axis=1)
    usable = np.isfinite(most) & (most > 0) & (most < 64)
    coef[~usable] = 0
    shift = np.clip(LPC_BITS - 1 - np.ceil(np.log2(np.where(usable, most, 1) + 1e-12)), 0, 15).astype(np.int64)
    top = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(coef * (1 << shift)[:, None]), -top, top).astype(np.int64), shift, usable


def _rice(res: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zigzag residuals, Rice parameter of each partition, bits of the residual section)."""
    n, size = res.shape
    parts = 1 << PARTITIONS
    zig = (res << 1) ^ (res >> 31)
    live = np.arange(size)[None, :] >= order[:, None]
    zig = np.where(live, zig, 0).astype(np.uint32)
    cut = zig.reshape(n, parts, size // parts)
    count = live.reshape(n, parts, -1).sum(2)
    total = cut.sum(2, dtype=np.int64)
    guess = np.clip(np.floor(np.log2(np.maximum(total, 1) / np.maximum(count, 1) + 1e-9)).astype(np.int64), 0, 13)
    best = np.full((n, parts), np.iinfo(np.int64).max)
    param = np.zeros((n, parts), np.int64)
    for k in (guess, guess + 1):
        bits = (cut >> k[:, :, None].astype(np.uint32)).sum(2, dtype=np.int64) + count * (k + 1) + 4
        param = np.where(bits < best, k, param)
        best = np.minimum(bits, best)
    return zig, param, best.sum(1) + 6


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = values >> (width - 1 - j) & 1


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of 8-bit sample rows (n x BLOCK, signed)."""
    n = len(x)
    x = x.astype(np.int32)
    zero = np.zeros(n, np.int64)
    plans = []  # bits, order, zigzag, parameters, kind
    for order in range(3):
        res = x.copy()
        for _ in range(order):
            res[:, 1:] = np.diff(res, axis=1)
        zig, param, bits = _rice(res, zero + order)
        plans.append((8 + 8 * order + bits, zero + order, zig, param))
    coef, shift, usable = _lpc(x)
    pred = np.zeros((n, BLOCK - LPC_ORDER), np.int32)
    for j in range(LPC_ORDER):
        pred += coef[:, j, None].astype(np.int32) * x[:, LPC_ORDER - 1 - j : BLOCK - 1 - j]
    res = np.zeros_like(x)
    res[:, LPC_ORDER:] = x[:, LPC_ORDER:] - (pred >> shift[:, None].astype(np.int32))
    zig, param, bits = _rice(res, zero + LPC_ORDER)
    lpc = 8 + 8 * LPC_ORDER + 9 + LPC_BITS * LPC_ORDER + bits
    plans.append((np.where(usable, lpc, 1 << 40), zero + LPC_ORDER, zig, param))
    cost = np.stack([p[0] for p in plans] + [zero + 8 + 8 * BLOCK, np.where((x == x[:, :1]).all(1), 16, 1 << 40)], 1)
    pick = cost.argmin(1)

    heads = [_header(int(k)) for k in numbers]
    head_len = np.array([len(h) for h in heads])
    body_bytes = (cost[np.arange(n), pick] + 7) // 8
    ends = np.cumsum(head_len + body_bytes + 2)
    starts = ends - (head_len + body_bytes + 2)
    bits = np.zeros(int(ends[-1]) * 8, np.uint8) if n else np.zeros(0, np.uint8)
    body = (starts + head_len) * 8
    for kind in range(6):
        rows = np.flatnonzero(pick == kind)
        if not len(rows):
            continue
        at, y = body[rows], x[rows]
        if kind == 5:  # constant
            _put(bits, at + 8, y[:, 0] & 255, 8)
            continue
        if kind == 4:  # verbatim
            _put(bits, at, np.full(len(rows), 0b00000010), 8)
            _put(bits, at[:, None] + 8 + 8 * np.arange(BLOCK), y & 255, 8)
            continue
        order = kind if kind < 3 else LPC_ORDER
        _put(bits, at, np.full(len(rows), ((8 | order) if kind < 3 else (32 | order - 1)) << 1), 8)
        at = at + 8
        for j in range(order):
            _put(bits, at, y[:, j] & 255, 8)
            at = at + 8
        if kind == 3:
            _put(bits, at, np.full(len(rows), LPC_BITS - 1), 4)
            _put(bits, at + 4, shift[rows], 5)
            at = at + 9
            for j in range(LPC_ORDER):
                _put(bits, at, coef[rows, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
                at = at + LPC_BITS
        _put(bits, at + 2, np.full(len(rows), PARTITIONS), 4)  # method 0: 4-bit parameters
        at = at + 6
        zig, param = plans[kind][2][rows], plans[kind][3][rows]
        each = np.repeat(param, BLOCK >> PARTITIONS, axis=1).astype(np.uint32)
        quotient = zig >> each
        width = (quotient + 1 + each).astype(np.int64)
        width[:, :order] = 0
        opens = np.arange(1 << PARTITIONS) * (BLOCK >> PARTITIONS)
        width[:, opens] += 4
        place = at[:, None] + np.cumsum(width, axis=1) - width
        for p, i in enumerate(opens):
            _put(bits, place[:, i], param[:, p], 4)
            place[:, i] += 4
        place, zig, each, quotient = place[:, order:].ravel(), zig[:, order:].ravel(), each[:, order:].ravel(), quotient[:, order:].ravel()
        stop = place + quotient
        bits[stop] = 1
        low = stop + each
        for j in range(int(each.max(initial=0))):
            some = slice(None) if j < int(each.min(initial=0)) else each > j
            bits[low[some] - j] = zig[some] >> j & 1
    data = np.packbits(bits)
    for s, h in zip(starts.tolist(), heads):
        data[s : s + len(h)] = np.frombuffer(h, np.uint8)
    sums = crc16(_aligned(data, starts, ends - 2))
    data[ends - 2], data[ends - 1] = sums >> 8, sums & 255
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _aligned(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The byte runs as rows, right-aligned after zeros."""
    size = int((ends - starts).max(initial=0))
    at = ends[:, None] - size + np.arange(size)[None, :]
    return np.where(at >= starts[:, None], data[np.maximum(at, 0)], 0).astype(np.uint8)


def wrap(frames: list[bytes], samples: int, digest: bytes) -> bytes:
    """A whole stream: marker, STREAMINFO, SEEKTABLE with a point for each frame, frames.

    A table holds at most MOST_POINTS points; a longer stream has one for every second, third ... frame.
    """
    sizes = [len(f) for f in frames]
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
    info += (SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | samples).to_bytes(8, "big") + digest
    at = np.arange(0, len(frames), max(1, -(-len(frames) // MOST_POINTS)))
    points = np.zeros(len(at), np.dtype([("sample", ">u8"), ("byte", ">u8"), ("size", ">u2")]))
    points["sample"], points["byte"], points["size"] = at * BLOCK, np.cumsum([0, *sizes[:-1]])[at] if len(at) else 0, BLOCK
    seek = points.tobytes()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


def padded(text: str | None) -> bytes:
    """UTF-8 of a text with bytes 255 up to a positive multiple of BLOCK."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload, whose length is a multiple of BLOCK; byte b is sample b - 128."""
    frames: list[bytes] = []
    counts = [len(p) // BLOCK for p in payloads]
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    for a in range(0, len(rows), FRAMES):
        frames += encode_frames((rows[a : a + FRAMES] ^ 128).view(np.int8), numbers[a : a + FRAMES])
    out, at = [], 0
    for p, c in zip(payloads, counts):
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        out.append(wrap(frames[at : at + c], len(p), hashlib.md5(signed).digest()))
        at += c
    return out


# --- decoding -----------------------------------------------------------------------------------


class Stream:
    """Metadata of a stream and the places of its frames."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, last, self.seek = 4, False, []
        while not last:
            if at + 4 > len(data):
                raise ValueError("metadata is cut off")
            last, kind, size = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            part = data[at + 4 : at + 4 + size]
            if kind == 0:
                low, self.block = struct.unpack(">HH", part[:4])
                packed = int.from_bytes(part[10:18], "big")
                self.channels, self.bits, self.samples, self.md5 = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, part[18:34]
            elif kind == 3:
                self.seek = [struct.unpack(">QQH", part[i : i + 18]) for i in range(0, size - 17, 18)]
            at += 4 + size
        self.first = at
        self.data = data

    def frames(self) -> list[tuple[int, int, int, int]]:
        """(number, start, start of the subframe, end) of each frame, by the sync code and header CRC-8.

        A place counts as a frame's start if its header is whole, its CRC-8 holds and its number is
        the next one; the seek table, where present, saves the search.
        """
        places = [self.first + b for s, b, _ in self.seek if s != 2**64 - 1]
        found = self._chain(places)
        if not found or len(found) * self.block < self.samples:
            raw = np.frombuffer(self.data, np.uint8)
            sync = np.flatnonzero((raw[:-1] == 255) & (raw[1:] == 0xF8))
            found = self._chain([int(p) for p in sync if p >= self.first])
        ends = [f[1] for f in found[1:]] + [len(self.data)]
        return [(n, s, b, e) for (n, s, b), e in zip(found, ends)]

    def _chain(self, places: list[int]) -> list[tuple[int, int, int]]:
        found, want = [], 0
        for p in places:
            head = _header(want) if self.bits == 8 and self.block == BLOCK else b""
            if head and self.data.startswith(head, p):  # the usual header, byte by byte
                found.append((want, p, p + len(head)))
                want += 1
                continue
            read = read_header(self.data, p)
            if read and (read[0] == want or not found):
                found.append((read[0], p, read[1]))
                want = read[0] + 1
        return found


def read_header(data: bytes, p: int) -> tuple[int, int] | None:
    """(number, end of header) if a mono fixed-size frame header with a right CRC-8 stands at ``p``."""
    if p + 6 > len(data) or data[p : p + 2] != b"\xff\xf8" or data[p + 3] >> 4:
        return None
    at, first = p + 4, data[p + 4]
    more = 0 if first < 128 else 8 - (first ^ 255).bit_length() - 1
    number = first if not more else first & (1 << max(0, 6 - more)) - 1
    for b in data[at + 1 : at + 1 + more]:
        number = number << 6 | b & 63
    at += 1 + more
    at += {6: 1, 7: 2}.get(data[p + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(data[p + 2] & 15, 0)
    return (number, at + 1) if at < len(data) and crc8(data[p:at]) == data[at] else None


def block_size(data: bytes, p: int) -> int:
    """Samples of the frame whose header stands at ``p``."""
    code = data[p + 2] >> 4
    if code in (6, 7):
        first = data[p + 4]
        at = p + 5 + (0 if first < 128 else 8 - (first ^ 255).bit_length() - 1)
        return int.from_bytes(data[at : at + code - 5], "big") + 1
    return 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8


class Bits:
    """A cursor for each frame into shared bytes."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.at = at.astype(np.int64) * 8
        self.end = len(data) * 8
        wide = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.zeros(len(data) + 8, np.uint64)
        for i in range(8):
            self.words |= wide[i : i + len(self.words)].astype(np.uint64) << np.uint64(56 - 8 * i)

    def window(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each place on, left-aligned."""
        at = np.minimum(at, self.end)
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def read(self, width, rows=slice(None)) -> np.ndarray:
        """Unsigned numbers of ``width`` bits (a number, or one for each row)."""
        width = np.asarray(width, np.uint64)
        w = self.window(self.at[rows])
        self.at[rows] += width.astype(np.int64)
        return np.where(width > 0, w >> (np.uint64(64) - np.maximum(width, 1)), 0).astype(np.int64)

    def unary(self, rows=slice(None)) -> np.ndarray:
        """Zeros before the next one."""
        at = self.at[rows]
        count = _leading(self.window(at))
        more = np.flatnonzero(count == SEEN)
        while len(more):
            extra = _leading(self.window(at[more] + count[more]))
            count[more] += extra
            more = more[(extra == SEEN) & (at[more] + count[more] < self.end)]
        self.at[rows] += count + 1
        return count


#: Leading bits that ``_leading`` looks at; a double holds so many.
SEEN = 53


def _leading(w: np.ndarray) -> np.ndarray:
    """Leading zeros among the first SEEN bits of 64-bit words."""
    top = (w >> np.uint64(64 - SEEN)).astype(np.float64)
    return np.where(top > 0, SEEN - np.frexp(top)[1], SEEN).astype(np.int64)


def _signed(v: np.ndarray, width) -> np.ndarray:
    half = np.left_shift(1, np.asarray(width, np.int64) - 1)
    return (v ^ half) - half


def decode_frames(data: np.ndarray, body: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Samples (n x size) of mono frames whose subframes begin at ``body``; damaged frames give any values."""
    n = len(body)
    cur = Bits(data, body)
    kind = cur.read(8) >> 1
    wasted = np.zeros(n, np.int64)
    odd = np.flatnonzero(data[body] & 1)
    if len(odd):
        wasted[odd] = cur.unary(odd) + 1
    depth = np.maximum(bits - wasted, 1)
    out = np.zeros((size, n), np.int64)
    rows = np.flatnonzero(kind == 0)
    if len(rows):
        out[:, rows] = _signed(cur.read(depth[rows], rows), depth[rows])
    rows = np.flatnonzero(kind == 1)
    for i in range(size) if len(rows) else ():
        out[i, rows] = _signed(cur.read(depth[rows], rows), depth[rows])
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    order = np.where(fixed, kind - 8, np.where(lpc, (kind & 31) + 1, 0))
    rows = np.flatnonzero(fixed | lpc)
    if len(rows):
        out[:, rows] = _predicted(cur, rows, order[rows], lpc[rows], depth[rows], size)
    return (out << wasted).T


def _predicted(cur: Bits, rows: np.ndarray, order: np.ndarray, lpc: np.ndarray, depth: np.ndarray, size: int) -> np.ndarray:
    """Samples (size x rows) of frames with a fixed or linear predictor."""
    n, most = len(rows), int(order.max())
    out = np.zeros((most + size, n), np.int64)  # ``most`` zero rows stand before the first sample
    for i in range(most):
        some = order > i
        out[most + i, some] = _signed(cur.read(depth[some], rows[some]), depth[some])
    coef, shift = np.zeros((most, n), np.int64), np.zeros(n, np.int64)
    for o in range(5):
        some = np.flatnonzero(~lpc & (order == o))
        if len(some):
            coef[:o, some] = np.array(FIXED[o], np.int64)[:, None]
    some = np.flatnonzero(lpc)
    if len(some):
        precision = cur.read(4, rows[some]) + 1
        shift[some] = np.maximum(_signed(cur.read(5, rows[some]), 5), 0)
        for j in range(most):
            has = order[some] > j
            coef[j, some[has]] = _signed(cur.read(precision[has], rows[some[has]]), precision[has])
    wide = cur.read(2, rows)  # 0: 4-bit, 1: 5-bit parameters
    parts = cur.read(4, rows)
    step = np.maximum(size >> parts, 1)
    width = np.where(wide == 1, 5, 4)
    param, raw = np.zeros(n, np.int64), np.zeros(n, bool)
    turned = coef[::-1].copy()
    same = bool((step == step[0]).all() and (width == width[0]).all())
    for i in range(size):
        if not same or i % int(step[0]) == 0:
            fresh = np.flatnonzero(i % step == 0)
            if len(fresh):
                param[fresh] = cur.read(width[fresh], rows[fresh])
                raw[fresh] = param[fresh] == np.where(wide[fresh] == 1, 31, 15)
                esc = fresh[raw[fresh]]
                if len(esc):
                    param[esc] = cur.read(5, rows[esc])
                all_rice = not raw.any()
        live = None if i >= most else np.flatnonzero(order <= i)
        if live is None and all_rice:
            q = cur.unary(rows)
            value = q << param | cur.read(param, rows)
            res = value >> 1 ^ -(value & 1)
            out[most + i] = res + ((turned * out[i : i + most]).sum(0) >> shift if most else 0)
            continue
        live = np.arange(n) if live is None else live
        res = np.zeros(n, np.int64)
        rice, esc = live[~raw[live]], live[raw[live]]
        q = cur.unary(rows[rice])
        value = q << param[rice] | cur.read(param[rice], rows[rice])
        res[rice] = value >> 1 ^ -(value & 1)
        if len(esc):
            v = cur.read(param[esc], rows[esc])
            res[esc] = np.where(param[esc] > 0, _signed(v, np.maximum(param[esc], 1)), 0)
        out[most + i, live] = res[live] + ((turned[:, live] * out[i : i + most, live]).sum(0) >> shift[live] if most else 0)
    return out[most:]


def decode_many(streams: list[bytes]) -> list[list[tuple[int, int, bool, bytes | None]]]:
    """For each stream its blocks (sample offset, samples, ok, PCM); PCM is signed, little-endian, whole bytes.

    A stream that cannot be read gives one block (0, 0, False, None).
    """
    out: list[list] = [[] for _ in streams]
    todo: dict[tuple[int, int], list] = {}
    whole = b"".join(streams)
    base = 0
    for k, data in enumerate(streams):
        try:
            s = Stream(data)
            if s.channels != 1:
                raise ValueError("only mono is read")
            places = s.frames()
            if sum(1 for _ in places) * s.block < s.samples:
                raise ValueError("frames are missing")
            for number, a, b, e in places:
                size = s.block if s.block == BLOCK and data[a + 2] >> 4 == 2 else block_size(data, a)
                out[k].append((number * s.block, size, False, None))
                todo.setdefault((size, s.bits), []).append((k, len(out[k]) - 1, base + a, base + b, base + e))
        except (ValueError, IndexError, struct.error):
            out[k] = [(0, 0, False, None)]
        base += len(data)
    raw = np.frombuffer(whole, np.uint8)
    for (size, bits), places in todo.items():
        places = [p for p in places if len(out[p[0]]) > p[1] and out[p[0]][p[1]][1]]
        for at in range(0, len(places), FRAMES):
            part = np.array(places[at : at + FRAMES], np.int64)
            low, high = int(part[:, 2].min()), int(part[:, 4].max())
            data = raw[low:high]
            ok = crc16(_aligned(data, part[:, 2] - low, part[:, 4] - low)) == 0  # over the frame with its own CRC
            good = part[ok]
            if len(good):
                x = decode_frames(data, good[:, 3] - low, size, bits)
                pcm = x.astype(np.int8 if bits <= 8 else "<i2" if bits <= 16 else "<i4")
                for (k, i), row in zip(good[:, :2].tolist(), pcm):
                    out[k][i] = (out[k][i][0], size, True, row.tobytes())
    return out


def read_samples(data: bytes, offset: int, count: int) -> bytes:
    """PCM bytes of ``count`` samples from ``offset`` on; only the frames that hold them are decoded."""
    s = Stream(data)
    want = [f for f in s.frames() if f[0] * s.block < offset + count and (f[0] + 1) * s.block > offset]
    if not want:
        return b""
    raw, x = np.frombuffer(data, np.uint8), []
    for _, a, b, e in want:
        if crc16(_aligned(raw, np.array([a]), np.array([e])))[0]:
            raise ValueError("a frame's checksum fails")
        x.append(decode_frames(raw[a:e], np.array([b - a]), block_size(data, a), s.bits)[0])
    first = want[0][0] * s.block
    return np.concatenate(x)[offset - first : offset - first + count].astype(np.int8 if s.bits <= 8 else "<i2" if s.bits <= 16 else "<i4").tobytes()


def intact(media: bytes, found: list[tuple]) -> bool:
    """Whether all frames hold and are, in their order, what the stream's MD5 was made of (a stream may state none)."""
    if not all(x[2] for x in found):
        return False
    told = Stream(media).md5
    return not any(told) or hashlib.md5(b"".join(x[3] for x in found)).digest() == told


def verified(media: DataFrame) -> DataFrame:
    """doc_id, frames, bad_frames, ok: each stream's frames by their checksums and the whole by its MD5; null media are left out."""
    schema = pa.schema([("doc_id", pa.int64()), ("frames", pa.int64()), ("bad_frames", pa.int64()), ("ok", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "media"):
            values = column(b, "media")
            yield batch_of(schema, [(i, len(found), sum(not x[2] for x in found), intact(m, found)) for i, m, found in zip(column(b, "doc_id"), values, decode_many(values))])

    return media.filter(F.col("media").isNotNull()).select("doc_id", "media").mapInArrow(run, "doc_id long, frames long, bad_frames long, ok boolean")


# --- Spark --------------------------------------------------------------------------------------


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media binary: each whole text as a FLAC stream (null as the empty text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            values = column(b, "text")
            media = encode_many([padded(t) for t in values])
            yield batch_of(schema, list(zip(column(b, "doc_id"), [len((t or "").encode("utf-8", "surrogatepass")) for t in values], media)))

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def blocks(media: DataFrame) -> DataFrame:
    """doc_id, sample_offset, n_samples, ok, pcm binary: one row a frame, whose offset can be sought."""
    schema = pa.schema([("doc_id", pa.int64()), ("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("ok", pa.bool_()), ("pcm", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "media"):
            rows = [(i, *x) for i, found in zip(column(b, "doc_id"), decode_many([m or b"" for m in column(b, "media")])) for x in found if x[1] or not x[2]]
            yield batch_of(schema, rows)

    return media.filter(F.col("media").isNotNull()).select("doc_id", "media").mapInArrow(run, "doc_id long, sample_offset long, n_samples long, ok boolean, pcm binary")


def features(media: DataFrame) -> DataFrame:
    """The contract's columns, from stored bytes that are read back."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("frames_ok", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "media"):
            rows = []
            media = column(b, "media")
            for i, n, m, found in zip(column(b, "doc_id"), column(b, "n_bytes"), media, decode_many(media)):
                pcm = np.frombuffer(b"".join(x[3] or b"" for x in found), np.int8)
                data = (pcm.view(np.uint8) ^ 128).tobytes()
                wide = pcm.astype(np.int64)
                said = f"blocks={len(found)};mean={int(wide.sum()) * 1000 // max(1, len(wide))};energy={int((wide * wide).sum()) // max(1, len(wide))};crossings={int(((pcm[1:] < 0) != (pcm[:-1] < 0)).sum())}"
                rows.append((i, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), said, intact(m, found)))
            yield batch_of(schema, rows)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames_ok boolean")
