"""Media columns: lossless FLAC streams of 8-bit mono samples, encoded and decoded in vectorised batches.

Frames of a whole batch are coded side by side: a pass over sample positions moves all frames at once, so the
sequential parts of the format (Rice codes, predictors, checksums) cost one array operation per position.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.common import as_strings, ragged, slices

BLOCK = 1024
_BATCH_BYTES = 2 << 20
_PRECISION, _SHIFT = 9, 7  # of quantised linear predictor coefficients
# Fixed values of the format: polynomial predictors by order.
_FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


def _crc_table(width: int, poly: int) -> np.ndarray:
    c = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        c = np.where(c >> (width - 1), (c << 1) ^ poly, c << 1) & ((1 << width) - 1)
    return c


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def _crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of each byte range, all ranges in step, longest first."""
    order = np.argsort(-lengths, kind="stable")
    starts, sorted_lengths = starts[order], lengths[order]
    c = np.zeros(len(order), np.uint32)
    alive = np.searchsorted(-sorted_lengths, -np.arange(int(sorted_lengths[0]) if len(order) else 0), "left")
    for i, k in enumerate(alive.tolist()):
        c[:k] = ((c[:k] << 8) & 0xFFFF) ^ _CRC16[(c[:k] >> 8) ^ data[starts[:k] + i]]
    out = np.empty_like(c)
    out[order] = c
    return out


def _utf8_number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x3F
    while n > limit:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
    return bytes([(0xFE << (6 - len(tail))) & 0xFF | n, *reversed(tail)])


def _frame_header(number: int, size: int) -> bytes:
    """Fixed block size, 8 kHz, mono, 8 bits; the block size stands at the end of the header."""
    head = bytes([0xFF, 0xF8, 0x74, 0x02]) + _utf8_number(number) + (size - 1).to_bytes(2, "big")
    return head + bytes([_crc8(head)])


class _Bits:
    """Bit fields of many frames, packed at once: per frame a byte-aligned run of (value, width) fields."""

    @staticmethod
    def pack(values: np.ndarray, widths: np.ndarray, at: np.ndarray, total_bits: int) -> np.ndarray:
        """Place fields of at most 32 bits at given bit positions of a big-endian bit string."""
        words = (total_bits + 31) // 32 + 1
        word, room = at >> 5, 32 - (at & 31)
        over = widths - room
        high = np.where(over > 0, values >> np.maximum(over, 0).astype(np.uint64), values << np.maximum(-over, 0).astype(np.uint64))
        out = np.bincount(word, high.astype(np.float64), words)
        more = np.flatnonzero(over > 0)
        low = (values[more] << (32 - over[more]).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
        out[:words] += np.bincount(word[more] + 1, low.astype(np.float64), words)
        return out.astype(np.uint64).astype(">u4").view(np.uint8)[: (total_bits + 7) // 8]


def _blocks(payload: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Samples as a frames x BLOCK matrix (zero-filled), frame sizes, owning stream and number in its stream."""
    lengths = np.diff(offsets)
    per = -(-lengths // BLOCK)
    stream = np.repeat(np.arange(len(lengths)), per)
    number = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    begin = offsets[:-1][stream] + number * BLOCK
    size = np.minimum(BLOCK, offsets[1:][stream] - begin)
    x = np.zeros((len(stream), BLOCK), np.int32)
    rows = np.repeat(np.arange(len(stream)), size)
    x[rows, ragged(np.zeros(len(size), np.int64), size)] = payload[ragged(begin, size)].astype(np.int32) - 128
    return x, size, stream, number


def _predictors(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best of fixed orders 0 to 2 and a quantised order-2 linear predictor: kind, order, coefficients, residual."""
    inside = np.arange(BLOCK)[None, :] < size[:, None]
    one = np.zeros_like(x)
    one[:, 1:] = x[:, 1:] - x[:, :-1]
    two = np.zeros_like(x)
    two[:, 2:] = one[:, 2:] - one[:, 1:-1]
    # Least squares for x[n] ~ a x[n-1] + b x[n-2], per frame.
    f = x.astype(np.float32)
    r0 = np.einsum("ij,ij->i", f, f)
    r1 = np.einsum("ij,ij->i", f[:, 1:], f[:, :-1])
    r2 = np.einsum("ij,ij->i", f[:, 2:], f[:, :-2])
    det = np.maximum(r0 * r0 - r1 * r1, 1e-3)
    limit = 2 ** (_PRECISION - 1) - 1
    coef = np.clip(np.round(np.stack([r1 * (r0 - r2), r0 * r2 - r1 * r1], 1) / det[:, None] * (1 << _SHIFT)), -limit, limit).astype(np.int32)
    linear = np.zeros_like(x)
    linear[:, 2:] = x[:, 2:] - ((coef[:, :1] * x[:, 1:-1] + coef[:, 1:] * x[:, :-2]) >> _SHIFT)
    candidates = [x, one, two, linear]
    orders = np.array([0, 1, 2, 2])
    cost = np.stack([np.where(inside & (np.arange(BLOCK)[None, :] >= o), np.abs(c), 0).sum(1) for o, c in zip(orders, candidates, strict=True)], 1)
    kind = cost.argmin(1)
    residual = np.choose(kind[:, None], candidates)
    return kind, orders[kind], coef, residual


def encode(payload: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One FLAC stream for each payload range, of at least one byte each."""
    x, size, stream, number = _blocks(payload, offsets)
    n = len(size)
    kind, order, coef, residual = _predictors(x, size)
    sample = np.arange(BLOCK)[None, :]
    coded = (sample < size[:, None]) & (sample >= order[:, None])
    folded = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
    folded[~coded] = 0
    count = np.maximum(size - order, 1)
    mean = folded.sum(1) / count
    top = folded.max(1)
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 0, 14).astype(np.int64)
    bits = lambda k: np.where(coded, (folded >> k[:, None]) + 1 + k[:, None], 0).sum(1)
    up, here = bits(np.minimum(k + 1, 14)), bits(k)
    k = np.where(up < here, np.minimum(k + 1, 14), k)
    while ((top >> k) + 1 + k > 32).any():
        k = np.where((top >> k) + 1 + k > 32, k + 1, k)
    linear = kind == 3
    body = 8 + order * 8 + linear * (4 + 5 + 2 * _PRECISION) + 2 + 4 + 4 + bits(k)
    same = (x == x[:, :1]) | (sample >= size[:, None])
    constant = same.all(1)
    plain = ~constant & (body >= 8 + 8 * size)
    rice = ~constant & ~plain
    body = np.where(constant, 16, np.where(plain, 8 + 8 * size, body))
    heads = [_frame_header(a, b) for a, b in zip(number.tolist(), size.tolist(), strict=True)]
    head_len = np.fromiter(map(len, heads), np.int64, n)
    body_len = (body + 7) // 8
    frame_len = head_len + body_len + 2
    begin = np.cumsum(frame_len) - frame_len
    start = 8 * (begin + head_len)

    # Fields: subframe header, warm-up or raw samples, predictor, Rice parameter, Rice codes.
    values, widths, at = [], [], []

    def put(rows: np.ndarray, value, width, position) -> None:  # noqa: ANN001
        values.append(np.broadcast_to(np.asarray(value, np.int64), rows.shape).astype(np.uint64))
        widths.append(np.broadcast_to(np.asarray(width, np.int64), rows.shape))
        at.append(np.broadcast_to(np.asarray(position, np.int64), rows.shape))

    every = np.arange(n)
    code = np.where(constant, 0, np.where(plain, 1, np.where(linear, 32 + order - 1, 8 + order)))
    put(every, code << 1, 8, start)
    c = np.flatnonzero(constant)
    put(c, x[c, 0] & 0xFF, 8, start[c] + 8)
    p = np.flatnonzero(plain)
    rows, col = np.repeat(p, size[p]), ragged(np.zeros(len(p), np.int64), size[p])
    put(rows, x[rows, col] & 0xFF, 8, start[rows] + 8 + 8 * col)
    r = np.flatnonzero(rice)
    for j in range(2):
        w = r[order[r] > j]
        put(w, x[w, j] & 0xFF, 8, start[w] + 8 + 8 * j)
    after = start + 8 + 8 * order
    q = r[linear[r]]
    put(q, _PRECISION - 1, 4, after[q])
    put(q, _SHIFT, 5, after[q] + 4)
    for j in range(2):
        put(q, coef[q, j] & (2**_PRECISION - 1), _PRECISION, after[q] + 9 + j * _PRECISION)
    after = after + linear * (9 + 2 * _PRECISION)
    # Method: 4-bit parameters below 15, else 5-bit ones are not needed, as k is at most 14.
    put(r, k[r], 10, after[r])
    lengths = np.where(coded, (folded >> k[:, None]) + 1 + k[:, None], 0)[r]
    position = np.cumsum(lengths, 1) - lengths + (after[r] + 10)[:, None]
    rows, col = np.nonzero(coded[r])
    low = folded[r][rows, col] & ((1 << k[r][rows]) - 1)
    put(rows, (1 << k[r][rows]) | low, lengths[rows, col], position[rows, col])
    total = int(frame_len.sum())
    data = _Bits.pack(np.concatenate(values), np.concatenate(widths), np.concatenate(at), 8 * total).copy()
    data[ragged(begin, head_len)] = np.frombuffer(b"".join(heads), np.uint8)
    crc = _crc16(data, begin, frame_len - 2)
    data[begin + frame_len - 2], data[begin + frame_len - 1] = crc >> 8, crc & 0xFF

    out, raw = [], data.tobytes()
    first = np.searchsorted(stream, np.arange(len(offsets)))
    for s in range(len(offsets) - 1):
        a, b = first[s], first[s + 1]
        length = int(offsets[s + 1] - offsets[s])
        frames = frame_len[a:b]
        info = BLOCK.to_bytes(2, "big") * 2 + int(frames.min()).to_bytes(3, "big") + int(frames.max()).to_bytes(3, "big")
        info += (8000 << 44 | 0 << 41 | 7 << 36 | length).to_bytes(8, "big")
        signed = (payload[offsets[s] : offsets[s + 1]] ^ 0x80).tobytes()
        info += hashlib.md5(signed).digest()
        out.append(b"fLaC\x80\x00\x00\x22" + info + raw[begin[a] : begin[b - 1] + frame_len[b - 1]])
    return out


@dataclass
class Decoded:
    """Payload bytes of a batch of streams, and where each frame's samples start in its stream."""

    payload: np.ndarray
    offsets: np.ndarray
    stream: np.ndarray
    sample_offset: np.ndarray
    size: np.ndarray


class _Reader:
    """Bits at many positions of one buffer at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        word = np.zeros(len(padded) - 7, np.uint64)
        for j in range(8):
            word = (word << np.uint64(8)) | padded[j : j + len(word)]
        self.word = word  # the eight bytes from each byte on

    def window(self, at: np.ndarray) -> np.ndarray:
        """The 57 bits or more from each bit position on, left-aligned; a damaged stream's positions beyond the end read its end."""
        return self.word[np.minimum(at >> 3, len(self.word) - 1)] << (at & 7).astype(np.uint64)

    def bits(self, at: np.ndarray, width: int) -> np.ndarray:
        return (self.window(at) >> np.uint64(64 - width)).astype(np.int64) if width else np.zeros(len(at), np.int64)


def _signed(v: np.ndarray, width: int) -> np.ndarray:
    return v - ((v >> (width - 1)) << width)


def decode(streams: list[bytes]) -> Decoded:
    """Read whole streams: headers with CRC-8, subframes of every kind, residuals, frame CRC-16 and the MD5 sum.

    A stream that is damaged or outside the subset (8-bit mono, frames numbered one by one, no further metadata) raises
    ValueError. Rates and block sizes may be any that a header can say.
    """
    data = np.frombuffer(b"".join(streams), np.uint8)
    raw = data.tobytes()
    starts = np.cumsum([0, *map(len, streams)])
    totals, sums = [], []
    for one in streams:
        if one[:8] != b"fLaC\x80\x00\x00\x22":
            raise ValueError("not a stream of this subset")
        packed = int.from_bytes(one[18:26], "big")
        if (packed >> 36 & 0x1F) != 7 or packed >> 41 & 7:
            raise ValueError("not 8-bit mono")
        totals.append(packed & (1 << 36) - 1)
        sums.append(one[26:42])
    totals_ = np.array(totals, np.int64)
    offsets = np.concatenate([[0], np.cumsum(totals_)])
    reader = _Reader(data)
    payload = np.zeros(int(offsets[-1]), np.uint8)
    stream, begin, end, done, size, body = _frame_starts(data, raw, starts, totals_)
    _decode_frames(reader, data, body, end, size, offsets[:-1][stream] + done, payload)
    if (_crc16(data, begin, end - begin - 2) != (data[end - 2].astype(np.uint32) << 8 | data[end - 1])).any():
        raise ValueError("frame checksum")
    flipped = (payload ^ 0x80).tobytes()
    for s in range(len(streams)):
        if hashlib.md5(flipped[offsets[s] : offsets[s + 1]]).digest() != sums[s]:
            raise ValueError("stream checksum")
    return Decoded(payload, offsets, stream, done, size)


def _frame_head(head: bytes, number: int) -> tuple[int, int] | None:
    """(samples, bytes before the CRC-8) of the header of a stream's next frame, in 8-bit mono; None if it is none."""
    coded = _utf8_number(number)
    size, rate = head[2] >> 4 if len(head) > 4 else 0, head[2] & 15 if len(head) > 4 else 15
    # One channel; the samples' width as the stream says, or 8 bits.
    if not size or rate == 15 or head[3] not in (0, 2) or head[4 : 4 + len(coded)] != coded:
        return None
    at = 4 + len(coded)
    more = {6: 1, 7: 2}.get(size, 0)
    end = at + more + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if len(head) <= end:
        return None
    samples = int.from_bytes(head[at : at + more], "big") + 1 if more else 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    return samples, end


def _frame_starts(data: np.ndarray, raw: bytes, starts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where frames stand: positions with the sync code whose header is the next expected one and passes its CRC-8."""
    at = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] == 0xF8)).tolist()
    out: list[tuple[int, int, int, int, int]] = []
    s, done, number = -1, 0, 0
    for p in at:
        while s + 1 < len(starts) - 1 and p >= starts[s + 1]:
            if s >= 0 and done != totals[s]:
                raise ValueError("missing frames")
            s, done, number = s + 1, 0, 0
        if done == totals[s]:
            continue
        head = _frame_head(raw[p : min(p + 16, starts[s + 1])], number)
        if head is not None and done + head[0] <= totals[s] and _crc8(raw[p : p + head[1]]) == raw[p + head[1]]:
            out.append((s, p, done, head[0], p + head[1] + 1))
            done += head[0]
            number += 1
    if len(totals) and (s != len(totals) - 1 or done != totals[s]):
        raise ValueError("missing frames")
    table = np.array(out, np.int64).reshape(-1, 5)
    stream, begin = table[:, 0], table[:, 1]
    end = np.append(begin[1:], starts[-1])
    last = np.append(stream[1:] != stream[:-1], True)
    end[last] = starts[1:][stream[last]]
    return stream, begin, end, table[:, 2], table[:, 3], table[:, 4]


def _decode_frames(reader: _Reader, data: np.ndarray, body: np.ndarray, end: np.ndarray, size: np.ndarray, to: np.ndarray, payload: np.ndarray) -> None:
    """Decode all frames in step and write their samples, as unsigned bytes, to `payload` at `to`."""
    if not len(body):
        return
    code = (data[body] >> 1).astype(np.int64)
    if ((data[body] & 0x81) != 0).any():
        raise ValueError("wasted bits or padding are outside this subset")
    at = 8 * (body + 1)
    for f in np.flatnonzero(code == 0):
        payload[to[f] : to[f] + size[f]] = data[body[f] + 1] ^ 0x80
    for f in np.flatnonzero(code == 1):
        payload[to[f] : to[f] + size[f]] = data[body[f] + 1 : body[f] + 1 + size[f]] ^ 0x80
    rest = np.flatnonzero(code > 1)
    if not len(rest):
        return
    rest = rest[np.argsort(-size[rest], kind="stable")]
    code, at, size, to, limit = code[rest], at[rest], size[rest], to[rest], 8 * (end[rest] - 2)
    linear = code >= 32
    order = np.where(linear, (code & 31) + 1, code - 8)
    if ((order < 0) | (order > 32) | (~linear & (order > 4))).any():
        raise ValueError("reserved subframe")
    n, longest, depth = len(code), int(size.max()), max(1, int(order.max()))
    x = np.zeros((longest + depth, n), np.int64)  # sample-major; `depth` zero rows come first
    coef = np.zeros((depth, n), np.int64)
    shift = np.zeros(n, np.int64)
    for j in range(int(order.max())):
        w = np.flatnonzero(order > j)
        x[depth + j, w] = _signed(reader.bits(at[w] + 8 * j, 8), 8)
    at = at + 8 * order
    for o, c in _FIXED.items():
        w = np.flatnonzero(~linear & (order == o))
        for j, v in enumerate(c if len(w) else ()):
            coef[j, w] = v
    q = np.flatnonzero(linear)
    if len(q):
        precision = reader.bits(at[q], 4) + 1
        shift[q] = _signed(reader.bits(at[q] + 4, 5), 5)
        at[q] += 9
        for width in np.unique(precision):
            w = q[precision == width]
            for j in range(int(order[w].max())):
                u = w[order[w] > j]
                coef[j, u] = _signed(reader.bits(at[u] + j * int(width), int(width)), int(width))
            at[w] += order[w] * width
    method, parts = reader.bits(at, 2), reader.bits(at + 2, 4)
    if (method > 1).any():
        raise ValueError("reserved residual method")
    at = at + 6
    wide = 4 + method  # bits of a Rice parameter
    per = np.maximum(size >> parts, 1)
    k = np.zeros(n, np.int64)
    escape = np.zeros(n, bool)
    alive = np.searchsorted(-size, -np.arange(longest), "left")
    simple = bool((parts == 0).all())
    for i in range(longest):
        m = int(alive[i])
        fresh = order[:m] == i if simple and i <= depth else None
        if not simple:
            fresh = ((i % per[:m]) == 0) & (i >= order[:m]) | (order[:m] == i)
        if fresh is not None and fresh.any():
            w = np.flatnonzero(fresh)
            window = reader.window(at[w])
            k[w] = (window >> (64 - wide[w]).astype(np.uint64)).astype(np.int64)
            escape[w] = k[w] == (1 << wide[w]) - 1
            at[w] += wide[w]
            if escape[w].any():
                v = w[escape[w]]
                k[v] = reader.bits(at[v], 5)
                at[v] += 5
        window = reader.window(at[:m])
        # Leading zeros by the exponent of the nearest float: the top 53 bits are exact.
        lead = 63 - ((np.maximum(window & ~np.uint64(0x7FF), 1).astype(np.float64).view(np.int64) >> 52) - 1023)
        kk = k[:m]
        rest_ = window << np.minimum(lead + 1, 63).astype(np.uint64)
        low = np.where(kk > 0, (rest_ >> np.where(kk > 0, 64 - kk, 63).astype(np.uint64)).astype(np.int64), 0)
        value = (lead << kk) | low
        value = (value >> 1) ^ -(value & 1)
        used = lead + 1 + kk
        if escape[:m].any():
            e = np.flatnonzero(escape[:m])
            raw = (window[e] >> np.where(kk[e] > 0, 64 - kk[e], 63).astype(np.uint64)).astype(np.int64)
            value[e] = np.where(kk[e] > 0, raw - ((raw >> np.maximum(kk[e] - 1, 0)) << kk[e]), 0)
            used[e] = kk[e]
        guess = coef[0, :m] * x[depth + i - 1, :m]
        for j in range(1, depth):
            guess += coef[j, :m] * x[depth + i - 1 - j, :m]
        if i < depth:
            warm = order[:m] > i
            value = np.where(warm, x[depth + i, :m], (guess >> shift[:m]) + value)
            used[warm] = 0
        else:
            value += guess >> shift[:m]
        x[depth + i, :m] = value
        at[:m] += used
    if (at > limit).any() or (limit - at >= 8).any():
        raise ValueError("subframe length")
    samples = x[depth:].T
    inside = np.arange(longest)[None, :] < size[:, None]
    payload[ragged(to, size)] = (samples[inside] + 128).astype(np.uint8)


def payloads(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes filled with zero bytes to a positive multiple of 64: bytes, offsets, unfilled lengths."""
    from tidewire.llm.common import utf8_view

    data, offsets = utf8_view(strings)
    lengths = np.diff(offsets)
    filled = np.maximum(-(-lengths // 64), 1) * 64
    out = np.concatenate([[0], np.cumsum(filled)])
    payload = np.zeros(int(out[-1]), np.uint8)
    payload[ragged(out[:-1], lengths)] = data
    return payload, out, lengths


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text) and media (its FLAC stream). A null text counts as empty: 64 zero bytes.

    Repeated rows give equal streams; null ids stay null; other columns are ignored; one text is one stream,
    however long, in blocks of 1024 samples.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = as_strings(batch.column(1))
            for lo, hi in slices(strings, _BATCH_BYTES):
                payload, offsets, lengths = payloads(strings.slice(lo, hi - lo))
                media = pa.array(encode(payload, offsets), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lengths), media], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col(text).cast("string")).mapInArrow(run, f"doc_id {key}, n_bytes long, media binary")


def _media_slices(media: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    lo, held, size = 0, [], 0
    for i, m in enumerate(media):
        held.append(m.as_py())
        size += len(held[-1])
        if size >= _BATCH_BYTES:
            yield lo, i + 1, held
            lo, held, size = i + 1, [], 0
    if held:
        yield lo, len(media), held


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """doc_id, block, sample_offset, n_samples and pcm (unsigned 8-bit) of every stored stream, checksums verified.

    Repeated rows give their blocks each; null ids stay null; a null or damaged stream fails the job; an empty table gives
    an empty result; other columns are ignored.
    """
    key = stored.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, streams in _media_slices(batch.column(1)):
                d = decode(streams)
                at = d.offsets[:-1][d.stream] + d.sample_offset
                raw = d.payload.tobytes()
                pcm = [raw[a : a + n] for a, n in zip(at.tolist(), d.size.tolist(), strict=True)]
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(d.stream))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(d.sample_offset // BLOCK), pa.array(d.sample_offset), pa.array(d.size), pa.array(pcm, pa.binary())],
                    names=["doc_id", "block", "sample_offset", "n_samples", "pcm"],
                )

    return stored.select("doc_id", "media").mapInArrow(run, f"doc_id {key}, block long, sample_offset long, n_samples long, pcm binary")


def digests(stored: DataFrame) -> DataFrame:
    """What the stored bytes say when read back: sizes, hashes, a feature of the signal and the blocks' sample offsets.

    A row per stream, repeated rows each, in any order; null ids stay null; a null or damaged stream fails the job; an
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    key = stored.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "sample_offsets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, streams in _media_slices(batch.column(2)):
                d = decode(streams)
                raw, rows = d.payload.tobytes(), []
                level = d.payload.astype(np.int64) - 128
                energy, sign = np.concatenate([[0], np.cumsum(level * level)]), np.concatenate([[0], np.cumsum(np.abs(np.diff(level, prepend=level[:1])))])
                for s, m in enumerate(streams):
                    a, b = int(d.offsets[s]), int(d.offsets[s + 1])
                    one = raw[a:b]
                    rms = ((energy[b] - energy[a]) / (b - a)) ** 0.5
                    slope = (sign[b] - sign[min(a + 1, b)]) / max(1, b - a - 1)
                    rows.append((b - a, hashlib.sha256(one).hexdigest(), zlib.crc32(one[-64:]), len(m), hashlib.sha256(m).hexdigest(), f"rms={rms:.4f};slope={slope:.4f};frames={-(-(b - a) // BLOCK)}"))
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                ends = np.append(0, np.cumsum(np.bincount(d.stream, minlength=len(streams)))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(ends, pa.array(d.sample_offset)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *columns], names=names)

    schema = f"doc_id {key}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, sample_offsets array<long>"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
