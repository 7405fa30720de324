"""FLAC media columns: 8-bit mono payloads as FLAC streams, read back block by block.

A stream has STREAMINFO (with the MD5 of the samples), a SEEKTABLE with the byte offset of every
frame (of every n-th, where there are more than fit) and frames of ``BLOCK`` samples.  The encoder
takes the smallest of constant, verbatim and fixed-predictor subframes with Rice-coded residuals.
The decoder handles constant, verbatim, fixed and LPC subframes, both Rice methods with any
partition order and escapes, and wasted bits; it verifies each header's CRC-8, each frame's CRC-16,
frame numbers, seek offsets and the MD5.  Both work on all frames of a batch in step: one NumPy
operation a sample place (or byte place), over all frames.

Samples can be read from any offset: ``read_samples`` and ``pcm_range`` begin at the seek point before it.

Null texts are empty payloads (one block of blanks); equal payloads give equal streams, rows that
repeat give equal rows, null ids stay null, an empty table gives an empty result.  A text takes some
hundred bytes of memory a byte while its frames are coded.  Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks

BLOCK, RATE = 192, 8000
#: Seek points that fit into one metadata block.
MAX_POINTS = (1 << 24) // 18 - 1
#: Frames handled in step.
LANES = 1 << 15


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
        out.append(c)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: Coefficients of the fixed predictors, from differences of order 0 to 4.
FIXED = [[(-1) ** (j + 1) * int(np.prod(range(k - j + 1, k + 1)) // np.prod(range(1, j + 1))) for j in range(1, k + 1)] for k in range(5)]


def _crc(buf: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """CRC of buf[start : start + size] in every lane."""
    crc = np.zeros(len(start), np.uint16)
    table = CRC8 if bits == 8 else CRC16
    least = int(size.min()) if len(size) else 0
    for j in range(int(size.max()) if len(size) else 0):
        if j < least:
            byte = buf[start + j]
            crc = table[crc ^ byte] if bits == 8 else (crc << 8) ^ table[(crc >> 8) ^ byte]
        else:
            on = np.flatnonzero(size > j)
            byte, c = buf[start[on] + j], crc[on]
            crc[on] = table[c ^ byte] if bits == 8 else (c << 8) ^ table[(c >> 8) ^ byte]
    return crc


def _coded_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes [lanes, 6], length) of frame numbers in the UTF-8-like code."""
    length = 1 + sum((n >= lim).astype(np.int64) for lim in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26))
    out = np.zeros((len(n), 6), np.uint8)
    for size in np.unique(length):
        on, x = length == size, n[length == size]
        if size == 1:
            out[on, 0] = x
            continue
        out[on, 0] = (0xFF00 >> size & 0xFF) | x >> 6 * (size - 1)
        for j in range(1, size):
            out[on, j] = 0x80 | (x >> 6 * (size - 1 - j) & 0x3F)
    return out, length


def _frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoded frames of samples [lanes, BLOCK] (int16, -128..127): (bytes, frame lengths)."""
    lanes = len(samples)
    bits = np.full(lanes, 8 * BLOCK, np.int64)  # of the subframe's body
    kind, rice = np.full(lanes, 1, np.uint8), np.zeros(lanes, np.int64)  # subframe type code
    diff = samples
    for order in range(5):
        if order:
            diff = diff[:, 1:] - diff[:, :-1]
        folded = ((diff << 1) ^ (diff >> 15)).astype(np.uint16)
        total = folded.sum(1, dtype=np.int64)
        guess = np.maximum(0, np.ceil(np.log2(np.maximum(total / folded.shape[1], 1e-9) * 0.6931 + 1e-9))).astype(np.int64)
        for k in (np.clip(guess - 1, 0, 14), np.clip(guess, 0, 14)):
            cost = 8 * order + 10 + folded.shape[1] * (1 + k) + (folded >> k[:, None].astype(np.uint16)).sum(1, dtype=np.int64)
            better = cost < bits
            bits[better], kind[better], rice[better] = cost[better], 8 + order, k[better]
    flat = (samples == samples[:, :1]).all(1)
    kind[flat], bits[flat] = 0, 8
    number, nlen = _coded_number(numbers)
    head = 5 + nlen
    body = 1 + (bits + 7) // 8
    size = head + body + 2
    end = np.cumsum(size)
    at = end - size
    out = np.zeros(int(end[-1]), np.uint8)
    # sync and fixed block size; 192 samples at 8 kHz; mono, 8 bits
    for j, byte in enumerate((0xFF, 0xF8, 0x14, 0x02)):
        out[at + j] = byte
    for j in range(int(nlen.max())):
        on = nlen > j
        out[at[on] + 4 + j] = number[on, j]
    out[at + head - 1] = _crc(out, at, head - 1, 8)
    sub = at + head
    out[sub] = kind << 1
    on = np.flatnonzero(kind == 0)
    out[sub[on] + 1] = samples[on, 0].astype(np.int8).view(np.uint8)
    on = np.flatnonzero(kind == 1)
    out[(sub[on] + 1)[:, None] + np.arange(BLOCK)] = samples[on].astype(np.int8).view(np.uint8)
    for order in range(5):
        on = np.flatnonzero(kind == 8 + order)
        if len(on):
            width = int(((bits[on] + 7) // 8).max()) * 8
            canvas = np.zeros((len(on), width), np.uint8)
            raw = samples[on].astype(np.int8).view(np.uint8)
            canvas[:, : 8 * order] = np.unpackbits(raw[:, :order], axis=1)
            k = rice[on]
            for j in range(4):
                canvas[:, 8 * order + 6 + j] = k >> (3 - j) & 1
            diff = np.diff(samples[on], order, axis=1) if order else samples[on]
            folded = ((diff << 1) ^ (diff >> 15)).astype(np.uint16).astype(np.int64)
            stop = 8 * order + 10 + np.cumsum((folded >> k[:, None]) + 1 + k[:, None], axis=1)  # after each code
            mark = stop - k[:, None] - 1
            np.put_along_axis(canvas, mark, 1, axis=1)
            for j in range(int(k.max())):  # j-th lowest bit of the remainder
                rows = np.flatnonzero(k > j)
                canvas[rows[:, None], stop[rows] - 1 - j] = folded[rows] >> j & 1
            packed = np.packbits(canvas, axis=1)
            lengths = (bits[on] + 7) // 8
            keep = np.arange(packed.shape[1]) < lengths[:, None]
            out[((sub[on] + 1)[:, None] + np.arange(packed.shape[1]))[keep]] = packed[keep]
    crc = _crc(out, at, size - 2, 16)
    out[end - 2], out[end - 1] = crc >> 8, crc & 0xFF
    return out, size


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % BLOCK if data else BLOCK)


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; lengths must be positive multiples of BLOCK."""
    if any(not p or len(p) % BLOCK for p in payloads):
        raise ValueError(f"payloads must be positive multiples of {BLOCK} bytes")
    if not payloads:
        return []
    counts = np.array([len(p) // BLOCK for p in payloads])
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts])
    parts, sizes = [], []
    for i in range(0, len(raw), LANES):
        data, size = _frames(raw[i : i + LANES].astype(np.int16) - 128, numbers[i : i + LANES])
        parts.append(data.tobytes())
        sizes.append(size)
    frames, size = b"".join(parts), np.concatenate(sizes)
    ends = np.concatenate([[0], np.cumsum(size)])
    out, first = [], 0
    for p, c in zip(payloads, counts, strict=True):
        own = ends[first : first + c + 1]
        step = -(-int(c) // MAX_POINTS)
        points = np.zeros(len(range(0, c, step)), dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        points["sample"], points["offset"], points["n"] = np.arange(0, c, step) * BLOCK, own[:-1:step] - own[0], BLOCK
        each = size[first : first + c]
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(each.min()).to_bytes(3, "big") + int(each.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        table = points.tobytes()
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + frames[own[0] : own[-1]])
        first += c
    return out


class _Bits:
    """Big-endian bit readers in step over one buffer."""

    def __init__(self, buf: np.ndarray, pos: np.ndarray):
        self.view = np.lib.stride_tricks.sliding_window_view(buf, 8)
        self.pos = pos

    def peek(self, on: np.ndarray) -> np.ndarray:
        """The next bits (57 at least) at the top of 64."""
        p = self.pos[on]
        word = np.ascontiguousarray(self.view[p >> 3]).view(">u8").ravel().astype(np.uint64)
        return word << (p & 7).astype(np.uint64)

    def read(self, on: np.ndarray, width) -> np.ndarray:
        """Unsigned numbers of width bits (0 to 32; one for all or one each)."""
        width = np.broadcast_to(np.asarray(width, np.uint64), on.shape)
        value = np.where(width > 0, self.peek(on) >> (np.uint64(64) - np.maximum(width, np.uint64(1))), np.uint64(0))
        self.pos[on] += width.astype(np.int64)
        return value.astype(np.int64)

    def signed(self, on: np.ndarray, width) -> np.ndarray:
        value, width = self.read(on, width), np.asarray(width, np.int64)
        return np.where((width > 0) & (value >> np.maximum(width - 1, 0) & 1 == 1), value - (np.int64(1) << width), value)

    def zeros(self, on: np.ndarray) -> np.ndarray:
        """Zeros before the next one; the one is read as well."""
        count, left = np.zeros(len(on), np.int64), np.arange(len(on))
        while len(left):
            top = (self.peek(on[left]) >> np.uint64(32)).astype(np.float64)
            lead = np.where(top > 0, 32 - np.frexp(top)[1], 32).astype(np.int64)
            count[left] += lead
            done = top > 0
            self.pos[on[left]] += lead + done
            left = left[~done]
        return count


def _subframes(buf: np.ndarray, start: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples [lanes, block] and the bit after each subframe that starts at a byte."""
    lanes = len(start)
    samples = np.zeros((lanes, block), np.int64)
    head = buf[start]
    if (head & 0x80).any():
        raise ValueError("broken subframe header")
    bits, every = _Bits(buf, (start + 1) * 8), np.arange(lanes)
    wasted = np.zeros(lanes, np.int64)
    on = every[(head & 1) == 1]
    if len(on):
        wasted[on] = bits.zeros(on) + 1
    depth, kind = 8 - wasted, (head >> 1).astype(np.int64)
    on = every[kind == 0]
    if len(on):
        samples[on] = bits.signed(on, depth[on])[:, None]
    on = every[(kind == 1) & (wasted == 0)]
    if len(on):
        if (bits.pos[on] & 7).any():
            raise ValueError("unaligned verbatim subframe")
        samples[on] = buf[(bits.pos[on] >> 3)[:, None] + np.arange(block)].view(np.int8)
        bits.pos[on] += 8 * block
    on = every[(kind == 1) & (wasted > 0)]
    for i in range(block if len(on) else 0):
        samples[on, i] = bits.signed(on, depth[on])
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | lpc | (kind < 2)).all():
        raise ValueError("reserved subframe type")
    on = every[fixed | lpc]
    if len(on):
        order = np.where(lpc[on], (kind[on] & 31) + 1, kind[on] - 8)
        top = int(order.max())
        for i in range(top):
            row = on[order > i]
            samples[row, i] = bits.signed(row, depth[row])
        coefs, shift = np.zeros((len(on), max(top, 1)), np.int64), np.zeros(len(on), np.int64)
        for k in range(1, min(top, 4) + 1):
            coefs[np.flatnonzero(fixed[on] & (order == k)), :k] = FIXED[k]
        lanes_lpc = np.flatnonzero(lpc[on])
        if len(lanes_lpc):
            width = bits.read(on[lanes_lpc], 4) + 1
            shift[lanes_lpc] = bits.signed(on[lanes_lpc], 5)
            for j in range(top):
                row = order[lanes_lpc] > j
                coefs[lanes_lpc[row], j] = bits.signed(on[lanes_lpc[row]], width[row])
        method = bits.read(on, 2)
        if (method > 1).any() or (shift < 0).any():
            raise ValueError("reserved residual coding or negative shift")
        parts = bits.read(on, 4)
        span = block >> parts
        pbits = 4 + method
        param, raw = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64)
        for i in range(block):
            fresh = np.flatnonzero((i % span == 0) if i else np.ones(len(on), bool))
            if len(fresh):
                param[fresh] = bits.read(on[fresh], pbits[fresh])
                esc = fresh[param[fresh] == (1 << pbits[fresh]) - 1]
                raw[fresh] = -1
                if len(esc):
                    raw[esc] = bits.read(on[esc], 5)
            go = np.flatnonzero(order <= i)
            if not len(go):
                continue
            value = np.zeros(len(go), np.int64)
            plain = raw[go] < 0
            row = go[plain]
            if len(row):
                high = bits.zeros(on[row])
                folded = high << param[row] | bits.read(on[row], param[row])
                value[plain] = folded >> 1 ^ -(folded & 1)
            row = go[~plain]
            if len(row):
                value[~plain] = bits.signed(on[row], raw[row])
            guess = np.zeros(len(go), np.int64)
            for j in range(min(top, i)):
                guess += coefs[go, j] * samples[on[go], i - 1 - j]
            samples[on[go], i] = value + (guess >> shift[go])
    return samples << wasted[:, None], bits.pos


def _stream_info(stream: bytes) -> tuple[int, int, bytes, np.ndarray, int]:
    """(block size, samples, MD5, seek points, where frames start)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, None, np.zeros(0, dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            info = block
        elif kind == 3:
            points = np.frombuffer(block, points.dtype)
        at += 4 + size
    least, most = struct.unpack(">HH", info[:4])
    packed = int.from_bytes(info[10:18], "big")
    if least != most or packed >> 41 & 7 or (packed >> 36 & 31) != 7:
        raise ValueError("only fixed blocks of mono 8-bit samples are read")
    return most, packed & (1 << 36) - 1, info[18:34], points[points["sample"] != (1 << 64) - 1], at


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """Payloads of streams, with every checksum verified."""
    infos = [_stream_info(s) for s in streams]
    out = []
    for lo, hi in chunks(streams):
        base = np.concatenate([[0], np.cumsum([len(s) for s in streams[lo:hi]])])
        buf = np.frombuffer(b"".join(streams[lo:hi]) + bytes(16), np.uint8)
        if len({i[0] for i in infos[lo:hi]}) > 1:
            raise ValueError("streams of one batch differ in block size")
        block = infos[lo][0]
        pos, number, until, limit, row = [], [], [], [], []
        first = np.concatenate([[0], np.cumsum([-(-i[1] // block) for i in infos[lo:hi]])]).astype(np.int64)
        for k, (_, n, _, points, at) in enumerate(infos[lo:hi]):
            if n % block:
                raise ValueError("the last block is short")
            starts = points["sample"].astype(np.int64) // block if len(points) else np.zeros(1, np.int64)
            offsets = points["offset"].astype(np.int64) if len(points) else np.zeros(1, np.int64)
            pos.append(base[k] + at + offsets)
            number.append(starts)
            until.append(np.append(starts[1:], n // block))
            limit.append(np.append(base[k] + at + offsets[1:], base[k + 1]))
            row.append(np.full(len(starts), first[k]))
        pos, number, until, limit, row = map(np.concatenate, (pos, number, until, limit, row))
        pcm = np.zeros((int(first[-1]), block), np.uint8)
        for i in range(0, len(pos), LANES):
            cut = slice(i, i + LANES)
            p, n, stop, end, r = (x[cut].copy() for x in (pos, number, until, limit, row))
            while len(p):
                samples, p = _read_frames(buf, p, n, block)
                pcm[r + n] = (samples + 128).astype(np.uint8)
                n = n + 1
                done = n >= stop
                if (p[done] != end[done]).any():
                    raise ValueError("a frame doesn't end where the seek table says")
                p, n, stop, end, r = (x[~done] for x in (p, n, stop, end, r))
        flat = pcm.tobytes()
        for k, (_, n, md5, _, _) in enumerate(infos[lo:hi]):
            payload = flat[first[k] * block : first[k] * block + n]
            if hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest() != md5:
                raise ValueError("samples don't match the stream's MD5")
            out.append(payload)
    return out


def read_samples(stream: bytes, start: int, count: int) -> bytes:
    """Unsigned 8-bit samples from an offset on, decoded from the seek point before it; fewer at the end."""
    block, total, _, points, at = _stream_info(stream)
    start, stop = max(start, 0), min(start + count, total)
    if start >= stop:
        return b""
    first = int(np.searchsorted(points["sample"], start, "right")) - 1
    after = int(np.searchsorted(points["sample"], stop))
    number, offset = (int(points[k][first]) for k in ("sample", "offset")) if first >= 0 else (0, 0)
    end = at + int(points["offset"][after]) if after < len(points) else len(stream)
    buf, place, n, out = np.frombuffer(stream[at + offset : end] + bytes(16), np.uint8), np.zeros(1, np.int64), number // block, []
    while n * block < stop:
        samples, place = _read_frames(buf, place, np.array([n]), block)
        out.append((samples[0] + 128).astype(np.uint8).tobytes())
        n += 1
    return b"".join(out)[start - number : stop - number]


def _read_frames(buf: np.ndarray, p: np.ndarray, number: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    if (buf[p] != 0xFF).any() or (buf[p + 1] != 0xF8).any() or (buf[p + 2] >> 4 != 1).any() or block != BLOCK or (buf[p + 3] != 0x02).any():
        raise ValueError("no frame header of the stream's kind")
    lead = buf[p + 4].astype(np.int64)
    length = 1 + sum((lead >= lim).astype(np.int64) for lim in (0xC0, 0xE0, 0xF0, 0xF8, 0xFC))
    value = np.where(length == 1, lead, lead & (0x7F >> length))
    for j in range(1, int(length.max())):
        on = length > j
        value[on] = value[on] << 6 | (buf[p[on] + 4 + j] & 0x3F)
    if (value != number).any():
        raise ValueError("frame numbers are out of order")
    head = 5 + length
    if (_crc(buf, p, head - 1, 8) != buf[p + head - 1]).any():
        raise ValueError("frame header fails its CRC-8")
    samples, bit = _subframes(buf, p + head, block)
    end = (bit + 7) >> 3
    crc = buf[end].astype(np.uint16) << 8 | buf[end + 1]
    if (_crc(buf, p, end - p, 16) != crc).any():
        raise ValueError("frame fails its CRC-16")
    return samples, end + 2


def features(payload: bytes) -> str:
    """Counts over the samples: sum, energy, least and largest, sign changes, share of each quarter of the range."""
    s = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    quarters = np.bincount((s + 128) >> 6, minlength=4)
    crossings = int(((s[1:] < 0) != (s[:-1] < 0)).sum())
    return f"n={len(s)};sum={int(s.sum())};energy={int((s * s).sum())};min={int(s.min())};max={int(s.max())};crossings={crossings};quarters={','.join(map(str, quarters))}"


def _batches(batches, column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Pieces of batches small enough for one step, with the values of one column."""
    for b in batches:
        values = b.column(column).to_pylist()
        for i, j in chunks(values):
            yield b.slice(i, j - i), values[i:j]


def to_flac(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (before padding) and the FLAC stream of each text's padded UTF-8 bytes."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b, texts in _batches(batches, 1):
            raw = [(t or "").encode() for t in texts]
            media = encode_streams([pad(r) for r in raw])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select(df[doc_id], df[text]).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def pcm_blocks(media: DataFrame, samples_per_block: int = 64 * BLOCK) -> DataFrame:
    """A row for each block of samples: doc_id, sample_offset, pcm (unsigned 8-bit)."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b, streams in _batches(batches, 1):
            ids, offsets, pcm = [], [], []
            for i, p in zip(b.column(0).to_pylist(), decode_streams(streams), strict=True):
                for at in range(0, len(p), samples_per_block):
                    ids.append(i)
                    offsets.append(at)
                    pcm.append(p[at : at + samples_per_block])
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(offsets, pa.int64()), pa.array(pcm, pa.binary())], names=["doc_id", "sample_offset", "pcm"])

    return media.select("doc_id", "media").filter("media is not null").mapInArrow(run, f"doc_id {kind}, sample_offset bigint, pcm binary")


def pcm_range(media: DataFrame, start: int, count: int) -> DataFrame:
    """doc_id, sample_offset, pcm: so many samples of each stream from an offset on, without decoding what lies before."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            pcm = [read_samples(x, start, count) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(pcm), start, np.int64)), pa.array(pcm, pa.binary())], names=["doc_id", "sample_offset", "pcm"])

    return media.select("doc_id", "media").filter("media is not null").mapInArrow(run, f"doc_id {kind}, sample_offset bigint, pcm binary")


def media_digest(media: DataFrame) -> DataFrame:
    """What reading the stored streams back gives: lengths, digests, features."""
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b, streams in _batches(batches, 2):
            back = decode_streams(streams)
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([len(p) for p in back], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                pa.array([zlib.crc32(p[-16:]) for p in back], pa.int64()), pa.array([len(s) for s in streams], pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in streams]), pa.array([features(p) for p in back]),
            ], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
