"""Motion JPEG in AVI files: writing and reading payloads, and shots from frame histograms.

A payload of 8-bit samples is cut into frames of at most 64 rows of 64 samples. Frames are
lossless JPEG (process 14: predictor 1 and Huffman codes, SOF3), one component, a restart interval
for each row, so that rows are byte-aligned in the stream and stand by themselves: all rows of all
frames of a batch are coded and decoded together, a column of samples at a time. The AVI file is a
RIFF form with hdrl, INFO, movi and idx1; every frame is an intra frame. A comment in INFO has the
payload's length, as the last frame is filled up with zeros.

Reading parses the RIFF chunks, takes the frames by idx1, parses each JPEG's markers and decodes
its scan. Lossless frames are understood at any size and with any Huffman table if they have one
component and a restart interval of one row; sequential ones, as cameras write, give the samples of
their first component. Other coding processes are refused with an error.

Shots: neighbouring frames' histograms of 16 bins are compared by their absolute difference over
the frame's samples; a shot begins where it exceeds both a floor and the mean plus three deviations
of the differences of the shot so far. Each shot is a clip row with its times.

Null and empty payloads are one frame of zeros, of which 64 bytes count. Files that aren't AVI
raise ValueError. Equal payloads give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from procweave.llm.text import slices

WIDTH, HEIGHT, FPS = 64, 64, 25
BINS, FLOOR, DEVIATIONS = 16, 0.25, 3.0

#: Code lengths of the difference categories 0 to 8: prefix-free, short for what text needs most.
#: A Huffman table of JPEG is given by the number of codes of each length and the symbols in order.
COUNTS = (0, 0, 7, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
SYMBOLS = (2, 3, 4, 5, 6, 7, 1, 0, 8)


def codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a JPEG Huffman table: codes of a length count up, the next length goes on doubled."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


_CODE, _SIZE = np.zeros(17, np.uint32), np.zeros(17, np.uint32)
for _symbol, _code, _length in codes(COUNTS, SYMBOLS):
    _CODE[_symbol], _SIZE[_symbol] = _code, _length

#: For each difference from -255 to 255: its bits (category code, then the category's own bits) and their number.
_diff = np.arange(-255, 256)
_category = np.ceil(np.log2(np.abs(_diff) + 1)).astype(np.uint32)
_extra = np.where(_diff < 0, _diff + (1 << _category.astype(np.int64)) - 1, _diff).astype(np.uint32)
DIFF_BITS, DIFF_SIZE = (_CODE[_category] << _category) | _extra, (_SIZE[_category] + _category).astype(np.uint32)


def encode_rows(samples: np.ndarray) -> list[bytes]:
    """Each row of a matrix of bytes as the entropy-coded data of a restart interval."""
    rows, width = samples.shape
    before = np.full((rows, width), 128, np.int16)
    before[:, 1:] = samples[:, :-1]
    at = (samples.astype(np.int16) - before + 255).astype(np.int32)
    bits, size = DIFF_BITS[at], DIFF_SIZE[at]
    total = size.sum(axis=1)
    most = int(total.max()) // 8 + 8 if rows else 0
    out = np.zeros((rows, most), np.uint8)
    held, n, filled, lane = np.zeros(rows, np.uint64), np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.arange(rows)
    flat = out.reshape(-1)
    base = lane * most
    for k in range(width):
        held = (held << size[:, k].astype(np.uint64)) | bits[:, k]
        n += size[:, k]
        if k % 2 or k == width - 1:  # two codes are 26 bits at most, with 15 left over fit in 64
            while True:
                full = np.flatnonzero(n >= 16)
                if not len(full):
                    break
                word = held[full] >> (n[full] - 16).astype(np.uint64)
                place = base[full] + filled[full]
                flat[place], flat[place + 1] = (word >> np.uint64(8)).astype(np.uint8), word.astype(np.uint8)
                n[full] -= 16
                filled[full] += 2
    for _ in range(2):  # the last bits, filled up with ones
        left = np.flatnonzero(n > 0)
        if len(left):
            shift = n[left] - 8
            word = np.where(shift >= 0, held[left] >> np.maximum(shift, 0).astype(np.uint64), (held[left] << np.maximum(-shift, 0).astype(np.uint64)) | ((np.uint64(1) << np.maximum(-shift, 0).astype(np.uint64)) - np.uint64(1)))
            flat[base[left] + filled[left]] = word.astype(np.uint8)
            filled[left] += 1
            n[left] -= 8
    return [out[r, : filled[r]].tobytes().replace(b"\xff", b"\xff\x00") for r in range(rows)]


def decode_rows(rows: list[bytes], width: int, table: list[tuple[int, int, int]]) -> np.ndarray:
    """The samples of restart intervals of one row each."""
    longest = max(length for _, _, length in table)
    symbol, length = np.zeros(1 << longest, np.int64), np.zeros(1 << longest, np.int64)
    for s, code, n in table:
        part = slice(code << (longest - n), (code + 1) << (longest - n))
        symbol[part], length[part] = s, n
    plain = [r.replace(b"\xff\x00", b"\xff") for r in rows]
    most = max(map(len, plain)) + 8
    data = np.frombuffer(b"".join(r.ljust(most, b"\xff") for r in plain), np.uint8).reshape(len(rows), most)
    # every place's next 32 bits, so that a symbol and its bits come from one word
    flat = np.zeros(data.size + 8, np.uint64)
    flat[: data.size] = data.reshape(-1)
    words = ((flat[:-7] << np.uint64(32)) | (flat[1:-6] << np.uint64(24)) | (flat[2:-5] << np.uint64(16)) | (flat[3:-4] << np.uint64(8)) | flat[4:-3]).astype(np.int64)
    at = np.arange(len(rows), dtype=np.int64) * most * 8
    limit = at + np.array([len(r) * 8 for r in plain])
    out, last = np.empty((len(rows), width), np.uint8), np.full(len(rows), 128, np.int64)
    mask = (1 << longest) - 1
    for k in range(width):
        word = words[at >> 3]
        bit = at & 7
        top = (word >> (40 - longest - bit)) & mask
        s, n = symbol[top], length[top]
        extra = (word >> (40 - bit - n - s)) & ((1 << s) - 1)
        value = np.where(extra < (1 << s) >> 1, extra - (1 << s) + 1, extra)
        last = (last + value) & 0xFF
        out[:, k] = last
        at += n + s
    if (at > limit).any():
        raise ValueError("a restart interval ends before its row does")
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(width: int, height: int) -> bytes:
    """Everything before the scan's data: SOI, SOF3, DHT, DRI, SOS."""
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xC3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)),
            _segment(0xC4, bytes([0, *COUNTS, *SYMBOLS])),
            _segment(0xDD, struct.pack(">H", width)),
            _segment(0xDA, bytes([1, 1, 0, 1, 0, 0])),
        )
    )


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def avi(frames: list[bytes], width: int, height: int, comment: str, fps: int = FPS) -> bytes:
    """An AVI file of JPEG frames."""
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form)))
    index, movi, at = [], [], 4
    for frame in frames:
        movi.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(movi[-1])
    body = head + _list(b"INFO", _chunk(b"ICMT", comment.encode() + b"\0")) + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def padded(text: bytes | None, multiple: int = WIDTH) -> bytes:
    text = text or b""
    return text + b"\0" * (-len(text) % multiple if text else multiple)


def write_payloads(payloads: list[bytes], height: int = HEIGHT) -> list[bytes]:
    """An AVI file for each payload; a payload is a positive multiple of WIDTH bytes."""
    counts, whole = [], []
    heights = [min(height, len(p) // WIDTH) for p in payloads]
    for p, h in zip(payloads, heights, strict=True):
        whole.append(p + b"\0" * (-len(p) % (WIDTH * h)))
        counts.append(len(whole[-1]) // (WIDTH * h))
    rows = encode_rows(np.frombuffer(b"".join(whole), np.uint8).reshape(-1, WIDTH))
    restarts, out, at = [bytes([0xFF, 0xD0 + k]) for k in range(8)], [], 0
    for payload, h, n in zip(payloads, heights, counts, strict=True):
        head, frames = _frame_head(WIDTH, h), []
        between = [restarts[k % 8] for k in range(h - 1)] + [b""]
        for _ in range(n):
            scan = [b""] * (2 * h)
            scan[::2], scan[1::2] = rows[at : at + h], between
            frames.append(b"".join((head, *scan, b"\xff\xd9")))
            at += h
        out.append(avi(frames, WIDTH, h, f"payload={len(payload)}"))
    return out


def riff_chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks in a part of a file."""
    while start + 8 <= end:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        if start + 8 + size > end:
            raise ValueError(f"chunk {name!r} is longer than what holds it")
        yield name, start + 8, start + 8 + size
        start += 8 + size + size % 2


def parse_avi(data: bytes) -> dict:
    """microseconds (of a frame), comment, and frames as (start, end) by the index, or by the movi list without one."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"microseconds": 0, "comment": "", "frames": []}
    index = movi = None
    first = 8 + struct.unpack_from("<I", data, 4)[0]
    for name, a, b in riff_chunks(data, 12, first):
        if name == b"LIST" and data[a : a + 4] == b"movi":
            movi = (a, b)
        elif name == b"LIST":
            for inner, c, d in riff_chunks(data, a + 4, b):
                if inner == b"avih":
                    out["microseconds"] = struct.unpack_from("<I", data, c)[0]
                elif inner == b"ICMT":
                    out["comment"] = data[c:d].rstrip(b"\0").decode("utf-8", "replace")
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, k) for k in range(a, b - 15, 16)]
    if movi is None:
        raise ValueError("an AVI file without frames")
    if index is None:
        out["frames"] = list(movi_frames(data, *movi))
    else:
        # offsets count from the movi list's name or from the file's start
        origin = movi[0] if not index or data[movi[0] + index[0][2] : movi[0] + index[0][2] + 4] == index[0][0] else 0
        out["frames"] = [(origin + at + 8, origin + at + 8 + size) for name, _, at, size in index if name[2:] in (b"dc", b"db")]
    # longer files go on in forms of their own, whose frames are found in their lists
    at = first + first % 2
    while data[at : at + 4] == b"RIFF" and data[at + 8 : at + 12] == b"AVIX":
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        for name, a, b in riff_chunks(data, at + 12, end):
            if name == b"LIST" and data[a : a + 4] == b"movi":
                out["frames"] += movi_frames(data, a, b)
        at = end + end % 2
    if any(b > len(data) or a > b for a, b in out["frames"]):
        raise ValueError("a frame beyond the file's end")
    return out


def movi_frames(data: bytes, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The frames of a movi list, or of a group in it."""
    for name, a, b in riff_chunks(data, start + 4, end):
        if name == b"LIST" and data[a : a + 4] == b"rec ":
            yield from movi_frames(data, a, b)
        elif name[2:] in (b"dc", b"db"):
            yield a, b


def parse_frame(data: bytes, start: int, end: int) -> tuple[int, int, list[tuple[int, int, int]], int, int]:
    """(width, height, Huffman table, scan start, scan end) of a lossless JPEG."""
    if data[start : start + 2] != b"\xff\xd8":
        raise ValueError("a frame that isn't JPEG")
    at, width, height, table, restart = start + 2, 0, 0, None, 0
    while at + 4 <= end:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = at + 4
        if marker == 0xC3:
            precision, height, width, parts = struct.unpack_from(">BHHB", data, body)
            if precision != 8 or parts != 1:
                raise ValueError("only 8-bit frames of one component are decoded")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC4:
            raise ValueError(f"coding process {marker:#x} is not decoded, only lossless (0xc3)")
        elif marker == 0xC4:
            counts = tuple(data[body + 1 : body + 17])
            table = codes(counts, tuple(data[body + 17 : body + 17 + sum(counts)]))
        elif marker == 0xDD:
            restart = struct.unpack_from(">H", data, body)[0]
        elif marker == 0xDA:
            if table is None or restart != width or not width:
                raise ValueError("a Huffman table and restart intervals of one row are needed")
            if data[body + 3] != 1:
                raise ValueError("only predictor 1 is decoded")
            if width * height > 8 * (end - at):
                raise ValueError("fewer bits than pixels")
            return width, height, table, at + 2 + size, end - 2
        at += 2 + size
    raise ValueError("a frame without a scan")


def zigzag() -> np.ndarray:
    """The place, row by row, of each of a block's 64 coefficients in the order they are coded: along
    the diagonals, up on even ones and down on odd ones."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = zigzag()
_k = np.arange(8)
#: The cosine transform of eight samples, a row for each frequency.
DCT = np.sqrt(np.where(_k == 0, 1 / 8, 2 / 8))[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)


def coding(data: bytes, start: int, end: int) -> int:
    """The marker of a frame's coding process: 0xC0 and 0xC1 are sequential, 0xC3 is lossless."""
    at = start + 2
    while at + 4 <= end:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            return data[at + 1]
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    raise ValueError("a frame without a coding process")


class _Bits:
    """A restart interval's bits; codes are looked up sixteen bits at a time."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8, np.uint8).astype(np.int64)
        self.words = ((raw[:-4] << 32) | (raw[1:-3] << 24) | (raw[2:-2] << 16) | (raw[3:-1] << 8) | raw[4:]).tolist()
        self.at, self.limit = 0, (len(raw) - 8) * 8

    def take(self, n: int) -> int:
        if self.at + n > self.limit:
            raise ValueError("a scan ends before its blocks do")
        out = (self.words[self.at >> 3] >> (40 - (self.at & 7) - n)) & ((1 << n) - 1)
        self.at += n
        return out

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        top = (self.words[self.at >> 3] >> (24 - (self.at & 7))) & 0xFFFF
        self.at += table[1][top]
        if not table[1][top] or self.at > self.limit:
            raise ValueError("a code that the table doesn't have")
        return table[0][top]

    def signed(self, size: int) -> int:
        value = self.take(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def decode_sequential(data: bytes, start: int, end: int) -> np.ndarray:
    """The first component, as samples, of a sequential Huffman-coded JPEG of 8 bits, at its own size.

    Tables must be in the frame. Other components are decoded only to go on in the stream."""
    at, quant, tables, parts, restart = start + 2, {}, {}, [], 0
    while at + 4 <= end:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                quant[name] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int64)
                k += 65 + 64 * wide
        elif marker in (0xC0, 0xC1):
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("only 8-bit frames are decoded")
            parts = [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]] for k in range(n)]
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = tuple(body[k + 1 : k + 17])
                symbols, lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
                for symbol, code, length in codes(counts, tuple(body[k + 17 : k + 17 + sum(counts)])):
                    symbols[code << (16 - length) : (code + 1) << (16 - length)] = symbol
                    lengths[code << (16 - length) : (code + 1) << (16 - length)] = length
                tables[body[k]] = (symbols.tolist(), lengths.tolist())
                k += 17 + sum(counts)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            used = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, 16 + (body[2 + 2 * k] & 15)) for k in range(body[0])}
            scan = data[at + 2 + size : end - 2]
            break
        at += 2 + size
    else:
        raise ValueError("a frame without a scan")
    if not parts or set(used) != {p[0] for p in parts} or any(t not in tables for pair in used.values() for t in pair) or any(p[3] not in quant for p in parts):
        raise ValueError("a frame whose tables or components are not all in one scan")
    if len(parts) == 1:
        parts[0][1] = parts[0][2] = 1
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    wide, high = -(-width // (8 * across)), -(-height // (8 * down))
    for marker in _RESTARTS[1:]:
        scan = scan.replace(marker, _RESTARTS[0])
    if wide * high > 4 * len(scan) + 8:
        raise ValueError("fewer bits than blocks")
    streams = [_Bits(x) for x in (scan.split(_RESTARTS[0]) if restart else [scan])]
    first = parts[0]
    blocks = np.zeros((high * first[2], wide * first[1], 64))
    last: list[int] = []
    for unit in range(wide * high):
        if unit % (restart or wide * high) == 0:
            bits, last = streams[unit // (restart or wide * high)], [0] * len(parts)
        for k, (name, h, v, _) in enumerate(parts):
            dc, ac = (tables[t] for t in used[name])
            for b in range(h * v):
                found = [0] * 64
                last[k] += bits.signed(bits.symbol(dc))
                found[0], place = last[k], 1
                while place < 64:
                    run, size = divmod(bits.symbol(ac), 16)
                    if not size:
                        if run != 15:
                            break
                        place += 16
                        continue
                    place += run
                    if place > 63:
                        raise ValueError("a run beyond its block")
                    found[place] = bits.signed(size)
                    place += 1
                if k == 0:
                    blocks[unit // wide * v + b // h, unit % wide * h + b % h] = found
    own = np.zeros_like(blocks)
    own[:, :, ZIGZAG] = blocks * quant[first[3]]
    samples = DCT.T @ own.reshape(*blocks.shape[:2], 8, 8) @ DCT + 128
    whole = np.clip(np.rint(samples), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1)
    return whole[: -(-height * first[2] // down), : -(-width * first[1] // across)]


_RESTARTS = [bytes([0xFF, 0xD0 + k]) for k in range(8)]


def read_payloads(files: list[bytes]) -> list[tuple[bytes, np.ndarray, int]]:
    """(payload, frames as an array n x height x width, microseconds of a frame) of each file."""
    found, rows = [], {}
    for data in files:
        info, own = parse_avi(data), []
        for a, b in info["frames"]:
            if coding(data, a, b) in (0xC0, 0xC1):
                own.append(decode_sequential(data, a, b))
                continue
            width, height, table, c, d = parse_frame(data, a, b)
            scan = data[c:d]
            # no code makes FF before a byte other than 0, so every FF D0..D7 is a restart marker
            for marker in _RESTARTS[1 : max(1, min(8, height))]:
                scan = scan.replace(marker, _RESTARTS[0])
            parts = scan.split(_RESTARTS[0])
            if len(parts) != height:
                raise ValueError("restart markers don't match the frame's rows")
            lanes = rows.setdefault((width, tuple(table)), [])
            own.append((width, tuple(table), len(lanes), height))
            lanes += parts
        found.append((info, own))
    decoded = {k: decode_rows(lanes, k[0], list(k[1])) for k, lanes in rows.items()}
    out = []
    for info, own in found:
        frames = np.stack([x if isinstance(x, np.ndarray) else decoded[x[0], x[1]][x[2] : x[2] + x[3]] for x in own]) if own else np.zeros((0, 0, 0), np.uint8)
        length = int(info["comment"].partition("payload=")[2] or frames.size)
        out.append((frames.tobytes()[:length], frames, info["microseconds"]))
    return out


#: What reading a file that isn't right may end in.
BROKEN = (ValueError, IndexError, KeyError, TypeError, OverflowError, ZeroDivisionError, struct.error)


def read_safely(files: list[bytes]) -> list[tuple[tuple[bytes, np.ndarray, int] | None, str | None]]:
    """read_payloads(), each beside null, or null beside the error of a file that can't be read."""
    try:
        return [(x, None) for x in read_payloads(files)]
    except BROKEN as error:
        if len(files) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
    return [x for f in files for x in read_safely([f])]


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of each shot."""
    n = len(frames)
    if not n:
        return []
    size = frames[0].size
    bins = (frames.reshape(n, -1) >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    histograms = np.bincount(bins.reshape(-1), minlength=n * BINS).reshape(n, BINS)
    apart = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / (2 * size)
    cuts, seen, total, squares = [0], 0, 0.0, 0.0
    for k, d in enumerate(apart.tolist(), 1):
        mean = total / seen if seen else 0.0
        deviation = max(squares / seen - mean * mean, 0.0) ** 0.5 if seen else 0.0
        if d > FLOOR and d > mean + DEVIATIONS * deviation:
            cuts.append(k)
            seen, total, squares = 0, 0.0, 0.0
        else:
            seen, total, squares = seen + 1, total + d, squares + d * d
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def clips(media: DataFrame, media_id: str = "media_id", content: str = "content") -> DataFrame:
    """(media_id, clip, first_frame, last_frame, start_s, end_s, error) of AVI files; a null file has no clips.

    A file that is broken or coded in a way that isn't decoded has one row, all null but the error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, content):
            at, out = [], []
            data = batch.column(1).to_pylist()
            have = [i for i, x in enumerate(data) if x is not None]
            for i, (read, error) in zip(have, read_safely([data[i] for i in have]), strict=True):
                if read is None:
                    at.append(i)
                    out.append((None, None, None, None, None, error))
                    continue
                _, frames, micro = read
                for k, (a, b) in enumerate(shots(frames)):
                    at.append(i)
                    out.append((k, a, b - 1, a * micro / 1e6, b * micro / 1e6, None))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["media_id", "clip", "first_frame", "last_frame", "start_s", "end_s", "error"])

    kind = media.schema[media_id].dataType.simpleString()
    return media.select(media_id, content).mapInArrow(rows, f"media_id {kind}, clip int, first_frame int, last_frame int, start_s double, end_s double, error string")


def stored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, content): each text's bytes, filled up to a multiple of 64, as an AVI file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            files = write_payloads([padded(t) for t in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["doc_id", "content"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(rows, f"doc_id {kind}, content binary")


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as an AVI file and read back: sizes, hashes of what was read, its shots and their times."""
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips")
    span = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            files = write_payloads([padded(t) for t in texts])
            out = []
            for t, f, (payload, frames, micro) in zip(texts, files, read_payloads(files), strict=True):
                found = shots(frames)
                feature = f"frames={len(frames)};shots={len(found)};cuts={','.join(str(a) for a, _ in found)}"
                out.append((len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature, [{"start_s": a * micro / 1e6, "end_s": b * micro / 1e6} for a, b in found]))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], ["doc_id", *names])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(rows, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<start_s:double,end_s:double>>")
