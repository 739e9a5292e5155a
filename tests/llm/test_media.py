import hashlib
import struct
import zlib

import numpy as np
import pytest

from procweave.llm import media


def payloads():
    rng = np.random.default_rng(1)
    made = [rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 2, 63, 64, 65, 200)]
    return [*made, b"\0" * 64, b"\xff" * 128, bytes([0, 255] * 64), bytes([255, 0] * 64), ("é" * 3000).encode().ljust(6016, b"\0")]


def test_round_trip_and_equal_payloads():
    files = media.write_payloads([*payloads(), *payloads()])
    assert [p for p, _, _ in media.read_payloads(files)] == payloads() * 2
    n = len(payloads())
    assert files[:n] == files[n:]


def decode_by_hand(data, start, end):
    """A lossless JPEG frame bit by bit, straight from the coding rules."""
    width, height, table, a, b = media.parse_frame(data, start, end)
    look, out, at = {(n, c): s for s, c, n in table}, [], a
    for row in range(height):
        bits, last, got = "", 128, []
        while at < b and not (data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7):
            bits += f"{data[at]:08b}"
            at += 2 if data[at] == 0xFF else 1
        assert row == height - 1 or data[at + 1] == 0xD0 + row % 8
        at += 2
        k = 0
        for _ in range(width):
            n = 1
            while (n, int(bits[k : k + n], 2)) not in look:
                n += 1
            size = look[(n, int(bits[k : k + n], 2))]
            k += n
            extra = int(bits[k : k + size] or "0", 2)
            k += size
            last = (last + (extra if not size or extra >> (size - 1) else extra - (1 << size) + 1)) & 255
            got.append(last)
        assert set(bits[k:]) <= {"1"} and len(bits) - k < 8
        out.append(got)
    return np.array(out, np.uint8)


def test_frames_against_a_bitwise_decoder():
    for p, data in zip(payloads(), media.write_payloads(payloads()), strict=True):
        info = media.parse_avi(data)
        frames = np.concatenate([decode_by_hand(data, a, b) for a, b in info["frames"]])
        assert frames.tobytes()[: len(p)] == p


def test_riff_structure():
    data = media.write_payloads([b"x" * 64 * 130])[0]
    names = [n for n, _, _ in media.riff_chunks(data, 12, len(data))]
    assert names == [b"LIST", b"LIST", b"LIST", b"idx1"] and struct.unpack_from("<I", data, 4)[0] == len(data) - 8
    info = media.parse_avi(data)
    assert len(info["frames"]) == 3 and info["microseconds"] == 40_000
    without = data.replace(b"idx1", b"JUNK")
    assert media.parse_avi(without)["frames"] == info["frames"]


def test_what_is_not_understood_is_refused():
    data = media.write_payloads([b"x" * 64])[0]
    for bad in (b"", b"RIFF\0\0\0\0WAVE", data.replace(b"\xff\xc3", b"\xff\xc2"), data.replace(b"\xff\xc3", b"\xff\xc0"), data[: len(data) // 2]):
        with pytest.raises((ValueError, struct.error)):
            media.read_payloads([bad])


def test_shots_follow_changes_of_the_picture():
    rng = np.random.default_rng(2)
    dark, light = rng.integers(0, 40, (5, 64, 64)), rng.integers(180, 220, (7, 64, 64))
    frames = np.concatenate([dark, light, dark]).astype(np.uint8)
    assert media.shots(frames) == [(0, 5), (5, 12), (12, 17)]
    assert media.shots(frames[:1]) == [(0, 1)] and media.shots(frames[:0]) == []


def test_documents(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "long text " * 20_000, "a"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    got = {r["doc_id"]: r for r in media.described(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"]) == (len(raw), len(padded))
        assert got[i]["payload_sha256"] == hashlib.sha256(padded).hexdigest() and got[i]["tail_crc32"] == zlib.crc32(padded[-64:])
    assert got[2][1:] == got[6][1:] and got[0][1:] == got[1][1:]
    files = media.stored(docs)
    assert {r["doc_id"]: hashlib.sha256(r["content"]).hexdigest() for r in files.collect()} == {i: r["media_sha256"] for i, r in got.items()}
    rows = media.clips(files, "doc_id").orderBy("media_id", "clip").collect()
    assert {r["media_id"] for r in rows} == set(range(len(texts)))
    last = [r for r in rows if r["media_id"] == 5][-1]
    assert last["end_s"] == pytest.approx(-(-200_000 // 4096) * 0.04)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert media.described(docs).count() == 0 and media.clips(media.stored(docs), "doc_id").count() == 0


def sequential_jpeg(planes, factors, restart=0):
    """A plain encoder: codes of one length, quantization by 1 and 3. planes: whole numbers of blocks."""
    ac_symbols = [16 * r + z for r in range(16) for z in range(1, 11)] + [0x00, 0xF0]
    tables = {0x00: (4, list(range(12))), 0x10: (8, ac_symbols)}
    seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    h, w = planes[0].shape
    head = b"\xff\xd8" + seg(0xDB, bytes([0] + [1] * 64)) + seg(0xDB, bytes([1] + [3] * 64))
    head += seg(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([k + 1, a << 4 | b, min(k, 1)]) for k, (a, b) in enumerate(factors)))
    for name, (length, symbols) in tables.items():
        head += seg(0xC4, bytes([name] + [len(symbols) if n == length else 0 for n in range(1, 17)] + symbols))
    head += (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, 0]) for k in range(len(planes))) + bytes([0, 63, 0]))
    cosine = np.array([[(1 / 8 if u == 0 else 1 / 4) ** 0.5 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    code = lambda t, s: f"{tables[t][1].index(s):0{tables[t][0]}b}"
    number = lambda v: f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}" if v else ""
    order, r, c, up = [], 0, 0, True
    for _ in range(64):
        order.append((r, c))
        if up and (r == 0 or c == 7) or not up and (c == 0 or r == 7):
            r, c = (r, c + 1) if (r == 0 and up or r == 7 and not up) and c < 7 else (r + 1, c)
            up = not up
        else:
            r, c = (r - 1, c + 1) if up else (r + 1, c - 1)
    across, down = (max(f[i] for f in factors) for i in (0, 1)) if len(planes) > 1 else (1, 1)
    units, out, bits, last = (w // (8 * across), h // (8 * down)), b"", "", [0] * len(planes)

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")

    for u in range(units[0] * units[1]):
        if restart and u and u % restart == 0:
            out, bits, last = out + flush(bits) + bytes([0xFF, 0xD0 + (u // restart - 1) % 8]), "", [0] * len(planes)
        for k, plane in enumerate(planes):
            fh, fv = factors[k] if len(planes) > 1 else (1, 1)
            for b in range(fh * fv):
                y, x = (u // units[0] * fv + b // fh) * 8, (u % units[0] * fh + b % fh) * 8
                q = np.rint(cosine @ (plane[y : y + 8, x : x + 8] - 128.0) @ cosine.T / (1 if k == 0 else 3)).astype(int)
                values = [int(q[p]) for p in order]
                diff, last[k] = values[0] - last[k], values[0]
                bits += code(0x00, abs(diff).bit_length()) + number(diff)
                run, end = 0, max((i for i in range(64) if values[i]), default=0)
                for v in values[1 : end + 1]:
                    if v == 0:
                        run += 1
                        continue
                    bits += code(0x10, 0xF0) * (run // 16) + code(0x10, 16 * (run % 16) + abs(v).bit_length()) + number(v)
                    run = 0
                bits += code(0x10, 0) if end < 63 else ""
    return head + out + flush(bits) + b"\xff\xd9"


def test_sequential_frames_are_decoded():
    rng = np.random.default_rng(3)
    luma = np.add.outer(np.arange(32) * 3, np.arange(48) * 2).astype(np.uint8)
    luma[8:20, 10:30] = rng.integers(0, 256, (12, 20))
    chroma = np.full((16, 24), 90, np.uint8)
    for frame in (sequential_jpeg([luma], [(1, 1)]), sequential_jpeg([luma], [(1, 1)], 5), sequential_jpeg([luma, chroma, chroma], [(2, 2), (1, 1), (1, 1)]), sequential_jpeg([luma, chroma, chroma], [(2, 2), (1, 1), (1, 1)], 2)):
        got = media.decode_sequential(frame, 0, len(frame))
        assert got.shape == luma.shape and np.abs(got.astype(int) - luma).max() <= 2
    data = media.avi([sequential_jpeg([luma], [(1, 1)])] * 3 + [sequential_jpeg([255 - luma // 2], [(1, 1)])] * 2, 48, 32, "")
    _, frames, micro = media.read_payloads([data])[0]
    assert frames.shape == (5, 32, 48) and micro == 40_000 and media.shots(frames) == [(0, 3), (3, 5)]


def chunk(name, data):
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def test_broken_files_have_an_error_and_end_nothing(spark):
    whole = media.write_payloads([b"payload " * 400])[0]
    broken = [b"", b"RIFF", whole[:-40], whole[:30] + b"\xff" * 40 + whole[70:], whole.replace(b"payload=", b"payload=x"), whole.replace(b"\xff\xc3", b"\xff\xc2"), bytes(200), whole[: len(whole) // 2]]
    broken += [bytes(b ^ 0x55 if k % 97 == j else b for k, b in enumerate(whole)) for j in range(12)]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate([whole, *broken, None, whole])], "media_id long, content binary").coalesce(1)
    got = media.clips(docs).collect()
    good = [r for r in got if r["media_id"] in (0, len(broken) + 2)]
    assert good and all(r["error"] is None and r["clip"] is not None for r in good)
    by_id = {r["media_id"] for r in got}
    assert by_id == {*range(len(broken) + 1), len(broken) + 2}
    assert all((r["error"] is None) == (r["clip"] is not None) for r in got) and {1, 2, 6, 7} <= {r["media_id"] for r in got if r["error"]}


def test_frames_in_groups_and_later_forms():
    luma = np.add.outer(np.arange(16), np.arange(16)).astype(np.uint8) * 5
    frame = [sequential_jpeg([x], [(1, 1)]) for x in (luma, 255 - luma, luma // 2)]
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", 40_000, *[0] * 13)))
    movi = b"movi" + chunk(b"LIST", b"rec " + chunk(b"00dc", frame[0]) + chunk(b"01wb", b"xy")) + chunk(b"00dc", frame[1])
    first = chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", movi))
    data = first + chunk(b"RIFF", b"AVIX" + chunk(b"LIST", b"movi" + chunk(b"00dc", frame[2])))
    assert [data[a:b] for a, b in media.parse_avi(data)["frames"]] == frame
    _, frames, micro = media.read_payloads([data])[0]
    assert frames.shape == (3, 16, 16) and micro == 40_000
