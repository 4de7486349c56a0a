import hashlib
import zlib

import numpy as np
import pytest

from quire.llm import flac

SHAPES = {
    "noise": np.random.default_rng(0).integers(0, 256, 64 * 50), "zeros": np.zeros(64 * 9), "sine": np.sin(np.arange(64 * 40) / 9) * 120 + 128, "swings": np.tile([0, 255], 640),
    "steps": np.r_[np.full(1000, 128), np.full(24, 255)], "spike": np.r_[np.full(500, 128), [255], np.full(64 * 1500 - 501, 128)], "ramp": np.arange(576) % 256,
}


@pytest.mark.parametrize("name", SHAPES)
def test_round_trip(name):
    p = SHAPES[name].astype(np.uint8).tobytes()
    stream = flac.encode_streams([p])[0]
    blocks = flac.decode_streams([stream])[0]
    assert (np.frombuffer(b"".join(b for _, b in blocks), np.uint8) ^ 128).tobytes() == p
    assert [o for o, _ in blocks] == list(range(0, len(p), flac.BLOCK))


def _foreign(subframes: list[tuple[str, int]], table: bool = False) -> bytes:
    """A stream of 8-bit mono frames whose subframes are given as bits and a number of samples, without a seek table."""
    out = b"fLaC\x80" + (34).to_bytes(3, "big") + bytes(10) + (8000 << 44 | 7 << 36).to_bytes(8, "big") + bytes(16)
    for number, (bits, samples) in enumerate(subframes):
        head = bytes([0xFF, 0xF8, 0b0111 << 4, 0b001 << 1, number]) + (samples - 1).to_bytes(2, "big")
        head += bytes([flac.crc8(head)])
        bits += "0" * (-len(bits) % 8)
        frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
        data = np.frombuffer(frame, np.uint8)
        out += frame + int(flac.crc16(data, np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    return out


def _b(value: int, width: int) -> str:
    return format(value & (1 << width) - 1, f"0{width}b")


def _r(value: int, k: int) -> str:
    u = 2 * value if value >= 0 else -2 * value - 1
    return "0" * (u >> k) + "1" + (_b(u, k) if k else "")


def test_frames_of_other_writers():
    """Constant, verbatim with wasted bits, fixed with partitions and an escape code, five-bit parameters, linear with a shift."""
    rng = np.random.default_rng(6)
    constant = "0" + _b(0, 6) + "0" + _b(-7, 8), 20
    wide = [int(v) * 4 for v in rng.integers(-32, 32, 24)]
    wasted = "0" + _b(1, 6) + "1" + "01" + "".join(_b(v >> 2, 6) for v in wide), 24
    walk = np.cumsum(rng.integers(-3, 4, 32)).tolist()
    d = np.diff(walk).tolist()
    fixed = "0" + _b(9, 6) + "0" + _b(walk[0], 8) + _b(0, 2) + _b(2, 4)  # order 1, four partitions
    fixed += _b(1, 4) + "".join(_r(v, 1) for v in d[:7]) + _b(15, 4) + _b(4, 5) + "".join(_b(v, 4) for v in d[7:15])
    fixed += _b(0, 4) + "".join(_r(v, 0) for v in d[15:23]) + _b(2, 4) + "".join(_r(v, 2) for v in d[23:])
    five = "0" + _b(8, 6) + "0" + _b(1, 2) + _b(0, 4) + _b(3, 5) + "".join(_r(v, 3) for v in walk)
    x = [3, -5, 8, 1, 0, -9, 4, 4, 7, -2]
    linear = "0" + _b(33, 6) + "0" + _b(x[0], 8) + _b(x[1], 8) + _b(4, 4) + _b(2, 5) + _b(5, 5) + _b(-3, 5) + _b(0, 2) + _b(0, 4) + _b(3, 4)
    linear += "".join(_r(x[t] - (5 * x[t - 1] - 3 * x[t - 2] >> 2), 3) for t in range(2, 10))
    stream = _foreign([constant, wasted, (fixed, 32), (five, 32), (linear, 10)])
    blocks = flac.decode_streams([stream, flac.encode_streams([bytes(64)])[0]])[0]
    got = [np.frombuffer(b, np.int8).tolist() for _, b in blocks]
    assert got == [[-7] * 20, wide, walk, walk, x] and [o for o, _ in blocks] == [0, 20, 44, 76, 108]
    own = flac.encode_streams([SHAPES["sine"].astype(np.uint8).tobytes()])[0]
    at, _, seek = flac._metadata(own)
    assert list(flac._frames(own, at, seek)) == list(flac._frames(own, at, b""))  # found without the seek table as well


def test_damage_is_found():
    p = flac.payload("some text that is long enough " * 60)[1]
    stream = flac.encode_streams([p])[0]
    for at in (10, len(stream) // 2, len(stream) - 1):
        bad = bytearray(stream)
        bad[at] ^= 8
        if at > 42:
            with pytest.raises(flac.DamagedStream):
                flac.decode_streams([bytes(bad)])


@pytest.mark.parametrize("name", ["edge", "docs", "empty"])
def test_digests(name, request):
    d = request.getfixturevalue(name)
    want = []
    for r in d.select("doc_id", "text").collect():
        b = (r.text or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        want.append((r.doc_id or 0, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    got = [(r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in flac.digests(d).collect()]
    assert sorted(got) == sorted(want)


def test_blocks_are_seekable(docs):
    media = flac.encode(docs.limit(20))
    blocks = flac.pcm_blocks(media).collect()
    assert all(b.sample_offset == b.block * flac.BLOCK and len(b.pcm) == b.n_samples for b in blocks)
    size = {r.doc_id: r.n_bytes for r in media.collect()}
    for i, n in size.items():
        raw = b"".join(bytes(b.pcm) for b in sorted((b for b in blocks if b.doc_id == i), key=lambda b: b.block))
        assert len(raw) == max(64, -(-n // 64) * 64)
