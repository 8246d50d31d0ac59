import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cinderfold.llm.media import BrokenMedia, _box, _full, boxes, demux, feature, media_columns, mux, read_media, read_stored, store_texts


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 200), st.integers(0, 2**32 - 1))
def test_mux_round_trip(units, seed):
    payload = np.random.default_rng(seed).bytes(64 * units)
    data = mux(payload)
    track = read_media(data)[0]
    assert demux(data, track) == payload
    assert (track.codec, track.handler, track.timescale, track.duration) == ("raw ", "soun", 8000, 64 * units)
    at = data.index(b"mdat") + 4
    assert track.keyframes().tolist() == [[at + 1024 * i, 64] for i in range(-(-units // 16))]
    assert mux(payload) == data


def test_other_layout_with_wide_boxes_and_sizes():
    sizes, payload = [5, 7, 1, 9], bytes(range(22))
    body = struct.pack(">I4sQ", 1, b"mdat", 16 + 30) + payload[:12] + bytes(8) + payload[12:]
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), _box(b"avc1", bytes(78))),
        _full(b"stts", struct.pack(">III", 1, 4, 10)),
        _full(b"stsc", struct.pack(">I", 1), struct.pack(">III", 1, 2, 1)),
        _full(b"stsz", struct.pack(">II", 0, 4), struct.pack(">4I", *sizes)),
        _full(b"co64", struct.pack(">I", 2), struct.pack(">QQ", 16, 36)),
        _full(b"stss", struct.pack(">I", 2), struct.pack(">II", 1, 4)),
    )
    mdhd = _box(b"mdhd", b"\x01\0\0\0", bytes(16), struct.pack(">IQ", 90000, 40), bytes(4))
    moov = struct.pack(">I4s", 0, b"moov") + _box(b"trak", _box(b"mdia", mdhd, _full(b"hdlr", bytes(4), b"vide", bytes(13)), _box(b"minf", stbl)))
    track = read_media(body + moov)[0]
    assert demux(body + moov, track) == payload[:12] + payload[12:22]
    assert track.keyframes().tolist() == [[16, 5], [37, 9]]
    assert feature(track) == "avc1/90000/40/4/16+5,37+9"


@pytest.mark.parametrize("data", [b"", b"abc", b"\0\0\0\x04ftyp", b"\0\0\0\xffmoov", mux(bytes(64))[:200], _box(b"moov")])
def test_broken(data):
    with pytest.raises(BrokenMedia):
        read_media(data)


def test_media_columns(spark):
    rows = [(1, mux(b"x" * 64)), (2, None), (3, b""), (4, b"text")]
    out = {r.id: r.media for r in media_columns(spark.createDataFrame(rows, "id long, content binary")).collect()}
    assert out[1].codec == "raw " and out[1].seconds == 0.008 and len(out[1].keyframes) == 1 and out[1].error is None
    assert out[2] is None and out[3].error == "no track" and out[4].error


SCHEMA = "doc_id long, text string, media string, n_bytes string"


def test_texts(spark):
    texts = ["", None, "a", "é" * 32, "é" * 33, "long " * 40000, "a", "x\0y"]
    docs = spark.createDataFrame([(i if i else None, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in read_stored(store_texts(docs)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), got[i or None]
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(mux(payload)).hexdigest()
    assert got[2][1:] == got[6][1:] and got[None][1:] == got[1][1:]


def test_empty_table(spark):
    assert read_stored(store_texts(spark.createDataFrame([], SCHEMA))).count() == 0


def test_media_columns_of_all_tracks_and_of_fragments(spark):
    one = mux(b"x" * 64 * 40)
    at, inner = next((body, stop) for kind, body, stop in boxes(one, 0, len(one)) if kind == b"moov")
    trak = next(one[body - 8 : stop] for kind, body, stop in boxes(one, at, inner) if kind == b"trak")
    video = trak.replace(b"soun", b"vide").replace(b"raw ", b"avc1")
    two = one[: at - 8] + one[inner:] + _box(b"moov", one[at:inner], video)
    rows = [(1, one), (2, two), (3, one + _box(b"moof", _box(b"traf", _full(b"trun", bytes(4))))), (4, b"text")]
    out = {r.id: r.media for r in media_columns(spark.createDataFrame(rows, "id long, content binary")).collect()}
    assert [t.codec for t in out[1].tracks] == ["raw "] and out[1].tracks[0].keyframes == out[1].keyframes
    assert [(t.codec, t.handler, t.n_samples, len(t.keyframes)) for t in out[2].tracks] == [("raw ", "soun", 40, 3), ("avc1", "vide", 40, 3)]
    assert out[2].codec == "raw " and out[2].error is None
    assert "moof" in out[3].error and out[3].codec == "raw " and out[3].n_samples is None and out[3].keyframes is None
    assert out[4].error and out[4].tracks is None
