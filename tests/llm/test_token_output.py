import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cinderfold.llm import encoding
from cinderfold.llm.encoding import Encoder
from cinderfold.llm.token_output import Segment, bits_for, pack, read_documents, read_segments, to_segment, unpack, write_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def enc():
    return Encoder(FILE)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 2**32 - 1))
def test_pack_round_trip_at_every_width(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
    words = pack(ids, bits)
    assert len(words) == -(-n // 64) * bits
    assert (unpack(words, bits, n) == ids).all()


def test_bits_are_the_least():
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_random_access():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 50257, n).astype("<u4") for n in (0, 1, 5000, 70, 9000)]
    seg = Segment(to_segment([3, None, 5, 6, 7], [x.tobytes() for x in ids], 16))
    flat = np.concatenate(ids)
    assert seg.doc_ids == [3, None, 5, 6, 7]
    assert (seg.ids() == flat).all()
    for start, n in ((0, 1), (4095, 2), (4096, 4096), (13000, 5000), (99999, 3)):
        assert (seg.ids(start, n) == flat[start : start + n]).all()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZé ßñ1#½²._'s,!\n\t\r\x1c\x85\xa0 汉\U0001f600|<>endoftx")), max_size=40))
def test_chunked_ids_are_the_librarys(enc, text):
    assert enc.ids(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a  b", "a   b", " a ", "it's, it's.\nIt's", "x.\nAnd, y", "a.\n\nB", "<|endoftext|> a", "...", "word.\nword.", "a b, c. d.\nE f, g", "x ab##, c*.\nd!! e's f.'s", "a b.\nC, d. e,.", "end.\n", "a,.\nB"])
def test_chunked_ids_of_edge_texts(enc, text):
    assert enc.ids(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def librarys(enc, texts):
    ids = [[*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    return sum(ids, []), np.cumsum([len(x) for x in ids]).tolist()


def of_batch(enc, texts):
    ids, stops = enc.batch(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), 0)
    return ids.tolist(), stops.tolist()


_PARTS = ["a", "Zé", "ß", "1", "#", "½", "²", "._", "'", "'s", ",", "!", "\n", " ", " ", "汉", "\U0001f600", "×", "÷", "ɏ", "ɐ", "Ā", "\x00", "\x7f", "endoftext|>", "x.\nA "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from([*_PARTS, "  ", " \n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "<|endoftext|>"]), max_size=20).map("".join) | st.lists(st.sampled_from(_PARTS), max_size=20).map("".join), max_size=6))
def test_ids_of_a_batch_are_the_librarys(enc, texts):
    assert of_batch(enc, texts) == librarys(enc, texts)
    assert of_batch(enc, pa.array(texts, pa.string())[1:]) == librarys(enc, texts[1:])


def test_a_batch_looks_up_each_piece_once(enc, monkeypatch):
    asked = []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda pieces, rough: asked.append(pieces) or learn(pieces, rough))
    texts = ["So, words. Words,\nwords: so it's SO so.", "words, so."] * 500
    assert of_batch(enc, texts) == librarys(enc, texts)
    assert [sorted(pieces) for pieces in asked] == [sorted(["So", ",", " words", ".", " Words", "\n", "words", ":", " so", " it's", " SO"])]


def test_full_cache_of_pieces_stays_bounded_and_right(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT_CHUNKS", 8)
    enc = Encoder(FILE)
    for texts in (["a b c d e f"], ["a b g h i j k"], ["a " + "long" * 40, " ".join("abcdefghijklmnopq")], ["b c"]):
        assert of_batch(enc, texts) == librarys(enc, texts)
        assert len(enc.pieces) <= 8


def test_ids_are_gathered_in_blocks(enc, monkeypatch):
    monkeypatch.setattr(encoding, "_GATHERED", 3)
    texts = ["one two, three", None, "", "four  five", "six seven eight nine"]
    assert of_batch(enc, texts) == librarys(enc, texts)


SCHEMA = "doc_id long, text string, start long, part int, segment int"


def expected(enc, rows):
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_table_round_trip(spark, enc, tmp_path):
    rows = [(5, "five words are in here"), (1, None), (3, ""), (2, "long " * 30000), (2, "tie"), (None, "no id"), (7, "dup"), (7, "dup"), (9, "ünï 汉字 \U0001f600")]
    docs = spark.createDataFrame([(d, t, 1, 1, 1) for d, t in rows], SCHEMA).repartition(3)
    write_tokens(docs, f"{tmp_path}/t", FILE)
    got = read_documents(read_segments(spark, f"{tmp_path}/t")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(enc, rows)


def test_empty_table(spark, tmp_path):
    write_tokens(spark.createDataFrame([], SCHEMA), f"{tmp_path}/t", FILE)
    assert read_documents(read_segments(spark, f"{tmp_path}/t")).count() == 0
