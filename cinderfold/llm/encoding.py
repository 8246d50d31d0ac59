"""Exact ids of a public tokenizer, with the ids of repeated chunks kept between texts."""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cinderfold.llm.common import held

#: Single spaces between two non-space characters always start a new pre-token of byte-level BPE.
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(f"[{_LETTERS}]+")
_MARKS = r"!-&(-/:-@\[-`{-~"  # of ASCII, but for the apostrophe, which may open a contraction
_LAST = frozenset(".,;:!?)")
_WORDS = re.compile(f"([{_LETTERS}]+)([{_MARKS}]+)(?:(\n)([{_LETTERS}]+)([{_MARKS}]*))?")
#: White space other than space and newline.
_RARE_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]

KEPT_CHUNKS = 500_000
#: Longer pieces are encoded anew in each batch.
KEPT_LENGTH = 64
_GATHERED = 1 << 20


class _Chunks(dict):
    """Bytes of the ids of prefix + chunk, by chunk; when full, the older half goes, so memory stays bounded.

    A run of letters is one pre-token and goes straight to the library's model; one with marks behind it, and two words
    around the end of a line, are put together from their pre-tokens; all else goes through the library as it is.
    """

    def __init__(self, owner: Encoder, prefix: str, after: _Chunks | None):
        super().__init__()
        self.owner, self.prefix, self.after = owner, prefix, self if after is None else after
        self.shown, self.tokenize = prefix.replace(" ", "Ġ"), owner.model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= KEPT_CHUNKS:
            for old in list(islice(self, KEPT_CHUNKS // 2)):
                del self[old]
        if chunk.isalpha() and (plain := chunk.isascii() or _WORD.fullmatch(chunk)):
            shown = chunk if plain is True else chunk.encode().decode("latin-1").translate(self.owner.characters)
            got = array("I", [t.id for t in self.tokenize(self.shown + shown)]).tobytes()
        elif chunk[-1:] in _LAST and (word := chunk[:-1]).isalpha() and word.isascii():
            got = self[word] + self.after[chunk[-1]]
        elif m := _WORDS.fullmatch(chunk):
            got = self[m[1]] + b"".join([self.after[x] for x in m.groups()[1:] if x])
        else:
            got = self.owner.library(self.prefix + chunk)
        self[chunk] = got
        return got


def _byte_characters() -> dict[int, int]:
    """Byte-level BPE's characters: printable bytes stand for themselves, the others are numbered from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


def _classes() -> np.ndarray:
    """Of each byte: 1 letter (two-byte letters too), 2 digit, 3 mark, 4 space, 5 newline, 6 what follows a letter's first byte, 0 else."""
    out = np.zeros(256, np.uint8)
    for kind, members in ((1, b"A-Za-z"), (2, b"0-9"), (3, _MARKS.encode()), (4, b" "), (5, b"\n")):
        out[[b for b in range(128) if re.fullmatch(b"[" + members + b"]", bytes([b]))]] = kind
    out[0xC3:0xC9], out[0x80:0xC0] = 1, 6
    return out


_CLASSES = _classes()


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of texts without odd white space, and which of them are not single pre-tokens.

    A piece is a run of letters, of digits or of marks, with a space ahead of it if there is one, or a newline. These are
    the pre-tokens of byte-level BPE where nothing else is near; so what stands between two spaces stays whole if it holds
    an apostrophe, two newlines in a row, a control or any character outside of ASCII that is not a letter of Latin.
    """
    kind = _CLASSES[data]
    before = np.concatenate([np.zeros(1, np.uint8), data[:-1]])
    tail = kind == 6
    latin = tail & (before >= 0xC3) & (before <= 0xC8) & ~((before == 0xC3) & ((data == 0x97) | (data == 0xB7)))
    kind[tail] = 0
    kind[latin] = 1
    text = np.zeros(len(data) + 1, bool)
    text[offsets] = True
    text = text[:-1]
    start = np.empty(len(data), bool)
    start[:1], start[1:] = True, (kind[1:] != kind[:-1]) & (kind[:-1] != 4)
    between = text | (kind == 4)
    starts = np.flatnonzero(start | between)
    odd = kind == 0
    odd[1:] |= (kind[1:] == 5) & (kind[:-1] == 5) & ~text[1:]
    whole = between[starts]
    if not odd.any():
        return starts, np.zeros(len(starts), bool)
    stretches = starts[whole]
    rough = np.zeros(len(stretches), bool)
    rough[np.searchsorted(stretches, np.flatnonzero(odd), "right") - 1] = True
    left = starts[whole | ~rough[np.cumsum(whole) - 1]]
    return left, rough[np.searchsorted(stretches, left, "right") - 1]


class Encoder:
    """Ids of whole texts by the tokenizers library, add_special_tokens=False.

    A byte-level BPE without normalizer never merges over the single spaces between words, so a text's ids are those
    of its space-separated chunks in a row; each distinct chunk goes through the library once and is then looked up.
    Texts with a special token's string, and other kinds of tokenizers, go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        pre = said["pre_tokenizer"] or {}
        self.special = [t["content"] for t in said["added_tokens"]]
        self.by_chunk = said["normalizer"] is None and said["truncation"] is None and said["padding"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(" " in s or "\n" in s for s in self.special)
        self.n_vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model, self.characters = self.tokenizer.model, _byte_characters()
        self.first = _Chunks(self, "", None)
        self.rest = _Chunks(self, " ", self.first)
        self.pieces: dict[str, bytes] = {}
        self.shown = np.array([self.characters.get(b, b) for b in range(256)], "<u2")
        self.shown[0] = 0  # parts pieces in _learn()
        self.apart = "|".join(["  ", "\n ", " \n", "[" + "".join(map(_quoted, _RARE_SPACE)) + "]", *map(_quoted, self.special)])

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of one text as little-endian unsigned 32-bit integers; null is empty."""
        return np.frombuffer(self.raw(text), "<u4")

    def raw(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk or any(s in text for s in self.special):
            return self.library(text)
        odd = "  " in text or "\n " in text or " \n" in text or any(c in text for c in _RARE_SPACE)
        chunks = _SAFE_SPACE.split(text) if odd else text.split(" ")
        head = chunks[0]
        return (self.first[head] if head else b"") + b"".join(map(self.rest.__getitem__, chunks[1:]))


    def batch(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, `end` behind each, and where each text's ids stop; null is empty.

        Equal pieces of a batch are found by Arrow's dictionaries and looked up once.
        """
        last = np.array([end], "<u4").tobytes()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        apart = pc.match_substring_regex(texts, self.apart).to_numpy(zero_copy_only=False) if self.by_chunk else np.ones(len(texts), bool)
        alone = {i: self.raw(texts[i].as_py()) for i in np.flatnonzero(apart).tolist()}
        if alone:
            texts = pc.if_else(pa.array(apart), "", texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts, rough = _pieces(data, offsets)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        coded = pa.StringArray.from_buffers(len(starts), bounds, pa.py_buffer(data)).dictionary_encode()
        codes = coded.indices.to_numpy()
        of_rough = np.zeros(len(coded.dictionary), bool)
        of_rough[codes[rough]] = True
        table = self._learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), of_rough)
        # each text's end, or a text encoded alone and its end, is one more piece
        behind = np.full(len(texts), len(table))
        behind[list(alone)] += 1 + np.arange(len(alone))
        table += [last, *(raw + last for raw in alone.values())]
        stops = np.searchsorted(starts, offsets[1:])
        codes = np.insert(codes, stops, behind)
        lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat, first = np.frombuffer(b"".join(table), "<u4"), np.cumsum(lengths) - lengths
        stand = np.cumsum(lengths[codes])
        out = np.empty(stand[-1] if len(stand) else 0, "<u4")
        for a in range(0, len(codes), _GATHERED):
            some = codes[a : a + _GATHERED]
            n = lengths[some]
            at = np.cumsum(n)
            to = stand[a] - n[0]
            out[to : to + at[-1]] = flat[np.arange(at[-1]) + np.repeat(first[some] - (at - n), n)]
        return out, stand[stops + np.arange(len(texts))]

    def _learn(self, pieces: list[str], rough: np.ndarray) -> list[bytes]:
        """Bytes of the ids of each of different pieces; those not kept from before go to the library, pre-tokens straight to its model."""
        out = list(map(self.pieces.get, pieces))
        new = [i for i, got in enumerate(out) if got is None]
        while len(self.pieces) + len(new) > KEPT_CHUNKS and self.pieces:
            for old in list(islice(self.pieces, max(1, KEPT_CHUNKS // 2))):
                del self.pieces[old]
        plain = [i for i in new if not rough[i]]
        shown = self.shown[np.frombuffer("\0".join([pieces[i] for i in plain]).encode(), np.uint8)].tobytes().decode("utf-16-le").split("\0")
        tokenize = self.model.tokenize
        for i, word in zip(plain, shown, strict=False):  # one empty word if there are none
            out[i] = array("I", [t.id for t in tokenize(word)]).tobytes()
        for i in new:
            if rough[i]:
                out[i] = self.library(pieces[i])
        self.pieces.update([(pieces[i], out[i]) for i in new[:KEPT_CHUNKS] if len(pieces[i]) <= KEPT_LENGTH])
        return out


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{{{ord(c):x}}}" for c in text)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file, for tasks that keep ("encoder", path)."""
    return held(("encoder", path), lambda: Encoder(path))
