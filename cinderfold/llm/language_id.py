"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order: counts of the bytes seen after every context of 0 to ORDER
bytes. A byte's code length is that of its longest seen context, with method C's escape probability (distinct bytes over
total plus distinct) for every context that has not seen it, down to a uniform byte. Statistics are frozen after fitting,
so a byte's code length is a function of its ORDER + 1 bytes alone; texts are scored exactly by adding up the lengths of
their windows, vectorised. The language with the shortest code wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderfold.llm.common import in_batches, load

ORDER = 4
#: The model is fitted on at most so many labelled rows of each language.
SAMPLE_ROWS = 400
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_BLOCK = 1 << 18
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _windows(data: np.ndarray, width: int) -> np.ndarray:
    """The last `width` bytes up to each position from width - 1 on, as one number."""
    n = len(data) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(width):
        out <<= np.uint64(8)
        out |= data[i : i + n]
    return out


class ContextTree:
    """Frozen counts of one language: for each order the windows and the contexts seen, sorted."""

    def __init__(self, texts: Iterable[bytes], order: int):
        self.order = order
        buffer = np.frombuffer(b"".join(b" " * order + t for t in texts), np.uint8)
        self.levels = []
        for k in range(order + 1):
            grams, counts = np.unique(_windows(buffer, k + 1), return_counts=True)
            contexts, first = np.unique(grams >> np.uint64(8), return_index=True)
            totals = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
            self.levels.append((grams, counts, contexts, totals, np.diff(np.append(first, len(grams)))))

    def code_lengths(self, windows: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window of order + 1 bytes, after the bytes before it."""
        bits = np.zeros(len(windows))
        left = np.arange(len(windows))
        for k in range(self.order, -1, -1):
            grams, counts, contexts, totals, distinct = self.levels[k]
            if not len(left) or not len(grams):
                continue
            w = windows[left] & np.uint64((1 << (8 * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(contexts, w >> np.uint64(8)), len(contexts) - 1)
            seen = contexts[at] == w >> np.uint64(8)
            room = (totals[at] + distinct[at]).astype(float)
            gram = np.minimum(np.searchsorted(grams, w), len(grams) - 1)
            hit = seen & (grams[gram] == w)
            bits[left[hit]] -= np.log2(counts[gram[hit]] / room[hit])
            escape = seen & ~hit
            bits[left[escape]] -= np.log2(distinct[at[escape]] / room[escape])
            left = left[~hit]
        bits[left] += 8
        return bits


class LanguageModel:
    """Context trees of all languages, with the code lengths of every window of the sample laid out for lookup."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        if not 1 <= order <= 6:
            raise ValueError("order: 1 to 6, so that a window fits into 64 bits")
        self.order, self.languages = order, sorted(samples)
        self.trees = [ContextTree(samples[x], order) for x in self.languages]
        seen = [t.levels[order][0] for t in self.trees]
        self.known = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
        self.lengths = np.stack([np.append(t.code_lengths(self.known), 0.0) for t in self.trees]) if seen else np.zeros((0, 1))
        self.shift = np.uint64(64 - max(4, int(8 * len(self.known)).bit_length()))
        self.slots = []
        rest = np.arange(len(self.known))
        for mix in _MIX:
            table = np.full(1 << (64 - int(self.shift)), len(self.known), np.int32)
            slot = (self.known[rest] * mix) >> self.shift
            table[slot[::-1]] = rest[::-1]
            self.slots.append(table)
            rest = rest[table[slot] != rest]
        self.known = np.append(self.known, np.uint64(2**64 - 1))

    def _find(self, windows: np.ndarray) -> np.ndarray:
        at = self.slots[0][(windows * _MIX[0]) >> self.shift]
        other = np.flatnonzero(self.known[at] != windows)
        at[other] = self.slots[1][(windows[other] * _MIX[1]) >> self.shift]
        return at

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text (row) under each language (column), every byte counted."""
        k, out = self.order, np.zeros((len(texts), len(self.languages)))
        if not len(out) or not self.languages:
            return out
        data = np.frombuffer(b"".join(b" " * k + t for t in texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes + k) - sizes
        ends = starts + sizes
        for a in range(k, len(data), _BLOCK):
            b = min(len(data), a + _BLOCK)
            w = _windows(data[a - k : b], k + 1)
            lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
            if lo >= hi:
                continue
            first = np.maximum(starts[lo:hi], a) - a
            at = self._find(w)
            missed = np.flatnonzero(self.known[at] != w)
            new, back = np.unique(w[missed], return_inverse=True)
            pads = np.zeros(b - a + 1, np.int32)
            np.add.at(pads, np.clip(ends[lo:hi] - a, 0, b - a), 1)
            np.add.at(pads, np.clip(starts[lo + 1 : hi + 1] - a, 0, b - a), -1)
            pads[0] += 1 if starts[lo] > a else 0
            pads[first[0]] -= 1 if starts[lo] > a else 0
            outside = np.cumsum(pads[:-1]) > 0
            for i, tree in enumerate(self.trees):
                c = self.lengths[i][at]
                c[missed] = tree.code_lengths(new)[back]
                c[outside] = 0
                out[lo:hi, i] += np.add.reduceat(c, first)
        return out


def _held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, order: int = ORDER) -> LanguageModel:
    """Fit on at most sample_rows whole texts of each language, those least by a hash of doc_id.

    Rows with null lang or text and held-out rows (crc32 of doc_id as text, mod 5, is 0) are never learned from. Repeated
    doc_ids count once, with their least text. A count a language and the sample are all that reaches the driver.
    """
    eligible = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out()).select("doc_id", F.col("lang").cast("string").alias("lang"))
    counts = eligible.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()
    if not counts:
        return LanguageModel({}, order)
    # The least hashes of a language lie below a bound that twice the sample's number of its rows is expected to pass.
    bounds = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(int(min(1.0, 2 * sample_rows / max(r.n, 1)) * 2**64) - 2**63 - 1))])
    low = eligible.withColumn("h", F.xxhash64("doc_id")).where(F.col("h") <= bounds[F.col("lang")]).distinct()
    least = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = low.withColumn("n", F.row_number().over(least)).where(F.col("n") <= sample_rows).select("doc_id", "lang")
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("d"), F.col("lang").cast("string").alias("l"), "text")
    rows = texts.join(F.broadcast(picked), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("l") == F.col("lang")))
    samples: dict[str, list[bytes]] = {}
    for r in rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).orderBy("lang", "doc_id").collect():
        samples.setdefault(r.lang, []).append(r.text.encode())
    return LanguageModel(samples, order)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def predict_bytes(model: LanguageModel, texts: list[bytes | None]) -> list[tuple[str, float, float | None]]:
    """Language, probability under equal priors, and bits a byte of the winner, for each text."""
    lettered = [i for i, t in enumerate(texts) if t and _LETTER.search(t.decode())]
    out: list[tuple[str, float, float | None]] = [(UNKNOWN, 0.0, None)] * len(texts)
    if model.languages and lettered:
        bits = model.bits([texts[i] for i in lettered])
        best = bits.argmin(1)
        least = bits[np.arange(len(best)), best]
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        for i, b, s, n in zip(lettered, best.tolist(), share.tolist(), least.tolist(), strict=True):
            out[i] = (model.languages[b], s, n / len(texts[i]))
    return out


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row, from its whole text alone.

    und with score 0 where text is null or has no letters, or where no language was learned; equal codes go to the first
    language by code point. Repeated rows and null doc_ids pass one to one; other columns are not read.
    """
    frozen = docs.sparkSession.sparkContext.broadcast(model)  # as large as the sample's distinct windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else None for t in batch.column("text")]
            got = predict_bytes(frozen.value, texts)
            columns = [batch.column("doc_id"), batch.column("held_out"), *(pa.array(c, t) for c, t in zip(zip(*got, strict=True), _OUT.types[2:], strict=True))] if got else [pa.array([], t) for t in _OUT.types]
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), F.col("text").cast("string").alias("text")).transform(in_batches, run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def in_known_languages(docs: DataFrame, model: LanguageModel, most_bits: float = 8.0) -> DataFrame:
    """docs' rows that are in one of the languages, with all their columns; lang, if there, becomes the language found.

    Rejected are texts that are null or have no letters, and texts that no language's code makes shorter than most_bits a
    byte: as they stand, 8 bits, so such a text is no more like any language than random bytes are.
    """
    frozen, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("lang") if "lang" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = predict_bytes(frozen.value, [t.as_buffer().to_pybytes() if t.is_valid else None for t in batch.column("text")])
            if at >= 0:
                batch = batch.set_column(at, batch.schema.field(at), pa.array([lang for lang, _, _ in got], batch.schema.field(at).type))
            yield batch.filter(pa.array([lang != UNKNOWN and bits < most_bits for lang, _, bits in got], pa.bool_()))

    return docs.transform(in_batches, run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled rows that aren't held out."""
    docs = load(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
