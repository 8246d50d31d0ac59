"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the mark for the space before it. Distinct pre-tokens go into a trie; the best unigram score
of a prefix, and the number of pieces that reach it, is worked out once at the trie's node and shared by all pre-tokens
with that prefix. The node where a pre-token ends gives its count, which is kept by pre-token; a text's count is the sum
over its words. Nothing is shuffled: each worker grows its own trie, of bounded size; a pre-token above LONG characters,
which hardly shares its prefix, is worked out by the same steps without leaving nodes behind.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import inf, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderfold.llm.common import held, in_batches, load

SPACE = "▁"
#: Added to the least score for a character that no piece holds, as the usual unigram encoders do.
UNKNOWN_PENALTY = 10.0
#: A trie that has grown to so many nodes is given up for a new one.
MOST_NODES = 500_000
LONG = 4096
_SHIFT = 2.7  # of Zipf's law for ranks; no two pieces' product is a third's probability, so counts have no ties


def vocabulary(model_file: str) -> dict[str, float]:
    """Log probability of each ordinary piece of a sentencepiece model.

    A unigram model says them itself. A BPE model only has ranks (0, -1, -2, ...); these are taken as Zipf's law.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = [sp.get_score(i) for i in ids]
    ranked = all(s == int(s) for s in scores)
    return {sp.id_to_piece(i): -log(_SHIFT - s) if ranked else s for i, s in zip(ids, scores, strict=True)}


class TrieCounts(dict):
    """Number of pieces of the best segmentation, by word; a word that is missing is added to the trie."""

    def __init__(self, scores: dict[str, float], most_nodes: int = MOST_NODES):
        super().__init__()
        self.scores, self.most_nodes = scores, most_nodes
        #: Every tail of a piece, with its score if it is a piece itself: no piece ends where a tail is missing.
        self.tails = {piece[i:]: scores.get(piece[i:], -inf) for piece in scores for i in range(len(piece))}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, scores), default=1)
        self._plant()

    def _plant(self) -> None:
        self.clear()
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.pieces = [0.0], [0]

    def __missing__(self, word: str) -> int:
        if len(word) > LONG:
            return self._long(SPACE + word)
        if len(self.best) >= self.most_nodes or len(self) >= self.most_nodes:
            self._plant()
        text, node, path = SPACE + word, 0, [0]
        child, best, pieces, tails = self.child, self.best, self.pieces, self.tails
        for end, c in enumerate(text, 1):
            last = node
            node = child.get((last, c), -1)
            if node < 0:
                node = len(best)
                child[last, c] = node
                score, count = -inf, 0
                for start in range(end - 1, -1, -1):
                    own = tails.get(text[start:end])
                    if own is None:
                        break
                    own += best[path[start]]
                    if own > score:
                        score, count = own, pieces[path[start]] + 1
                if c not in self.scores and best[last] + self.unknown > score:
                    score, count = best[last] + self.unknown, pieces[last] + len(c.encode())
                best.append(score)
                pieces.append(count)
            path.append(node)
        self[word] = pieces[node]
        return pieces[node]

    def _long(self, text: str) -> int:
        """The count of a pre-token from the last `longest` prefixes' results alone."""
        near: deque[tuple[float, int]] = deque([(0.0, 0)], maxlen=self.longest)  # results of the prefixes up to here
        for end, c in enumerate(text, 1):
            score, count = -inf, 0
            for back in range(1, min(self.longest, end) + 1):
                own = self.tails.get(text[end - back : end])
                if own is None:
                    break
                own += near[-back][0]
                if own > score:
                    score, count = own, near[-back][1] + 1
            last = near[-1]
            if c not in self.scores and last[0] + self.unknown > score:
                score, count = last[0] + self.unknown, last[1] + len(c.encode())
            near.append((score, count))
        return near[-1][1]

    def count(self, text: str) -> tuple[int, int]:
        """Words and tokens of a text."""
        words = text.split()
        return len(words), sum(map(self.__getitem__, words))


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every row's whole text.

    Words are runs of what isn't white space; white space counts as the mark before the next word, however long. A
    character that no piece holds counts as its UTF-8 bytes. Null and empty texts give 0 and 0. Repeated rows and null
    doc_ids pass one to one; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held(("trie", model_file), lambda: TrieCounts(vocabulary(model_file)))
        for batch in batches:
            got = [counts.count(t.as_py()) if t.is_valid else (0, 0) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([w for w, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_batches, run, "doc_id long, n_words long, n_tokens long", ("trie", model_file))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and tokens of every document under the 32,000 pieces of the public sentencepiece vocabulary."""
    import public_tokenizers

    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
