"""Token counts under a unigram vocabulary by dynamic programming over a trie of distinct words.

A text's words (runs of anything but ASCII white space), each with a word mark before it, are put
into a trie; texts that share words, and words that share beginnings, share nodes. The forward
score of a node is the best sum of piece scores over the ways to cut the characters down to it, and
is computed once for each node from the scores of the nodes above, a whole level of the trie at a
time. A word's last node holds its number of pieces; a text's count is the sum over its words.
A character that no piece covers falls back to its UTF-8 bytes.

Each task puts the words into a trie that its worker has not met, and remembers their counts, so
nothing is shuffled, a frequent word is scored about once a worker, and memory is bounded by
CHUNK_BYTES of text (or one longer text) and MEMORY words; beyond these the worker starts anew. Words of over LONG characters are not put into the trie
but scored alone, by the same rule, in memory that follows their length.

Defined results: null and empty texts count 0; equal best scores take fewer pieces; equal texts get
equal counts. Columns other than the named ones do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import arrow_schema, batch_of, mixed, per_text, pieces_of, texts_of, worker_memory

MARK = "▁"
LONG = 96
#: Words whose counts a worker remembers before it starts anew.
MEMORY = 500_000
BYTE_SCORE = -12.0
_VOCABULARIES: dict[str, Vocabulary] = worker_memory()


class Vocabulary:
    """Pieces with log scores. Pieces of a length are found by a hash of their characters, last first."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces, self.known = pieces, {}
        self.longest = max(map(len, pieces), default=0)
        self.codes, self.scores = {}, {}
        for n in range(1, self.longest + 1):
            own = [p for p in pieces if len(p) == n]
            if own:
                points = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(-1, n)
                h = np.zeros(len(own), np.uint64)
                for i in range(n - 1, -1, -1):
                    h = self.longer(h, points[:, i])
                order = np.argsort(h)
                self.codes[n], self.scores[n] = h[order], np.array([pieces[p] for p in own])[order]

    @staticmethod
    def longer(h: np.ndarray, points: np.ndarray) -> np.ndarray:
        return mixed(h * np.uint64(0x9E3779B97F4A7C15) + points.astype(np.uint64))

    def find(self, n: int, suffix: np.ndarray) -> np.ndarray:
        """The scores of pieces of n characters by their codes; minus infinity where there is none."""
        at = np.minimum(np.searchsorted(self.codes[n], suffix), len(self.codes[n]) - 1)
        return np.where(self.codes[n][at] == suffix, self.scores[n][at], -np.inf)


def zipf_vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece file, in its order, with the log scores of Zipf's law by rank."""
    if path not in _VOCABULARIES:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        total = np.log((1 / np.arange(1, len(plain) + 1)).sum())
        _VOCABULARIES[path] = Vocabulary({p: float(-np.log(i + 1) - total) for i, p in enumerate(plain)})
    return _VOCABULARIES[path]


def byte_lengths(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


def trie_counts(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """The number of pieces of each distinct word."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    begin = np.cumsum(size) - size
    node = np.zeros(len(words), np.int64)  # each word's node in the level at hand
    place = [node]  # each word's node, by level
    best, count = [np.zeros(1)], [np.zeros(1, np.int64)]
    out = np.zeros(len(words), np.int64)
    inside = np.arange(len(words))
    for depth in range(1, int(size.max(initial=0)) + 1):
        inside = inside[size[inside] >= depth]
        points = flat[begin[inside] + depth - 1]
        _, first, node = np.unique(place[-1][inside].astype(np.uint64) << np.uint64(21) | points.astype(np.uint64), return_index=True, return_inverse=True)
        word = inside[first]  # one word that passes each node
        bytes_here = byte_lengths(points[first])
        up = place[depth - 1][word]
        score, pieces = best[depth - 1][up] + BYTE_SCORE * bytes_here, count[depth - 1][up] + bytes_here
        h = np.zeros(len(word), np.uint64)
        for n in range(1, min(depth, vocabulary.longest) + 1):
            h = vocabulary.longer(h, flat[begin[word] + depth - n])
            if n not in vocabulary.codes:
                continue
            up = place[depth - n][word]
            s, k = best[depth - n][up] + vocabulary.find(n, h), count[depth - n][up] + 1
            better = (s > score + 1e-9) | (np.abs(s - score) <= 1e-9) & (k < pieces)
            score, pieces = np.where(better, s, score), np.where(better, k, pieces)
        level = np.zeros(len(words), np.int64)
        level[inside] = node
        place.append(level)
        best.append(score)
        count.append(pieces)
        ended = inside[size[inside] == depth]
        out[ended] = pieces[level[ended]]
        if depth > vocabulary.longest:
            best[depth - vocabulary.longest - 1] = count[depth - vocabulary.longest - 1] = place[depth - vocabulary.longest - 1] = None
    return out


def long_count(word: str, vocabulary: Vocabulary) -> int:
    """The number of pieces of one word, by the same rule, character by character."""
    best, count = [0.0], [0]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        top = (best[end - 1] + BYTE_SCORE * n, count[end - 1] + n)
        for start in range(max(0, end - vocabulary.longest), end):
            s = vocabulary.pieces.get(word[start:end])
            if s is not None:
                s, k = best[start] + s, count[start] + 1
                if s > top[0] + 1e-9 or abs(s - top[0]) <= 1e-9 and k < top[1]:
                    top = (s, k)
        best.append(top[0])
        count.append(top[1])
    return count[-1]


def word_counts(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    marked = [MARK + w for w in words]
    out = np.zeros(len(words), np.int64)
    short = [i for i, w in enumerate(marked) if len(w) <= LONG]
    out[short] = trie_counts([marked[i] for i in short], vocabulary)
    for i in set(range(len(words))) - set(short):
        out[i] = long_count(marked[i], vocabulary)
    return out


def remembered_counts(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """word_counts of distinct words, of which only new ones are scored; those of over LONG characters are not remembered."""
    known = vocabulary.known
    if len(known) > MEMORY:
        known.clear()
    new = [w for w in words if w not in known]
    known.update(zip(new, word_counts(new, vocabulary).tolist(), strict=True))
    out = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    for w in new:
        if len(w) > LONG:
            del known[w]
    return out


def token_counts(docs: DataFrame, path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words and n_tokens of every row."""
    import pyarrow.compute as pc

    ddl = "doc_id bigint, n_words bigint, n_tokens bigint"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = zipf_vocabulary(path)
        for batch in batches:
            for part, texts in pieces_of(batch, "text", memory=_VOCABULARIES):
                lists = pc.ascii_split_whitespace(texts)
                coded = lists.flatten().dictionary_encode()
                offsets = lists.offsets.to_numpy().astype(np.int64)
                offsets = offsets - offsets[0]
                words = coded.dictionary.to_pylist()
                n = np.where(np.array([len(w) > 0 for w in words], bool), remembered_counts(words, vocabulary), 0) if words else np.zeros(0, np.int64)
                codes = coded.indices.to_numpy(zero_copy_only=False)
                full = np.array([len(w) > 0 for w in words], np.int64)
                yield batch_of(schema, part.column(0), per_text(full[codes] if words else n, offsets), per_text(n[codes] if words else n, offsets))

    return texts_of(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)
