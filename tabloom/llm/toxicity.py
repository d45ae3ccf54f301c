"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Fitting takes a documented, bounded sample: the `per_label` labelled ids of either label with the
smallest hash. A text is the TF-IDF vector of all its words; document frequencies are counted over
all documents, and a word's weight is raised by `relevance`, where its rates in the sample differ
between the labels; no word's is lowered. The examples lie in blocks of BLOCK. Of terms that many examples hold, weights are
kept as a matrix with the largest of each block; of the others as inverted lists. A search adds the
lists up, bounds each block by the largest of these sums and the products of the block's largest
weights, and reads only blocks that can hold a nearer example, so the k nearest are exact. Their
votes, weighted by similarity and by how many rows of the whole table an example stands for, are
mapped to probabilities by isotonic regression on leave-one-out votes, taken fold by fold with words
weighted by the labels of the other folds. The index holds all words of
at most 2 * per_label examples and is broadcast within that bound.

Words that no example holds change a text's norm alone, so neither its neighbours nor its score.
For the cosines, `score` sends them, packed by task, to shards by word, where their frequencies are
counted over the documents scored; the sums of squares go back to their texts.

Defined results: a text without any word of an example (null and empty texts too) gets the share of
toxic rows among examples without words; an example without label, text or id teaches nothing; an id that is labelled
twice, or a text that occurs twice, counts as toxic if one label says so; without examples every score is 0; equal texts get
equal scores; equally near examples are taken in order of their number. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ._common import arrow_schema, batch_of, give_back, hash_words, mixed, pieces_of, smallest, spaced, staged, texts_of
from .language_model import packed, unpacked

BLOCK = 64
NEAREST = 15
#: Terms of one example in so many are kept as a matrix, the COLUMNS most frequent at most.
OFTEN, COLUMNS = 24, 256
QUERIES, ENTRIES = 32, 1 << 18  # texts that are searched together, and entries of inverted lists that are added up at once
#: Examples that go into the matrix and the lists together; what workers make of an index; bytes of text that are searched together.
PART, PREPARED, SEARCHED = 1024, ("column", "matrix", "most", "at", "times", "heft", "scale", "start"), 1 << 20
HOME = 4096  # texts of a task whose norms are brought together
SHARD_BYTES = 64 << 20
#: Folds of the examples for the calibration: the votes of one are taken with words weighted by the labels of the others.
FOLDS = 2


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the distinct words of each text, their counts, and where each text begins."""
    lists = pc.ascii_split_whitespace(spaced(texts, "[^\\x00-\\x7f\\p{L}\\p{N}]", "abcdefghijklmnopqrstuvwxyz0123456789"))
    flat = lists.flatten()
    sizes = np.diff(lists.offsets.to_numpy().astype(np.int64))
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), sizes)[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    codes = hash_words(coded.dictionary).astype(np.int64)
    m = max(len(codes), 1)
    pairs, n = np.unique(owner * m + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return codes[pairs % m] if len(pairs) else np.zeros(0, np.int64), n, np.searchsorted(pairs, np.arange(len(texts) + 1) * m)


def known_terms(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As terms_of for the terms in `known` (sorted codes), as their places there; and codes, counts and texts of all others."""
    lists = pc.ascii_split_whitespace(spaced(texts, "[^\\x00-\\x7f\\p{L}\\p{N}]", "abcdefghijklmnopqrstuvwxyz0123456789"))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy().astype(np.int64)))[full]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    codes = hash_words(coded.dictionary).astype(np.int64)
    at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
    place = np.where(known[at] == codes, at, -1) if len(known) else np.full(len(codes), -1)
    index = coded.indices.to_numpy(zero_copy_only=False)
    of_word = place[index] if len(codes) else np.zeros(0, np.int64)
    m, hit = max(len(known), 1), of_word >= 0
    pairs, n = np.unique(owner[hit] * m + of_word[hit], return_counts=True)
    w = max(len(codes), 1)
    others, times = np.unique(owner[~hit] * w + index[~hit], return_counts=True)
    return pairs % m, n, np.searchsorted(pairs, np.arange(len(texts) + 1) * m), (codes[others % w] if len(others) else np.zeros(0, np.int64), times, others // w)


def idf_of(frequency: np.ndarray, documents: int) -> np.ndarray:
    return np.log((1 + documents) / np.maximum(frequency, 1)) + 1


def relevance(n1: np.ndarray, n0: np.ndarray, a: int, b: int) -> np.ndarray:
    """1 + (z / s)^2 for words in n1 of a toxic and n0 of b other examples: z is that of the difference
    in rates, s what about one word of the sample would reach by chance. Words of one example have 1."""
    p = (n1 + n0) / max(a + b, 1)
    z = (n1 / max(a, 1) - n0 / max(b, 1)) / np.sqrt(p * (1 - p) * (1 / max(a, 1) + 1 / max(b, 1)) + 1e-12)
    several = n1 + n0 > 1
    return 1 + np.where(several, z * z, 0) / (2 * np.log(max(several.sum(), 2)))


class Index:
    """Examples by block and term. vectors: for each example its term places and counts."""

    def __init__(self, known: np.ndarray, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], documents: int = 0, shards: int = 1):
        self.known, self.idf, self.documents, self.shards = known, idf, documents, shards
        full = np.array([len(t) > 0 for t, _ in vectors], bool)
        rest = weights[~full].sum()
        self.without = float((weights[~full] * labels[~full]).sum() / rest) if rest else 0.0
        rank = np.argsort(np.argsort(idf, kind="stable"), kind="stable")
        kept = [i for i in np.flatnonzero(full)]
        kept.sort(key=lambda i: (tuple(np.sort(rank[vectors[i][0]])[:3]), ids[i]))  # like examples share blocks
        self.ids, self.labels, self.weights = ids[kept], labels[kept].astype(float), weights[kept]
        self.blocks = -(-len(kept) // BLOCK)
        self.terms, self.counts = (np.concatenate([vectors[i][x] for i in kept]).astype(np.int32) if kept else np.zeros(0, np.int32) for x in (0, 1))
        self.ends = np.concatenate([[0], np.cumsum([len(vectors[i][0]) for i in kept])]).astype(np.int64)
        self.steps = (np.zeros(1), np.zeros(1))
        self.shared = None

    def __getstate__(self) -> dict:
        """What is broadcast: the examples' terms and counts; each worker makes the matrix and the lists for itself."""
        small = np.uint8 if self.counts.max(initial=0) < 256 else np.int32
        return {k: v for k, v in self.__dict__.items() if k not in PREPARED} | {"counts": self.counts.astype(small), "shared": None}

    def __getattr__(self, name: str):
        if name not in PREPARED:
            raise AttributeError(name)
        self.prepare()
        return self.__dict__[name]

    def release(self) -> None:
        """Let go of what prepare made: a worker waits for its next task beside those at work, and may wait long."""
        for name in PREPARED:
            self.__dict__.pop(name, None)
        give_back()

    def reweighted(self, idf: np.ndarray) -> Index:
        """The same examples with other weights of their words."""
        out = Index.__new__(Index)
        out.__dict__.update({k: v for k, v in self.__dict__.items() if k not in PREPARED} | {"idf": idf, "shared": None})
        return out

    def own(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Term places and counts of the example at place i."""
        part = slice(self.ends[i], self.ends[i + 1])
        return self.terms[part], self.counts[part].astype(np.int64)

    def broadcast(self, docs: DataFrame):
        """The broadcast index, sent once. Its calibration is that of the moment, so it travels by itself."""
        if self.shared is None:
            self.shared = docs.sparkSession.sparkContext.broadcast(self)
        return self.shared

    def prepare(self) -> None:
        """The matrix and the lists, filled by some examples at a time, so that little is held beside them."""
        n, size = len(self.ids), len(self.known)
        parts = [slice(i, min(i + PART, n)) for i in range(0, n, PART)]
        entries = lambda part: slice(self.ends[part.start], self.ends[part.stop])
        held = sum((np.bincount(self.terms[entries(part)], minlength=size) for part in parts), np.zeros(size, np.int64))
        often = np.argsort(-held, kind="stable")[:COLUMNS]
        often = often[held[often] * OFTEN > n]
        column = np.full(size, -1, np.int32)
        column[often] = np.arange(len(often))
        start = np.concatenate([[0], np.cumsum(np.where(column < 0, held, 0))]).astype(np.int64)
        kinds = np.unique(self.counts)
        heft, scale = 1 + np.log(kinds.astype(float)), np.zeros(self.blocks * BLOCK)
        matrix = np.zeros((self.blocks * BLOCK, len(often)))
        at, times, free = np.zeros(start[-1], np.int32), np.zeros(start[-1], np.uint8 if len(kinds) <= 256 else np.int32), start[:-1].copy()
        for part in parts:
            terms, kind = self.terms[entries(part)], np.searchsorted(kinds, self.counts[entries(part)])
            place = np.repeat(np.arange(part.stop - part.start), np.diff(self.ends[part.start : part.stop + 1]))
            value = heft[kind] * self.idf[terms]
            scale[part] = 1 / np.sqrt(np.bincount(place, value * value, part.stop - part.start))
            dense = column[terms] >= 0
            matrix[part.start + place[dense], column[terms[dense]]] = value[dense] * scale[part][place[dense]]
            order = np.flatnonzero(~dense)
            order = order[np.argsort(terms[order], kind="stable")]
            found, first, n_found = np.unique(terms[order], return_index=True, return_counts=True)
            to = np.arange(len(order)) + np.repeat(free[found] - first, n_found)
            at[to], times[to] = part.start + place[order], kind[order]
            free[found] += n_found
        self.column, self.start, self.heft, self.scale, self.at, self.times, self.matrix = column, start, heft, scale, at, times, matrix
        self.most = matrix.reshape(self.blocks, BLOCK, len(often)).max(axis=1).T if self.blocks else np.zeros((len(often), 0))

    @property
    def where(self) -> list[np.ndarray]:
        """The places of the examples that hold each term."""
        return [np.flatnonzero(self.matrix[:, c]) if c >= 0 else self.at[self.start[t] : self.start[t + 1]] for t, c in enumerate(self.column)]

    @property
    def what(self) -> list[np.ndarray]:
        """The weights that belong to `where`."""
        listed = lambda own: self.heft[self.times[own]] * self.scale[self.at[own]]
        return [self.matrix[self.matrix[:, c] != 0, c] if c >= 0 else self.idf[t] * listed(slice(self.start[t], self.start[t + 1])) for t, c in enumerate(self.column)]

    def square(self, terms: np.ndarray, counts: np.ndarray) -> float:
        w = (1 + np.log(counts)) * self.idf[terms]
        return float((w * w).sum())

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples, nearest first; `but` is left out."""
        return self.search([(terms, counts)], k, [but])[0]

    def together(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[slice]:
        """Texts to be searched together, at most QUERIES: these read the matrix once."""
        for first in range(0, len(vectors), QUERIES):
            yield slice(first, min(first + QUERIES, len(vectors)))

    def listed(self, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For each example the sum of products over terms that are kept in lists, some ENTRIES at a time."""
        out = np.zeros(self.blocks * BLOCK)
        first, last, w = self.start[terms], self.start[terms + 1], w * self.idf[terms]
        cuts = [*np.searchsorted(np.cumsum(last - first), np.arange(0, (last - first).sum(), ENTRIES), "right").tolist(), len(terms)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            lists = list(zip(first[i:j].tolist(), last[i:j].tolist(), strict=True))
            if lists:
                weight = np.repeat(w[i:j], last[i:j] - first[i:j])
                weight *= self.heft[np.concatenate([self.times[a:b] for a, b in lists])]
                out += np.bincount(np.concatenate([self.at[a:b] for a, b in lists]), weight, len(out))
        return out * self.scale

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """As nearest, for several texts, each with a term at least."""
        n, m = len(vectors), self.blocks * BLOCK
        if not n or not m:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        q, rest = np.zeros((n, self.matrix.shape[1])), np.zeros((n, m))
        for i, (terms, counts) in enumerate(vectors):
            w, column = self.vector(terms, counts), self.column[terms]
            dense = column >= 0
            q[i, column[dense]] = w[dense]
            rest[i] = self.listed(terms[~dense], w[~dense])
        rest = rest.reshape(n, self.blocks, BLOCK)
        bound = rest.max(axis=2) + q @ self.most
        score = np.full((n, self.blocks, BLOCK), -1.0)
        left = np.full(n, -1) if but is None else np.asarray(but)

        def read(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                rows = np.flatnonzero(wanted[:, b])
                score[rows, b] = rest[rows, b] + q[rows] @ self.matrix[b * BLOCK : (b + 1) * BLOCK].T
            out = np.flatnonzero(left >= 0)
            score[out, left[out] // BLOCK, left[out] % BLOCK] = -1

        some = min(self.blocks, -(-k // BLOCK) + 1)
        best = np.argpartition(-bound, some - 1, axis=1)[:, :some]
        opened = np.zeros(bound.shape, bool)
        np.put_along_axis(opened, best, True, axis=1)
        read(opened)
        found = np.take_along_axis(score, best[:, :, None], axis=1).reshape(n, -1)
        least = np.partition(found, -k, axis=1)[:, -k] if found.shape[1] >= k else np.full(n, -1.0)
        read(~opened & (bound > 0) & (bound >= least[:, None] - 1e-12))
        out = []
        for own, low in zip(score.reshape(n, m), least, strict=True):
            hit = np.flatnonzero((own > 0) & (own >= low - 1e-12))
            near = np.round(own[hit], 12)
            top = np.lexsort((hit, -near))[:k]
            out.append((hit[top], near[top]))
        return out

    def vote(self, at: np.ndarray, near: np.ndarray) -> float:
        w = near**2 * self.weights[at]
        return float((w * self.labels[at]).sum() / w.sum()) if len(at) else self.without

    def calibrated(self, vote: float, steps: tuple[np.ndarray, np.ndarray]) -> float:
        return float(np.interp(vote, *steps))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best non-decreasing map from x to y, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def fit(docs: DataFrame, labels: DataFrame, may_teach: Column | None = None, per_label=8000) -> Index:
    """An index from docs (doc_id, text) and labels (doc_id, toxic); may_teach is over doc_id."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(F.coalesce(may_teach, F.lit(False))) if may_teach is not None else known
    known = known.groupBy(F.col("doc_id").cast("long").alias("ex_id")).agg(F.max("toxic").cast("int").alias("label"))
    known = staged(known.withColumn("order", F.xxhash64("ex_id")), "tox-labels")
    sample = known.join(F.broadcast(smallest(known, "label", "order", per_label)), "label").where("order <= end").select("ex_id", "label")
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    ddl = "ex_id bigint, label int, text_code bigint, terms array<bigint>, counts array<bigint>"
    schema = arrow_schema(ddl)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces_of(batch, "text"):
                codes, n, ends = terms_of(texts)
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (codes, n)]
                yield batch_of(schema, part.column(0), part.column(1), hash_words(texts).astype(np.int64), *lists)

    told_texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("ex_id"), "text")
    found = told_texts.join(F.broadcast(sample), "ex_id").select("ex_id", "label", "text")
    # rows of one id count once, by its first text; equal texts are one example, toxic if one label says so
    words = texts_of(found, "*").mapInArrow(read, ddl)
    once = words.groupBy("ex_id").agg(F.min_by(F.struct("label", "text_code", "terms", "counts"), "text_code").alias("x")).select("ex_id", "x.*")
    examples = staged(once.groupBy("text_code").agg(F.min("ex_id").alias("ex_id"), F.max("label").alias("label"), F.min_by(F.struct("terms", "counts"), "ex_id").alias("x")).select("ex_id", "label", "x.terms", "x.counts"), "tox-examples")
    sizes = {r[0]: r[1] for r in examples.groupBy("label").count().collect()}
    a, b = sizes.get(1, 0), sizes.get(0, 0)
    if not a + b:
        return Index(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), [])
    held = examples.select("ex_id", "label", "terms", F.col("counts").cast("array<int>")).toArrow().sort_by("ex_id").combine_chunks()
    lists, label, ids = held["terms"].combine_chunks(), held["label"].to_numpy(), held["ex_id"].to_numpy()
    terms, counts, ends = lists.flatten().to_numpy(), held["counts"].combine_chunks().flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    parts = [slice(i, i + (1 << 18)) for i in range(0, len(terms), 1 << 18)]  # some entries at a time: the driver is small
    known = np.zeros(0, np.int64)
    for part in parts:
        known = np.union1d(known, terms[part])
    terms = np.concatenate([np.searchsorted(known, terms[part]).astype(np.int32) for part in parts] or [np.zeros(0, np.int32)])
    del held, lists
    frequency, documents, size = document_frequencies(docs, known)
    vectors = []
    for i, j in zip(ends[:-1], ends[1:], strict=True):
        order = np.argsort(terms[i:j])
        vectors.append((terms[i:j][order], counts[i:j][order]))
    idf, sizes = idf_of(frequency, documents), np.diff(ends)
    fold = (mixed(ids.astype(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)

    def weighted(rows: np.ndarray) -> np.ndarray:
        """The words' weights as the labels of these examples have them."""
        n1, n0 = (np.bincount(terms[np.repeat(rows & (label == x), sizes)], minlength=len(known)) for x in (1, 0))
        return idf * relevance(n1, n0, int((rows & (label == 1)).sum()), int((rows & (label == 0)).sum()))

    weights = np.where(label == 1, totals.get(1, 0) / max(a, 1), totals.get(0, 0) / max(b, 1))
    index = Index(known, weighted(np.ones(len(label), bool)), ids, label, weights, vectors, documents, int(max(8, -(-size // SHARD_BYTES))))
    others = [weighted(fold != f) for f in range(FOLDS)]
    del terms, counts, vectors  # the index has them
    give_back()
    calibrate(docs, index, others)
    return index


def document_frequencies(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int, int]:
    """How many of all documents hold each of the known terms, the number of documents, and the bytes of their texts."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    ddl = "place bigint, n bigint"
    schema = arrow_schema(ddl)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows, size = np.zeros(len(shared.value), np.int64), 0, 0
        for batch in batches:
            for part, texts in pieces_of(batch, "text"):
                seen += np.bincount(known_terms(texts, shared.value)[0], minlength=len(seen))
                rows, size = rows + len(texts), size + (pc.sum(pc.binary_length(texts)).as_py() or 0)
        held = np.flatnonzero(seen)
        yield batch_of(schema, [-1, -2], [rows, size])
        for i in range(0, len(held), 50_000):
            yield batch_of(schema, held[i : i + 50_000], seen[held[i : i + 50_000]])

    got = texts_of(docs, "text").mapInArrow(count, ddl).groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = got["place"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(len(known), np.int64)
    out[place[place >= 0]] = n[place >= 0]
    return out, int(n[place == -1].sum()), int(n[place == -2].sum())


def calibrate(docs: DataFrame, index: Index, weights: list[np.ndarray]) -> None:
    """Leave-one-out votes of the examples (Spark jobs over their numbers), then the isotonic map. The
    words' weights of a fold's votes owe nothing to the labels of that fold."""
    if not len(index.ids):
        return
    fold = (mixed(index.ids.astype(np.uint64)) % np.uint64(len(weights))).astype(np.int64)
    took = np.zeros(len(index.ids))
    for f, idf in enumerate(weights):
        shared = docs.sparkSession.sparkContext.broadcast(index.reweighted(idf))

        def votes(frames: Iterator[pd.DataFrame], shared=shared, f=f) -> Iterator[pd.DataFrame]:
            index = shared.value
            for frame in frames:
                ids = [j for j in frame["id"].tolist() if fold[j] == f]
                own = [index.own(j) for j in ids]
                found = [x for g in index.together(own) for x in index.search(own[g], NEAREST, ids[g])]
                yield pd.DataFrame({"id": ids, "vote": [index.vote(*x) for x in found]})
            index.release()

        got = docs.sparkSession.range(0, len(index.ids), numPartitions=8).mapInPandas(votes, "id long, vote double").toArrow()
        took[got["id"].to_numpy()] = got["vote"].to_numpy()
        shared.destroy()
    index.steps = isotonic(np.round(took, 12), index.labels, index.weights)


def judged(index: Index, steps: tuple[np.ndarray, np.ndarray], texts: pa.Array, nearest: int) -> tuple[np.ndarray, list, list, np.ndarray, tuple]:
    """Of each text the score, the nearest examples' ids, their cosines over the examples' words and the
    sum of squares of these words' weights; and the other words, as known_terms gives them."""
    terms, counts, ends, others = known_terms(texts, index.known)
    scores, ids, cosines, squares = np.full(len(texts), index.without), [[]] * len(texts), [[]] * len(texts), np.zeros(len(texts))
    full = np.flatnonzero(np.diff(ends))
    vectors = [(terms[ends[j] : ends[j + 1]], counts[ends[j] : ends[j + 1]]) for j in full]
    for group in index.together(vectors) if len(index.ids) else [slice(0, len(full))]:
        for j, own, (at, near) in zip(full[group], vectors[group], index.search(vectors[group], nearest), strict=True):
            squares[j] = index.square(*own)
            if len(at):
                scores[j], ids[j], cosines[j] = round(index.calibrated(index.vote(at, near), steps), 9), index.ids[at].tolist(), near.tolist()
    return scores, ids, cosines, squares, others


def score(docs: DataFrame, index: Index, id_col="doc_id", text_col="text", nearest=NEAREST) -> DataFrame:
    """doc_id, score, and as evidence the nearest examples' ids with their cosines."""
    shared, steps, shards = index.broadcast(docs), index.steps, index.shards
    ddl = "home bigint, shard int, at bigint, doc_id bigint, score double, square double, evidence array<bigint>, near array<float>, words binary, texts binary, counts binary"
    schema = arrow_schema(ddl)
    out_ddl = "doc_id bigint, score double, evidence array<bigint>, cosines array<float>"
    result = arrow_schema(out_ddl)

    def rows_of(home: int, shard: int | None, words: np.ndarray, texts: np.ndarray, counts: np.ndarray) -> tuple:
        return (home, shard, *[None] * 6, *(packed(x) for x in (words, texts, counts)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with what the index says of them; and for each shard the words that no example holds."""
        ix, first, seen, held = shared.value, TaskContext.get().partitionId() << 28, 0, []

        def others() -> Iterator[pa.RecordBatch]:
            words, n, text = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = (mixed(words.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((text, words, shard))
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            parts = [(s, order[cuts[s] : cuts[s + 1]]) for s in range(shards) if cuts[s] < cuts[s + 1]]
            for i in range(0, len(parts), 64):
                rows = [rows_of(first + (seen - 1) // HOME, s, words[o], text[o].astype(np.uint16), np.minimum(n[o], 2**32 - 1).astype(np.uint32)) for s, o in parts[i : i + 64]]
                yield batch_of(schema, *zip(*rows, strict=True))

        for batch in batches:
            for part, texts in pieces_of(batch, "text"):
                for a in range(0, len(texts), HOME):
                    own = texts.slice(a, HOME)
                    if held and (seen - 1) // HOME != (seen + len(own) - 1) // HOME:
                        yield from others()
                        held, seen = [], -(-seen // HOME) * HOME
                    scores, ids, near, squares, rest = judged(ix, steps, own, nearest)
                    at = seen + np.arange(len(own))
                    held.append((rest[0], rest[1], rest[2] + seen % HOME))
                    none = pa.nulls(len(own), pa.binary())
                    yield batch_of(schema, first + at // HOME, pa.nulls(len(own), pa.int32()), at % HOME, part.column(0).slice(a, HOME), scores, squares, pa.array(ids, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.float32())), none, none, none)
                    seen += len(own)
        if held:
            yield from others()
        ix.release()

    def count(table: pa.Table) -> pa.Table:
        """The squares of a shard's words, summed for each text."""
        parts = [tuple(unpacked(r[x], k) for x, k in (("words", np.int64), ("texts", np.uint16), ("counts", np.uint32))) for r in table.select(["words", "texts", "counts"]).to_pylist()]
        _, place, times = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
        idf = idf_of(times, max(shared.value.documents, int(times.max())))[place]
        rows, done = [], 0
        for home, (words, texts, n) in zip(table["home"].to_pylist(), parts, strict=True):
            w = (1 + np.log(n)) * idf[done : done + len(words)]
            done += len(words)
            at, local = np.unique(texts, return_inverse=True)
            rows.append(rows_of(home, None, np.zeros(0), at, np.bincount(local, w * w, len(at))))
        return pa.Table.from_batches([batch_of(schema, *zip(*rows, strict=True))])

    def finish(table: pa.Table) -> pa.Table:
        """The texts of one home with their cosines over all words."""
        other = np.zeros(HOME)
        for texts, squares in sorted(zip(table["texts"].to_pylist(), table["counts"].to_pylist(), strict=True), key=lambda x: (x[0] or b"", x[1] or b"")):
            if texts is not None:
                other[unpacked(texts, np.uint16)] += unpacked(squares, np.float64)
        own = table.filter(pc.is_valid(table["at"])).combine_chunks()
        known = own["square"].to_numpy()
        scale = np.sqrt(known / np.maximum(known + other[own["at"].to_numpy()], 1e-300))
        near = [(np.array(x) * f).tolist() for x, f in zip(own["near"].to_pylist(), scale, strict=True)]
        return pa.table([own["doc_id"], own["score"], own["evidence"], pa.array(near, pa.list_(pa.float32()))], schema=result)

    told = staged(texts_of(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, ddl), "tox-judged")
    sums = told.where("shard IS NOT NULL").groupBy("shard").applyInArrow(count, ddl)
    return told.where("shard IS NULL").unionByName(sums).groupBy("home").applyInArrow(finish, out_ddl)


def scorer(docs: DataFrame, index: Index, nearest: int, name: str):
    shared, steps = index.broadcast(docs), index.steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces_of(batch, "text", SEARCHED):
                scores = pa.array(judged(shared.value, steps, texts, nearest)[0])
                yield pa.RecordBatch.from_arrays([*part.columns, scores], schema=pa.schema([*part.schema, pa.field(name, pa.float64())]))
        shared.value.release()

    return run


def scored_documents(docs: DataFrame, index: Index, name="toxic_score", nearest=NEAREST) -> DataFrame:
    """docs with the score as one column more; the name must be free."""
    return texts_of(docs, "*").mapInArrow(scorer(docs, index, nearest, name), docs.select("*").schema.add(name, "double"))
