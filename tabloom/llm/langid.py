"""Language identification: known words first, backing off to ever shorter character n-grams.

A word that the model knows scores by its log frequency in each language. Any other word is
scored by its character 4-grams that the model knows, or, if it has none, by its 3-grams, 2-grams
and letters in turn. A text's language is the one with the largest sum; the score is its share
under a softmax of the mean evidence, counted as at most EVIDENCE words.

The model is fitted on a documented, bounded sample: for each language, the `per_language`
labelled texts with the smallest hash of the text (distinct texts only), with all words and n-grams
of them. It is collected and broadcast within that bound; an entry holds the languages that have it only.

Defined results: a null text or one without a letter is 'und' with score 0; rows with a null
language teach nothing; with nothing to learn from every text is 'und'; equal texts get equal
results; ties go to the language first in code-point order. Columns other than the named ones do
not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ._common import arrow_schema, batch_of, fold_of, hash_words, mixed, pieces_of, smallest, spaced, staged, texts_of

GRAMS = (4, 3, 2, 1)
EVIDENCE = 24
SMOOTH = 0.5
#: Up to so many languages, the ends of their samples are broadcast; beyond, they are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
COUNTS = "lang string, kind int, entry bigint, n bigint"


def letters_only(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased words of letters, the code of each word in order, and where each text begins."""
    lists = pc.ascii_split_whitespace(spaced(texts, "[^\\x00-\\x7f\\p{L}\\p{M}]", "abcdefghijklmnopqrstuvwxyz"))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.match_substring_regex(flat, "\\p{L}").to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), before[offsets]
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets


def grams_of(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each character n-gram of the words (with a mark at either end): its 64-bit code and its word's number."""
    marked = "".join(f"\x02{w}\x03" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    if len(points) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(points) - n + 1
    code = np.full(m, n, np.uint64)
    for i in range(n):
        code = mixed(code * np.uint64(0x9E3779B97F4A7C15) + points[i : i + m])
    inside = owner[:m] == owner[n - 1 :]
    if n == 1:
        inside &= points > 3
    return code[inside].astype(np.int64), owner[:m][inside]


class Model:
    """Log frequencies of words (kind 0) and n-grams (kind n) by sorted code: of each entry, only the languages that have it.

    floor: the log frequency, by kind and language, of what the language does not have.
    """

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        lang = pd.Categorical(counts["lang"], categories=self.langs).codes
        self.codes, self.start, self.lang, self.over, self.floor = {}, {}, {}, {}, {}
        for kind in (0, *GRAMS):
            own = np.flatnonzero((counts["kind"] == kind).to_numpy())
            entry, n = counts["entry"].to_numpy(np.int64)[own], counts["n"].to_numpy(np.float64)[own]
            own = own[np.lexsort((lang[own], entry))]
            entry, n = counts["entry"].to_numpy(np.int64)[own], counts["n"].to_numpy(np.float64)[own]
            self.codes[kind], first = np.unique(entry, return_index=True)
            self.start[kind] = np.append(first, len(entry)).astype(np.int32)
            self.lang[kind] = lang[own].astype(np.int16)
            self.over[kind] = np.log1p(n / SMOOTH).astype(np.float32)
            all_n = np.bincount(lang[own], n, len(self.langs)) + SMOOTH * len(self.codes[kind])
            self.floor[kind] = np.log(SMOOTH / np.maximum(all_n, SMOOTH))

    def sums(self, kind: int, codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """[owners, languages] sums of the log frequencies of the codes that the model has, and how many these are."""
        known, m = self.codes[kind], len(self.langs)
        if not len(known) or not len(codes):
            return np.zeros((n, m)), np.zeros(n, np.int64)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        hit = known[at] == codes
        at, owner = at[hit], owner[hit]
        found = np.bincount(owner, minlength=n)
        first, size = self.start[kind][at], self.start[kind][at + 1] - self.start[kind][at]
        cell = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)
        over = np.bincount(np.repeat(owner * m, size) + self.lang[kind][cell], self.over[kind][cell], n * m).reshape(n, m)
        return over + found[:, None] * self.floor[kind], found

    def score(self, words: pa.Array) -> np.ndarray:
        """[words, languages]: each word's log frequency, words first, then the mean of 4-grams down to letters."""
        out, found = self.sums(0, hash_words(words).astype(np.int64), np.arange(len(words)), len(words))
        left = np.flatnonzero(found == 0)
        for n in GRAMS:
            if not len(left):
                break
            codes, owner = grams_of(words.take(pa.array(left)).to_pylist(), n)
            sums, found = self.sums(n, codes, owner, len(left))
            out[left] = sums / np.maximum(found, 1)[:, None]
            left = left[found == 0]
        return out


def sample_of(docs: DataFrame, may_teach: Column, per_language: int) -> DataFrame:
    """lang and text of the sample; the rank is found on hashes alone, so no text is shuffled for it."""
    taught = docs.where(may_teach & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("order"))
    ends = staged(smallest(taught, "lang", "order", per_language), "lang-ends")
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_LANGUAGES else ends
    return taught.join(ends, "lang").where("order <= end").dropDuplicates(["lang", "order"]).select("lang", "text")


def fit(docs: DataFrame, may_teach: Column | None = None, per_language=1500) -> Model:
    """A model from docs (text, lang); may_teach says which rows may be learned from."""
    schema = arrow_schema(COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces_of(batch, "text"):
                langs = part.column(0).dictionary_encode()
                of_text = langs.indices.to_numpy(zero_copy_only=False)
                words, codes, offsets = letters_only(texts)
                of_word = np.repeat(of_text, np.diff(offsets))
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    n = np.bincount(codes[of_word == i], minlength=len(words))
                    own = np.flatnonzero(n)
                    held = words.take(pa.array(own))
                    for kind in (0, *GRAMS):
                        entry, owner = (hash_words(held).astype(np.int64), np.arange(len(held))) if kind == 0 else grams_of(held.to_pylist(), kind)
                        entry, inverse = np.unique(entry, return_inverse=True)
                        total = np.bincount(inverse, n[own][owner], len(entry)).astype(np.int64)
                        yield batch_of(schema, [lang] * len(entry), [kind] * len(entry), entry, total)

    docs = docs.select("lang", "text", F.coalesce(F.lit(True) if may_teach is None else may_teach, F.lit(False)).alias("teaches"))
    counts = texts_of(sample_of(docs, F.col("teaches"), per_language), "*").mapInArrow(count, COUNTS).groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n"))
    return Model(counts.toArrow().to_pandas())


def identify(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    ddl = "doc_id bigint, lang_pred string, score double"
    return texts_of(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predictor(model, docs, False), ddl)


def predictor(model: Model, docs: DataFrame, whole: bool, names_out: tuple[str, str] = ("lang_pred", "score")):
    """The function for mapInArrow; whole: rows keep all their columns, and the two results follow."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m.langs, "und"])
        for batch in batches:
            for part, texts in pieces_of(batch, "text"):
                words, codes, offsets = letters_only(texts)
                best, share = np.full(len(texts), len(m.langs)), np.zeros(len(texts))
                n = np.diff(offsets)
                if m.langs and len(codes):
                    each = m.score(words)
                    mean = np.stack([np.diff(np.concatenate([[0.0], np.cumsum(each[codes, j])])[offsets]) for j in range(len(m.langs))], axis=1) / np.maximum(n, 1)[:, None]
                    mean = np.round(mean, 9)  # the sums before a text must not show in its result
                    top = mean.argmax(axis=1)
                    odds = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(n, EVIDENCE)[:, None])
                    best, share = np.where(n > 0, top, best), np.where(n > 0, np.round(1 / odds.sum(axis=1), 6), 0.0)
                keep = part.columns if whole else [part.column(0)]
                fields = [*(part.schema if whole else [pa.field("doc_id", pa.int64())]), pa.field(names_out[0], pa.string()), pa.field(names_out[1], pa.float64())]
                yield pa.RecordBatch.from_arrays([*keep, names.take(pa.array(best)), pa.array(share)], schema=pa.schema(fields))

    return run


def identified_documents(docs: DataFrame, model: Model, pred="lang_pred", score="lang_score") -> DataFrame:
    """docs with two columns more; their names must be free."""
    return texts_of(docs, "*").mapInArrow(predictor(model, docs, True, (pred, score)), docs.select("*").schema.add(pred, "string").add(score, "double"))


def held_out(doc_id: Column, folds=4, fold=2) -> Column:
    return F.coalesce(fold_of(doc_id, folds) == fold, F.lit(False))
