"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition packs its own pieces by best fit decreasing, up to LEAF of them at a time (a piece is
a few numbers, so a partition fits). Bins that are nearly full are done; the others become items of
a level above, where the bins of `fan_in` neighbours meet, are packed by best fit again, and so on up
a tree. A node of over NODE bins is dealt by hash over several tasks, so that none grows without
bound and no bin is left out. A piece finds its place through the chain of bins that its own bin
went into. What climbs is a bin's number and fill, never text or ids. Pieces longer than the
capacity do not occur: documents are cut before.

Ids come from `tokenizers` alone. No token of this pre-tokeniser reaches over a blank that follows a
character which is no white space, so a text is cut there, and each different cut is encoded once
and remembered by the worker (up to MEMORY cuts); tests hold this against whole texts.

Defined results: a null or empty text is the single end token; rows with equal or null ids are
packed as separate rows; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._common import arrow_schema, batch_of, pieces_of, staged, texts_of, worker_memory

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Cuts that a worker remembers before it starts anew, and ids for each of them.
MEMORY, IDS_OF_CUT = 1_500_000, 8
#: New cuts that are encoded as one text: the encoder keeps more than the ids of what it is given.
TOGETHER = 20_000
LEAF, NODE = 1_000_000, 200_000
#: White space as the pre-tokeniser knows it.
BLANK = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ENCODERS: dict[str, Encoder] = worker_memory()


class Encoder:
    """Ids of texts, with a memory of the ids of their cuts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        vocabulary = self.exact.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # a character of a byte-level token is a byte
        self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.most = MEMORY
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, cuts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.place.update(zip(cuts, range(len(self.ends) - 1, len(self.ends) - 1 + len(cuts)), strict=True))
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])

    def places(self, cuts: list[str], joinable: bool = False) -> np.ndarray:
        """The place of each cut in memory. Joinable ones (a blank, then no blank at the end, nothing special) are
        encoded as one text; how many bytes each id stands for shows where a cut ends."""
        at = np.fromiter(map(self.place.get, cuts, repeat(-1)), np.int64, len(cuts))
        missing = np.flatnonzero(at < 0).tolist()
        new = list(dict.fromkeys(cuts[i] for i in missing))
        if joinable:
            for i in range(0, len(new), TOGETHER):
                own = new[i : i + TOGETHER]
                ids = np.array(self.exact.encode_batch_fast(["".join(own)], add_special_tokens=False)[0].ids, np.int64)
                size = pc.binary_length(pa.array(own)).to_numpy()
                self.add(own, ids, np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(size)) + 1)
        elif new:
            parts = [e.ids for e in self.exact.encode_batch_fast(new, add_special_tokens=False)]
            self.add(new, np.array([i for x in parts for i in x], np.int64), np.cumsum([len(x) for x in parts]))
        at[missing] = [self.place[cuts[i]] for i in missing]
        return at

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.ends) > self.most or len(self.flat) > self.most * IDS_OF_CUT:
            self.forget()
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        open_word = pc.match_substring_regex(words, f"(?:^|[{BLANK}])$").to_numpy(zero_copy_only=False)
        open_end = open_word[codes]
        open_end[offsets[1:] - 1] = False  # the end of a text is an end
        special = np.zeros(len(texts), bool)
        for x in self.special:
            special |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(special | (np.bincount(np.repeat(np.arange(len(texts)), np.diff(offsets)), open_end, len(texts)) > 0))
        marked = pc.binary_join_element_wise(pa.scalar(""), words, pa.scalar(" "))
        alone = open_word.copy()
        for x in self.special:
            alone |= pc.match_substring(words, x).to_numpy(zero_copy_only=False)
        after = np.zeros(len(words), np.int64)
        marked = marked.to_numpy(zero_copy_only=False)  # at once, which to_pylist does not do
        after[~alone] = self.places(marked[~alone].tolist(), True)
        after[alone] = self.places(marked[alone].tolist())
        at = after[codes]
        at[offsets[:-1]] = self.places(words.take(pa.array(codes[offsets[:-1]])).to_numpy(zero_copy_only=False).tolist())
        word = lambda j: words[int(codes[j])].as_py()
        own = {}
        for i in odd:
            cuts = [texts[int(i)].as_py()] if special[i] else []
            for j in range(offsets[i], offsets[i + 1] if not special[i] else offsets[i]):
                piece = word(j) if j == offsets[i] else " " + word(j)
                if cuts and open_end[j - 1]:
                    cuts[-1] += piece
                else:
                    cuts.append(piece)
            own[int(i)] = self.places(cuts)
        flat, ends = self.flat, self.ends
        size = ends[at + 1] - ends[at]
        stops = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.arange(stops[-1]) - np.repeat(stops[:-1] - ends[at], size)]
        out = np.split(ids, stops[offsets[1:-1]]) if len(texts) else []
        for i, x in own.items():
            out[i] = np.concatenate([flat[ends[j] : ends[j + 1]] for j in x])
        return out


def token_pieces(docs: DataFrame, path: str, capacity=2048, end_id=0, id_col="doc_id", text_col="text", remembered=MEMORY) -> DataFrame:
    """The pieces of each document: ids and one end id, cut only where longer than the capacity;
    the first piece takes what the full ones leave. A worker remembers up to `remembered` cuts."""
    schema = arrow_schema(PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encode = _ENCODERS[path]
        encode.most = remembered
        for batch in batches:
            for part, texts in pieces_of(batch, "text", memory=_ENCODERS):
                out = []
                for doc_id, own in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    ids = np.append(own, np.uint32(end_id)).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    starts = [0, *range(first, len(ids), capacity)]
                    for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        out.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                yield batch_of(schema, *zip(*out, strict=True))

    return texts_of(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit decreasing: the bin and offset of each item, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    where, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set when a bin has r left
    for i in order:
        n = int(lengths[i])
        fits = some >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                some ^= 1 << left
        else:
            b, left = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        if left > n:
            free[left - n].append(b)
            some |= 1 << (left - n)
    return where, offset, np.array(fill, np.int64)


def merger(mark: int, capacity: int, slack: int):
    """A function that packs the bins which meet in a part of a node of the tree; mark keeps the levels' bin numbers apart."""

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fill", "item"], kind="stable").reset_index(drop=True)
        where, offset, fill = best_fit(frame["fill"].to_numpy(np.int64), capacity)
        node, part = map(int, key)
        return pd.DataFrame({"item": frame["item"], "node": node, "parent": mark + (node << 36) + (part << 22) + where, "shift": offset, "fill": fill[where], "climbs": (fill < capacity - slack)[where]})

    return merge


def pack(pieces: DataFrame, capacity=2048, slack=8, fan_in=8, leaf_size=LEAF, node_size=NODE, label="pack") -> DataFrame:
    """pieces (any columns, with length) plus sequence_id and offset."""
    spark = pieces.sparkSession
    names = [n for n in pieces.columns]
    local = spark.createDataFrame([], pieces.schema).selectExpr("*", "0L AS pack_bin", "0L AS pack_offset", "0L AS pack_fill").schema

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows stay in Arrow: beside a null, a long id would become a float elsewhere
        number, base, held = TaskContext.get().partitionId(), 0, []

        def placed() -> Iterator[pa.RecordBatch]:
            nonlocal base
            where, offset, fill = best_fit(np.concatenate([b["length"].to_numpy() for b in held]).astype(np.int64), capacity)
            new, at = ((number << 40) + base + where, offset, fill[where]), 0
            base += len(fill)
            for b in held:
                own = (pa.array(x[at : at + b.num_rows]) for x in new)
                yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, "pack_bin", "pack_offset", "pack_fill"])
                at += b.num_rows

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= leaf_size:
                yield from placed()
                held = []
        if held:
            yield from placed()

    placed = staged(pieces.mapInArrow(leaf, local), f"{label}-leaves")
    bins = placed.where(F.col("pack_fill") < capacity - slack).groupBy(F.col("pack_bin").alias("item")).agg(F.first("pack_fill").alias("fill"))
    bins = bins.select("item", "fill", (F.shiftright("item", 40)).alias("node"))
    chains, level = None, 0
    while True:
        level += 1
        bins = bins.withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
        parts = bins.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / node_size).alias("parts"))
        dealt = bins.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("item"), "parts"))
        merged = staged(dealt.groupBy("node", "part").applyInPandas(merger(1 << 62 | level << 56, capacity, slack), "item long, node long, parent long, shift long, fill long, climbs boolean"), f"{label}-level")
        moved = merged.select("item", "parent", "shift")
        if chains is None:
            chains = moved.select("item", F.col("parent").alias("top"), F.col("shift").alias("total"))
        else:
            up = moved.select(F.col("item").alias("top"), "parent", "shift")
            chains = chains.join(up, "top", "left").select("item", F.coalesce("parent", "top").alias("top"), (F.col("total") + F.coalesce("shift", F.lit(0))).alias("total"))
        bins = merged.where("climbs").groupBy(F.col("parent").alias("item")).agg(F.first("fill").alias("fill"), F.first("node").alias("node"))
        if merged.agg(F.countDistinct("node")).first()[0] <= 1:
            break
    chains = chains.withColumnRenamed("item", "pack_bin")
    out = placed.join(chains, "pack_bin", "left")
    return out.select(*[F.col(f"`{n}`") for n in names], F.coalesce("top", "pack_bin").alias("sequence_id"), (F.col("pack_offset") + F.coalesce("total", F.lit(0))).alias("offset"))
