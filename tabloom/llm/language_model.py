"""A hierarchical Pitman-Yor bigram model, its seating sampled by Gibbs, and whole-corpus scoring.

Restaurants: one for each context, which is the word before, known by its 64-bit hash; all share one
parent restaurant of words, whose base is uniform over the training vocabulary and one unknown word.
Every table of a context is a customer of the parent. Predictive probabilities are computed in each
of SAMPLES seatings and averaged; a text's score is the sum of the averages' logarithms.

Seating: for a word with c customers in a context, the number of tables is drawn from its full
conditional, generalised Stirling numbers times the chance that the parent serves the word anew,
for c up to ROWS. Cells of more customers keep their tables' sizes; a sweep takes RESEATED random
customers out of each and seats them again, so no count leaves the sampler. Words' tables in the
parent are drawn likewise from the Stirling numbers, and beyond ROWS by sequential seating in
blocks of a 64th of those who sit already. All cells of a sweep are drawn at once, given the others.

Spark's part: the text is read twice, once to count words. Each task packs its tokens by shard of the word, and a shard
becomes one row of sorted cells (word, context, training count) with the places of their tokens,
bucketed by shard, so that passes shuffle totals only. A pass runs sweeps over each shard. The
totals of a context are sums over shards; they meet by context, and each shard gets those of its own
contexts back, between passes. The first pass burns in, the second goes on from its seating and
keeps its samples. The last job scores cells, and sums for each text go back to the text's block.
Words of HOT of all tokens or more (counted over all texts before)
are spread over shards by context; what is known of them as a whole is a row for each, at most 1/HOT.

Defined results: null and empty texts are the end token alone; repeated rows count as often as
they occur and are scored each; without training tokens the model is uniform over one unknown word;
a null id is kept and scored, and teaches as `teaches` says. Other columns do not matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ._common import arrow_schema, batch_of, discard, give_back, hash_words, mixed, pieces_of, shared_dir, staged, texts_of, words_of

HOT = 0.002
#: Distinct words that a task counts before it passes them on.
MOST_COUNTED = 1_000_000
SHARD_BYTES = 10 << 20
MOST_BUCKETS = 20_000
#: Word shards for each shard of context totals.
SPREAD = 16
FLUSH = 1_000_000
STRENGTH = 1.0
ROWS, RESEATED = 256, 16
END, START = (hash_words(pa.array([x]))[0] for x in (" end", " start"))
HOME = 4096  # texts of a block whose sums are brought together
BURN, SAMPLES, SEED = 3, 4, 20


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpacked(x, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def small(x: np.ndarray) -> bytes:
    """Counting numbers in the narrowest type that holds them; its width comes first."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + packed(x.astype(kind))


def whole(x: bytes) -> np.ndarray:
    """What small() packed."""
    return unpacked(x[1:], f"u{x[0]}").astype(np.int64)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word hashes of all texts, each text closed by END; the context of each token; and where each text begins."""
    words, codes, offsets = words_of(texts)
    own = hash_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    h = np.insert(own, offsets[1:], END)
    offsets = offsets + np.arange(len(offsets))
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[offsets[:-1]] = START
    return h, before, offsets


def place_of(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash in a sorted array; -1 where it is not there."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def shard_of(h: np.ndarray, u: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    own = mixed(h ^ np.uint64(0xA5A5A5A5))
    return (np.where(place_of(hot, h) >= 0, mixed(own + u), own) % np.uint64(shards)).astype(np.int64)


def context_shard(u: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(u ^ np.uint64(0x5A5A5A5A)) % np.uint64(-(-shards // SPREAD))).astype(np.int64)


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64), [len(x)]])


@dataclass
class Totals:
    """What a pass holds fixed. In the last four, an entry for each sample; `hot_*` have one for each hot word as well."""

    tokens: int
    types: int
    discount: float
    parent_discount: float
    hot_counts: np.ndarray
    parent_customers: np.ndarray
    parent_tables: np.ndarray
    hot_customers: np.ndarray
    hot_tables: np.ndarray

    def base(self, s: int = 0) -> float:
        return (STRENGTH + self.parent_discount * float(self.parent_tables[s])) / (self.types + 1)

    def parent(self, customers, tables, s: int = 0):
        """The parent's probability of words with so many customers and tables there."""
        return (np.maximum(customers - self.parent_discount * tables, 0) + self.base(s)) / (STRENGTH + float(self.parent_customers[s]))


@dataclass
class Model:
    totals: Totals
    hot: np.ndarray
    shards: int
    state: DataFrame
    texts: DataFrame
    context_totals: DataFrame
    seats: DataFrame
    samples: int = field(default=SAMPLES)


def hot_words(docs: DataFrame, text_col="text") -> np.ndarray:
    """Sorted hashes of the words that make up HOT of all tokens, or more."""
    ddl = "word bigint, n bigint"
    schema = arrow_schema(ddl)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, texts in pieces_of(batch, "text"):
                words, n = counted(np.concatenate([words, tokens_of(texts)[0]]), n)
                if len(words) > MOST_COUNTED:
                    yield batch_of(schema, words.astype(np.int64), n)
                    words, n = words[:0], n[:0]
        yield batch_of(schema, words.astype(np.int64), n)

    counts = texts_of(docs, F.col(text_col).alias("text")).mapInArrow(count, ddl).groupBy("word").agg(F.sum("n").alias("n"))
    counts = staged(counts, "lm-words")
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= HOT * tokens).select("word").collect()
    discard(counts)
    return np.sort(np.array([r[0] for r in rows], np.int64).astype(np.uint64))


def counted(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, sorted, and how often each occurs; the first have been counted before, n times each."""
    words, at = np.unique(words, return_inverse=True)
    out = np.bincount(at, minlength=len(words))
    np.add.at(out, at[: len(n)], n - 1)
    return words, out


def trimmed(f):
    """f, after which the worker gives freed memory back."""

    def run(*tables: pa.Table) -> pa.Table:
        out = f(*tables)
        give_back()
        return out

    # Spark counts a function's parameters
    return (lambda table: run(table)) if f.__code__.co_argcount == 1 else (lambda table, other: run(table, other))


def token_blocks(docs: DataFrame, teaches: Column, hot: np.ndarray, shards: int, id_col="doc_id", text_col="text") -> DataFrame:
    """A row for each block of texts and shard with their tokens; and with a shard below 0, one of the texts themselves."""
    ddl = "home bigint, shard int, texts binary, words binary, sizes binary, contexts binary, at binary, docs binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen, held, texts_held, size = TaskContext.get().partitionId() << 28, 0, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, u, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            s = shard_of(h, u, hot, shards)
            where = (doc // (2 * HOME) - doc[0] // (2 * HOME)) * shards + s
            order = np.lexsort((h, where))
            h, u, doc, where = h[order], u[order], doc[order], where[order]
            cuts = runs(where)
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                w = runs(h[a:b])
                contexts, at = np.unique(u[a:b], return_inverse=True)
                rows.append((first + int(doc[a]) // (2 * HOME), int(where[a] % shards), None, packed(h[a:b][w[:-1]]), small(np.diff(w)), packed(contexts), small(at), small(doc[a:b] % (2 * HOME))))
                if len(rows) == 64:
                    yield batch_of(schema, *zip(*rows, strict=True))
                    rows = []
            at, ids, gone, n = (np.concatenate(x) for x in zip(*texts_held, strict=True))
            cuts = runs(at // HOME)
            rows += [(first + int(at[a]) // HOME, -1 - (first + int(at[a]) // HOME) % shards, packed(np.stack([at[a:b] % HOME, ids[a:b], gone[a:b], n[a:b]]).astype(np.int64)), *[None] * 5) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield batch_of(schema, *zip(*rows, strict=True))

        for batch in batches:
            for part, texts in pieces_of(batch, "text"):
                h, u, offsets = tokens_of(texts)
                n, ids = np.diff(offsets), part.column(0)
                taught = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                at = seen + np.arange(len(n))
                held.append((h, u, np.repeat(2 * at + taught, n)))
                texts_held.append((at, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), n))
                seen, size = seen + len(n), size + len(h)
                if size >= FLUSH:
                    yield from flush()
                    held, texts_held, size = [], [], 0
        if held:
            yield from flush()
            held, texts_held = [], []
        give_back()

    return texts_of(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(teaches, F.lit(False)).alias("teaches")).mapInArrow(run, ddl)


STATE = "shard int, words binary, spread binary, contexts binary, at binary, counts binary, uses binary, homes binary, home_at binary, docs binary, customers binary, tables binary, tokens bigint, types bigint, cells1 bigint, cells2 bigint, words1 bigint, words2 bigint, hot_counts array<bigint>, hot_tables array<bigint>, home bigint, texts binary"


def shard_states(blocks: DataFrame, hot: np.ndarray) -> DataFrame:
    """A row for each shard: words (sorted) and how many cells each has; of each cell the context, the training
    count and the number of its tokens; of each token the text; and what the shard knows of its contexts. Rows of texts are kept as they are."""
    schema = arrow_schema(STATE)

    def gather(table: pa.Table) -> pa.Table:
        if table["shard"][0].as_py() < 0:
            n = table.num_rows
            return pa.Table.from_arrays([table[f.name].combine_chunks() if f.name in ("shard", "home", "texts") else pa.nulls(n, f.type) for f in schema], schema=schema)
        # a column at a time, each in its narrow type: a worker holds the tokens of a shard once, not as blocks and as a whole
        column = lambda name: (x.as_py() for x in table[name])
        homes = table["home"].to_pylist()
        doc = [whole(x).astype(np.uint16) for x in column("docs")]  # below 2 * HOME
        home = np.repeat(np.arange(len(doc), dtype=np.int32), [len(x) for x in doc])
        doc = np.concatenate(doc)
        h = np.concatenate([np.repeat(unpacked(w, np.uint64), whole(n)) for w, n in zip(column("words"), column("sizes"), strict=True)])
        u = np.concatenate([unpacked(c, np.uint64)[whole(at)] for c, at in zip(column("contexts"), column("at"), strict=True)])
        order = np.lexsort((u, h))
        h = h[order]
        u = u[order]
        doc, home = doc[order], small(home[order])
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (u[1:] != u[:-1])])
        first = np.flatnonzero(new)
        uses = small(np.diff(np.append(first, len(h))))
        h, u = h[first], u[first]
        counts, docs = np.add.reduceat(doc & 1, first, dtype=np.int64), small(doc >> 1)
        del order, new, first, doc
        contexts, at = np.unique(u, return_inverse=True)
        del u
        w = runs(h)
        words, spread = h[w[:-1]], np.diff(w)
        known = counts > 0
        seats = np.add.reduceat(known.astype(np.int64), w[:-1])
        place = place_of(hot, words)
        of_hot = np.repeat(place, spread)
        hot_n, hot_t = (np.bincount(of_hot[of_hot >= 0], x[of_hot >= 0], len(hot)).astype(np.int64) for x in (counts, known))
        once = [int((counts == i).sum()) for i in (1, 2)] + [int((seats[place < 0] == i).sum()) for i in (1, 2)]
        row = (table["shard"][0].as_py(), packed(words), small(spread), packed(contexts), small(at), small(counts), uses, packed(np.array(homes, np.int64)), home, docs, small(np.bincount(at, counts, len(contexts)).astype(np.int64)), small(np.bincount(at, known, len(contexts)).astype(np.int64)), int(counts.sum()), int((seats[place < 0] > 0).sum()), *once, hot_n, hot_t, None, None)
        return pa.Table.from_batches([batch_of(schema, *[[x] for x in row])])

    return blocks.groupBy("shard").applyInArrow(trimmed(gather), STATE)


def bucketed(df: DataFrame, label: str, buckets: int) -> DataFrame:
    """As staged(), in files by shard: later groupings by shard shuffle what joins them, not this."""
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "shard").option("path", f"{shared_dir(df.sparkSession)}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)


def totals_of_contexts(rows: DataFrame, kinds: int) -> DataFrame:
    """rows (ctx, shard, contexts, sums: `kinds` arrays) as shard, ctx and the totals over all shards of the contexts of each row, in its order."""
    ddl = "shard int, ctx int, totals binary"
    schema = arrow_schema(ddl)

    def total(table: pa.Table) -> pa.Table:
        keys = [unpacked(x, np.uint64) for x in table["contexts"].to_pylist()]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        parts = [whole(x).reshape(kinds, -1) for x in table["sums"].to_pylist()]
        sums = [np.bincount(at, np.concatenate([p[k] for p in parts])).astype(np.int64) for k in range(kinds)]
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        ctx = table["ctx"][0].as_py()
        return pa.Table.from_batches([batch_of(schema, [s], [ctx], [small(np.stack([x[at[a:b]] for x in sums]))]) for s, a, b in zip(table["shard"].to_pylist(), ends[:-1], ends[1:], strict=True)])

    return rows.groupBy("ctx").applyInArrow(trimmed(total), ddl)


def by_context_shard(contexts: np.ndarray, sums: np.ndarray, shards: int) -> list[tuple[int, bytes, bytes]]:
    """ctx, contexts and sums of the rows that totals_of_contexts reads."""
    ctx = context_shard(contexts, shards)
    return [(int(c), packed(contexts[own]), small(sums[:, own])) for c in np.unique(ctx) for own in [ctx == c]]


def seen_totals(rows: list[dict], contexts: np.ndarray, kinds: int, shards: int) -> np.ndarray:
    """[kinds, contexts]: the totals that came back to a shard."""
    out, ctx = np.zeros((kinds, len(contexts)), np.int64), context_shard(contexts, shards)
    for r in rows:
        out[:, ctx == r["ctx"]] = whole(r["totals"]).reshape(kinds, -1)
    return out


def first_sums(state: DataFrame, shards: int) -> DataFrame:
    ddl = "ctx int, shard int, contexts binary, sums binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                parts = by_context_shard(unpacked(r["contexts"], np.uint64), np.stack([whole(r["customers"]), whole(r["tables"])]), shards)
                yield batch_of(schema, *zip(*[(c, r["shard"], k, v) for c, k, v in parts], strict=True))

    return state.select("shard", "contexts", "customers", "tables").mapInArrow(run, ddl)


def log_stirling(discount: float, rows: int = ROWS) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t), for c and t up to rows."""
    out = np.full((rows + 1, rows + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(rows + 1)
    for c in range(rows):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def draw_tables(rng: np.random.Generator, counts: np.ndarray, rate: np.ndarray, stirling: np.ndarray, step: np.ndarray | float, discount: float) -> np.ndarray:
    """Tables for `counts` customers of a dish, from their full conditional: S(c, t) times the product over tables j of (rate + step * j).

    Beyond ROWS customers, the first ROWS are seated so and the others sequentially, in blocks.
    """
    out = np.ones(len(counts), np.int64)
    c = np.minimum(counts, ROWS)
    rate, step = np.broadcast_to(rate, counts.shape), np.broadcast_to(step, counts.shape)
    for size in np.unique(c):
        if size > 1:
            at = np.flatnonzero(c == size)
            for part in np.array_split(at, max(1, len(at) * int(size) // 2_000_000)):
                odds = np.cumsum(np.log(rate[part, None] + step[part, None] * np.arange(size)[None, :]), axis=1) + stirling[size, 1 : size + 1]
                out[part] = 1 + np.argmax(odds + rng.gumbel(size=odds.shape), axis=1)
    left, seated = np.flatnonzero(counts > ROWS), ROWS
    while len(left):
        block = np.minimum(counts[left] - seated, max(1, seated // 64))
        new = rate[left] + step[left] * out[left]
        out[left] += rng.binomial(block, new / (new + np.maximum(seated + block / 2 - discount * out[left], 1e-9)))
        seated += max(1, seated // 64)
        left = left[counts[left] > seated]
    return np.where(counts > 0, out, 0)


class Tables:
    """The sizes of the tables of cells with many customers, one cell after the other."""

    def __init__(self, rng: np.random.Generator, customers: np.ndarray, sizes: np.ndarray | None, tables: np.ndarray, discount: float):
        self.rng, self.customers, self.discount = rng, customers, discount
        self.tables = tables.astype(np.int64)
        if sizes is None:  # any start will do: sizes as they are in the limit of many customers
            share = rng.gamma(1 - discount, size=self.tables.sum()) + 1e-12
            cell = np.repeat(np.arange(len(tables)), self.tables)
            sizes = 1 + np.floor(share / np.bincount(cell, share)[cell] * (customers - self.tables)[cell]).astype(np.int64)
            start = np.cumsum(self.tables) - self.tables
            sizes[start] += customers - np.add.reduceat(sizes, start) if len(start) else 0
        self.sizes = sizes.copy()

    def picked(self, ends: np.ndarray, before: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The table of a random customer of each cell."""
        return np.searchsorted(ends, before + self.rng.integers(0, np.maximum(n, 1)), "right")

    def reseat(self, rate: np.ndarray, step: np.ndarray) -> None:
        """One random customer of each cell stands up and is seated by the predictive rule."""
        base = np.cumsum(self.customers) - self.customers
        out = self.picked(np.cumsum(self.sizes), base, self.customers)
        self.sizes[out] -= 1
        self.tables -= self.sizes[out] == 0
        rest = self.customers - 1
        ends, base = np.cumsum(self.sizes), np.cumsum(rest) - rest
        new = np.maximum(rate + step * self.tables, 0)
        opens = self.rng.random(len(rest)) * (new + rest - self.discount * self.tables) < new
        opens |= rest == 0
        seek = np.flatnonzero(~opens)
        while len(seek):  # a table by size, accepted as (size - discount) / size
            at = self.picked(ends, base[seek], rest[seek])
            took = self.rng.random(len(seek)) * self.sizes[at] < self.sizes[at] - self.discount
            self.sizes[at[took]] += 1
            seek = seek[~took]
        again = np.flatnonzero(opens & (self.sizes[out] == 0))
        more = np.flatnonzero(opens & (self.sizes[out] != 0))
        self.sizes[out[again]] = 1
        self.tables[opens] += 1
        fresh = np.sort(out[more])
        self.sizes = np.insert(self.sizes, fresh, 1)

    def compact(self) -> None:
        self.sizes = self.sizes[self.sizes > 0]


def sweeps(rng: np.random.Generator, words: np.ndarray, word: np.ndarray, at: np.ndarray, n: np.ndarray, context_tables: np.ndarray, totals: Totals, hot: np.ndarray, start: tuple | None, burn: int, samples: int):
    """Seatings of a shard's trained cells (of `word`, in context number `at`, with n customers): tables of
    each cell [samples, cells], of each word in the parent [samples, words] (0 for hot ones), and the table sizes of large cells."""
    d, d0 = totals.discount, totals.parent_discount
    cells, parents = log_stirling(d), log_stirling(d0)
    place = place_of(hot, words)
    is_hot = place >= 0
    few, large = np.flatnonzero((n > 1) & (n <= ROWS)), np.flatnonzero(n > ROWS)
    t, sizes = start if start is not None else (np.ones(len(n), np.int64), None)
    t, own = t.copy(), t.copy()  # own: the seating that the totals of contexts count
    held = None
    kept_t, kept_top = [], []
    for sweep in range(burn + samples):
        customers = np.bincount(word, t, len(words)).astype(np.int64)
        top = np.where(is_hot, 0, draw_tables(rng, np.where(is_hot, 0, customers), totals.base(), parents, 0.0, d0))
        customers = np.where(is_hot, totals.hot_customers[0][place] if len(hot) else 0, customers)
        tops = np.where(is_hot, totals.hot_tables[0][place] if len(hot) else 0, top)

        def conditional(cell: np.ndarray, customers=customers, tops=tops) -> tuple[np.ndarray, np.ndarray]:
            others = np.maximum(customers[word[cell]] - t[cell], 0)
            serve = totals.parent(others, np.minimum(tops[word[cell]], others))
            rest = np.maximum(context_tables[at[cell]] - own[cell], 0)
            return (STRENGTH + d * rest) * serve, d * serve

        rate, step = conditional(few)
        drawn = draw_tables(rng, n[few], rate, cells, step, d)
        if len(large):
            rate, step = conditional(large)
            if held is None:
                held = Tables(rng, n[large], sizes, t[large] if sizes is not None else draw_tables(rng, n[large], rate, cells, step, d), d)
            for _ in range(RESEATED):
                held.reseat(rate, step)
            held.compact()
            t[large] = held.tables
        t[few] = drawn
        if sweep >= burn:
            customers = np.bincount(word, t, len(words)).astype(np.int64)
            kept_t.append(t.copy())
            kept_top.append(np.where(is_hot, 0, draw_tables(rng, np.where(is_hot, 0, customers), totals.base(), parents, 0.0, d0)))
    return np.stack(kept_t), np.stack(kept_top), held.sizes if held is not None else np.zeros(0, np.int64)


def cells_of(r: dict) -> tuple[np.ndarray, ...]:
    """words, and of each cell the word's number, the context's number and the training count."""
    words, spread = unpacked(r["words"], np.uint64), whole(r["spread"])
    return words, np.repeat(np.arange(len(words)), spread), whole(r["at"]), whole(r["counts"])


SEATS = "shard int, seats binary, tops binary, sizes binary, ctx int, contexts binary, sums binary, customers array<bigint>, tops_sum array<bigint>, hot_customers array<bigint>"


def gibbs_pass(state: DataFrame, came: DataFrame, totals: Totals, hot: np.ndarray, shards: int, pass_no: int, kinds: int, burn: int, samples: int) -> DataFrame:
    """The seatings of a pass, and the sums that it sends to contexts. came: the totals of contexts (of `kinds` arrays, tables last) and the last pass's seating."""
    schema = arrow_schema(SEATS)

    def run(states: pa.Table, known: pa.Table) -> pa.Table:
        r, rows = states.to_pylist()[0], known.to_pylist()
        words, word, at, n = cells_of(r)
        contexts = unpacked(r["contexts"], np.uint64)
        tables = seen_totals([x for x in rows if x["ctx"] is not None], contexts, kinds, shards)[-1]
        own = np.flatnonzero(n > 0)
        word, at, n = word[own], at[own], n[own]
        start = next(((x["seats"], x["sizes"]) for x in rows if x["seats"] is not None), None)
        if start is not None:
            t = np.ones(len(n), np.int64)
            t[n > 1] = whole(start[0])
            start = (t, whole(start[1]))
        rng = np.random.default_rng([SEED, pass_no, r["shard"]])
        t, top, sizes = sweeps(rng, words, word, at, n, tables, totals, hot, start, burn, samples)
        sums = np.stack([np.bincount(at, x, len(contexts)).astype(np.int64) for x in t])
        place = place_of(hot, words)[word]
        hots = [np.bincount(place[place >= 0], x[place >= 0], len(hot)).astype(np.int64) for x in t]
        out = [(r["shard"], small(t[:, n > 1]), small(top), small(sizes), None, None, None, t.sum(axis=1), top.sum(axis=1), np.concatenate(hots))]
        out += [(r["shard"], None, None, None, c, k, v, None, None, None) for c, k, v in by_context_shard(contexts, sums, shards)]
        return pa.Table.from_batches([batch_of(schema, *zip(*out, strict=True))])

    needed = state.select("shard", "words", "spread", "contexts", "at", "counts")
    return needed.groupBy("shard").cogroup(came.groupBy("shard")).applyInArrow(trimmed(run), SEATS)


def summed(rows: DataFrame, column: str, length: int) -> np.ndarray:
    """The sum over rows of an array column, by place."""
    out = np.zeros(length)
    for at, x in rows.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[at] = x
    return out


def fit(docs: DataFrame, teaches: Column, id_col="doc_id", text_col="text") -> Model:
    """A model that learned from the rows for which `teaches` is true, and can score all rows of docs."""
    all_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = int(max(8, -(-all_bytes // SHARD_BYTES)))
    hot = hot_words(docs, text_col)
    held = bucketed(shard_states(token_blocks(docs, teaches, hot, shards, id_col, text_col), hot), "lm_state", min(shards, MOST_BUCKETS))
    state = held.where("shard >= 0")
    s = state.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "cells1", "cells2", "words1", "words2")]).first()
    hot_counts, hot_tables = summed(state, "hot_counts", len(hot)), summed(state, "hot_tables", len(hot))
    share = lambda a, b: float(np.clip(a / max(a + 2 * b, 1), 0.1, 0.9))
    types = s["types"] + int((hot_counts > 0).sum())
    d, d0 = share(s["cells1"], s["cells2"]), share(s["words1"], s["words2"])
    parents = log_stirling(d0)
    rng = np.random.default_rng(SEED)
    sums = staged(first_sums(state, shards), "lm-sums")
    first = staged(totals_of_contexts(sums, 2), "lm-contexts")
    cells = float(first_tables(state))
    totals = Totals(s["tokens"], types, d, d0, hot_counts, np.array([cells]), np.array([float(types)]), hot_tables[None, :], (hot_tables > 0)[None, :].astype(float))

    def after(rows: DataFrame, n: int) -> Totals:
        got = rows.where("seats IS NOT NULL")
        customers, tops, hots = summed(got, "customers", n), summed(got, "tops_sum", n), summed(got, "hot_customers", n * len(hot)).reshape(n, len(hot))
        drawn = np.stack([draw_tables(rng, x.astype(np.int64), totals.base(), parents, 0.0, d0) for x in hots]).astype(float) if n else np.zeros((0, len(hot)))
        return replace(totals, parent_customers=customers, parent_tables=tops + drawn.sum(axis=1), hot_customers=hots, hot_tables=drawn)

    none = lambda df: df.select("shard", "ctx", "totals", F.lit(None).cast("binary").alias("seats"), F.lit(None).cast("binary").alias("sizes"))
    burnt = staged(gibbs_pass(state, none(first), totals, hot, shards, 1, 2, BURN, 1), "lm-burnt")
    totals = after(burnt, 1)
    second = staged(totals_of_contexts(burnt.where("ctx IS NOT NULL"), 1), "lm-contexts")
    goes_on = burnt.where("seats IS NOT NULL").select("shard", F.lit(None).cast("int").alias("ctx"), F.lit(None).cast("binary").alias("totals"), "seats", "sizes")
    seats = staged(gibbs_pass(state, none(second).unionByName(goes_on), totals, hot, shards, 2, 1, 1, SAMPLES), "lm-seats")
    totals = after(seats, SAMPLES)
    third = staged(totals_of_contexts(seats.where("ctx IS NOT NULL"), SAMPLES), "lm-contexts")
    both = first.select("shard", "ctx", "totals", F.lit(True).alias("counts")).unionByName(third.select("shard", "ctx", "totals", F.lit(False).alias("counts")))
    discard(sums, burnt, second)
    return Model(totals, hot, shards, state, held.where("shard < 0").select("home", "texts"), both, seats.where("seats IS NOT NULL").select("shard", "seats", "tops"))


def first_tables(state: DataFrame) -> int:
    """How many cells have been seen in training."""
    schema = arrow_schema("n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(schema, [int((whole(x) > 0).sum()) for x in batch.column(0).to_pylist()])

    return state.select("counts").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def base_log10(count, totals: Totals):
    return np.log10((count + 0.5) / (totals.tokens + 0.5 * (totals.types + 1)))


def probabilities(r: dict, rows: list[dict], totals: Totals, hot: np.ndarray, shards: int, samples: int):
    """Of a shard's row: words, each cell's word, context and count, its tables and its word's in the parent in
    each sample, log10 of the averaged predictive probability, and each word's training count."""
    words, word, at, n = cells_of(r)
    contexts = unpacked(r["contexts"], np.uint64)
    customers = seen_totals([x for x in rows if x["counts"]], contexts, 2, shards)[0]
    tables = seen_totals([x for x in rows if x["counts"] is False], contexts, samples, shards)
    mine = next(x for x in rows if x["seats"] is not None)
    many = n > 1
    t = np.tile((n > 0).astype(np.int64), (samples, 1))
    t[:, many] = whole(mine["seats"]).reshape(samples, -1)
    top = whole(mine["tops"]).reshape(samples, -1).copy()
    place = place_of(hot, words)
    is_hot = np.flatnonzero(place >= 0)
    count = np.bincount(word, n, len(words))
    count[is_hot] = totals.hot_counts[place[is_hot]]
    p = np.zeros(len(n))
    for s in range(samples):
        served = np.bincount(word, t[s], len(words))
        served[is_hot] = totals.hot_customers[s][place[is_hot]]
        top[s, is_hot] = totals.hot_tables[s][place[is_hot]]
        parent = totals.parent(served, top[s], s)
        p += n - totals.discount * t[s] + (STRENGTH + totals.discount * tables[s][at]) * parent[word]
    return words, word, contexts[at], n, t, top, np.log10(p / samples / (STRENGTH + customers[at])), count


def joined(model: Model, columns: list[str]):
    """The shards' rows, grouped with what the passes found out for them."""
    blank = lambda kind: F.lit(None).cast(kind)
    facts = model.context_totals.select("shard", "ctx", "totals", "counts", blank("binary").alias("seats"), blank("binary").alias("tops"))
    facts = facts.unionByName(model.seats.select("shard", blank("int").alias("ctx"), blank("binary").alias("totals"), blank("boolean").alias("counts"), "seats", "tops"))
    return model.state.select("shard", "words", "spread", "contexts", "at", "counts", *columns).groupBy("shard").cogroup(facts.groupBy("shard"))


def cells(model: Model) -> DataFrame:
    """word and context (hashes), n, tables and parent_tables (an entry for each sample) and log10_p of every bigram of the corpus."""
    ddl = "word bigint, context bigint, n bigint, tables array<bigint>, parent_tables array<bigint>, log10_p double"
    schema = arrow_schema(ddl)
    totals, hot, shards, samples = model.totals, model.hot, model.shards, model.samples

    def run(states: pa.Table, known: pa.Table) -> pa.Table:
        words, word, context, n, t, top, p, _ = probabilities(states.to_pylist()[0], known.to_pylist(), totals, hot, shards, samples)
        return pa.Table.from_batches([batch_of(schema, words[word].astype(np.int64), context.astype(np.int64), n, t.T.tolist(), top[:, word].T.tolist(), p)])

    return joined(model, []).applyInArrow(run, ddl)


def score(model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of every row that the model was made from; scores are sums over tokens of log10 probabilities."""
    out_ddl = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double"
    result = arrow_schema(out_ddl)
    ddl = "home bigint, texts binary, docs binary, known binary, sums binary"
    schema = arrow_schema(ddl)
    totals, hot, shards, samples = model.totals, model.hot, model.shards, model.samples

    def answer(states: pa.Table, known: pa.Table) -> pa.Table:
        """For each block of texts that has tokens in this shard, the sums of its texts."""
        r = states.to_pylist()[0]
        _, word, _, _, _, _, p, count = probabilities(r, known.to_pylist(), totals, hot, shards, samples)
        uses, homes, home = whole(r["uses"]), unpacked(r["homes"], np.int64), whole(r["home_at"])
        cell = np.repeat(np.arange(len(p)), uses)
        key, local = np.unique(home * HOME + whole(r["docs"]), return_inverse=True)
        n = np.bincount(local, (count > 0)[word][cell], len(key)).astype(np.int64)
        plain, value = (np.bincount(local, x[cell], len(key)) for x in (base_log10(count, totals)[word], p))
        cuts = runs(key // HOME)
        rows = [(int(homes[key[a] // HOME]), None, small(key[a:b] % HOME), small(n[a:b]), packed(np.stack([plain[a:b], value[a:b]]))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.Table.from_batches([batch_of(schema, *zip(*rows, strict=True))])

    def finish(table: pa.Table) -> pa.Table:
        """The rows of one block of texts."""
        known, sums, own = np.zeros(HOME, np.int64), np.zeros((2, HOME)), []
        for r in sorted(table.to_pylist(), key=lambda r: (r["docs"] or b"", r["sums"] or b"")):
            if r["texts"] is not None:
                own.append(unpacked(r["texts"], np.int64).reshape(4, -1))
            else:
                at = whole(r["docs"])
                known[at] += whole(r["known"])
                sums[:, at] += unpacked(r["sums"], np.float64).reshape(2, -1)
        at, ids, gone, n = np.concatenate(own, axis=1)
        total = np.round(sums[:, at], 9)
        return pa.Table.from_batches([batch_of(result, pa.array(ids, mask=gone.astype(bool)), n, known[at], total[0], total[1], np.round(10 ** np.minimum(-total[1] / n, 300), 6))])

    answers = joined(model, ["uses", "homes", "home_at", "docs"]).applyInArrow(trimmed(answer), ddl)
    blank = F.lit(None).cast("binary")
    texts = model.texts.select("home", "texts", blank.alias("docs"), blank.alias("known"), blank.alias("sums"))
    return texts.unionByName(answers).groupBy("home").applyInArrow(trimmed(finish), out_ddl)
