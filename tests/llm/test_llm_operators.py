"""The training-data operators against brute force, on small tables with every awkward row."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.llm import ann, langid, language_model, media, mixing, neardup, packing, sharding, token_counts, toxicity
from tabloom.llm._common import fold_of, words_of
from tabloom.llm.queries import BPE, PIECES

ALPHABET = [f"w{i}" for i in range(60)]


def text(rng, n):
    return " ".join(rng.choice(ALPHABET, n))


def plain_words(t):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, nulls, empty and long texts, ties, and columns with names used inside."""
    rng = np.random.default_rng(1)
    rows = [(i, text(rng, int(rng.integers(5, 60))), "en" if i % 2 else "fr", f"s{i % 4}") for i in range(60)]
    base = text(rng, 80).split()
    for i in range(60, 90):
        own = list(base)
        for at in rng.choice(80, int(rng.integers(0, 6)), replace=False):
            own[at] = f"x{i}{at}"
        rows.append((i, " ".join(own), "en", "s1"))
    rows += [(90, None, "en", "s1"), (91, "", None, None), (92, " \t\n", "fr", "s2"), (93, "One", "en", "s1"), (94, "one", "en", "s1"), (95, "A\x0bB\x1fc", "fr", None), (96, text(rng, 9000), "en", "long"), (97, rows[5][1], "en", "s1"), (97, rows[5][1], "en", "s1"), (None, rows[6][1], "en", "s1"), (None, "zz yy xx", "en", "s9"), (98, rows[7][1].upper() + " ", "en", "s1")]
    return spark.createDataFrame([(*r, i, "x", 1.5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, value long, `key` string, score double").repartition(3)


def empty(docs):
    return docs.where(F.lit(False))


def test_words(docs):
    import pyarrow as pa

    texts = [t or "" for (t,) in docs.select("text").collect()] + ["İ Ā Z", "a b"]
    words, codes, ends = words_of(pa.array(texts))
    words = words.to_pylist()
    assert [[words[c] for c in codes[a:b]] for a, b in zip(ends, ends[1:], strict=False)] == [plain_words(t) for t in texts]


def brute_groups(rows, width, t):
    sets = []
    for _, x in rows:
        w = plain_words(x)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 100 * t * len(sets[i] | sets[j]) - 1e-9:
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)].append(d)
    return Counter((rows[i][0], len(sets[i]), min(low[find(i)], default=None)) for i in range(len(rows)))


@pytest.mark.parametrize(("width", "k"), [(2, 64), (5, 64), (1, 16)])
def test_near_duplicates(docs, width, k):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = neardup.near_duplicates(docs, width, 0.8, k).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups(rows, width, 0.8)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.near_duplicates(empty(docs), width).count() == 0


def test_one_of_each(docs):
    out = neardup.one_of_each(docs, 5, 0.8)
    assert out.columns == docs.columns
    groups = {r["component_id"] for r in neardup.near_duplicates(docs, 5).where("n_shingles > 0").collect()}
    kept = [r["doc_id"] for r in out.collect() if plain_words(r["text"])]
    assert Counter(kept) == Counter(groups)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 99)], "a long, b long")
    got = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[100] == got[101] == 99


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        share = left / sum(w[s] for s in open_)
        full = {s for s in open_ if target[s] + share * w[s] >= most * sizes[s]}
        for s in open_:
            target[s] += share * w[s]
        left = sum(target[s] - most * sizes[s] for s in full)
        for s in full:
            target[s] = float(most * sizes[s])
        open_ -= full
    return target


def test_mixing(docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    sizes = Counter()
    for d, t, s in docs.select("doc_id", "text", "source").collect():
        sizes[s] += len(plain_words(t))
    target = brute_targets(sizes)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
    assert all(abs(taken[s] - target[s]) <= 1.5 for s in target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(empty(docs)).count() == 0


def test_mixed_documents(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for s, t in out.select("source", "text").collect():
        words[s] += len(plain_words(t))
    want = Counter()
    for r in mixing.mix_sources(docs).collect():
        want[r["source"]] += r["taken"]
    assert +words == +want


def test_packing(docs):
    from tokenizers import Tokenizer

    rows = packing.pack(packing.token_pieces(docs, BPE, capacity=256), capacity=256).collect()
    exact = Tokenizer.from_file(BPE)
    want = Counter()
    for d, t in docs.select("doc_id", "text").collect():
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids), 256), len(ids)]
        want.update((d, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert len(bins) <= math.ceil(total / 256) * 1.05 + 1
    assert packing.pack(packing.token_pieces(empty(docs), BPE)).count() == 0


def test_cuts_have_the_ids_of_whole_texts():
    """Texts of every kind of white space, letters, digits, marks and special tokens, cut and whole."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    exact, encode = Tokenizer.from_file(BPE), packing.Encoder(BPE)
    rng = np.random.default_rng(0)
    some = [" ", " ", " ", "  ", *packing.BLANK, "\x1c", "\x1f", "\u200b", "a", "Bc", "it's", "'ll", "7", "42", "!", "?!", "é", "ش", "漢", "😀", "_", "-", "<|endoftext|>", "word", "İ", "\u0301"]
    texts = ["", " ", "a", " a ", *["".join(rng.choice(some, int(rng.integers(1, 12)))) for _ in range(6000)]]
    for _ in range(2):  # from memory the second time
        got = encode(pa.array(texts))
        for t, ids, e in zip(texts, got, exact.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids.tolist() == e.ids, repr(t)


def test_packing_in_many_levels(spark):
    """Tiny leaves and nodes: several levels, nodes dealt over tasks, and still few sequences."""
    rng = np.random.default_rng(3)
    pieces = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.integers(1, 100, 3000))], "doc_id long, length long").repartition(40)
    rows = packing.pack(pieces, capacity=100, slack=2, fan_in=3, leaf_size=20, node_size=300).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 100
    assert len(bins) <= 1.1 * sum(r["length"] for r in rows) / 100


@pytest.fixture(params=[0.002, 2.0])
def hot_share(request, monkeypatch):
    """With words spread over shards by context, and without."""
    monkeypatch.setattr(language_model, "HOT", request.param)
    return request.param


def test_frequent_words_are_counted_over_all_texts(spark, monkeypatch):
    """A word that is frequent in a few long texts only, of which a sample may see none, is found."""
    monkeypatch.setattr(language_model, "MOST_COUNTED", 3)
    rows = [(i, f"w{i % 1000} v{i % 999}") for i in range(60_000)] + [(60_000 + i, "seldom " * 300) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = language_model.hash_words(pa.array(["seldom", " end"]))
    assert language_model.hot_words(df).tolist() == sorted(wanted.tolist())


def test_language_model(docs, hot_share):
    """Counts and base scores by brute force; scores from the model's own seatings, by sums over plain dictionaries."""
    teaches = F.coalesce(fold_of(F.col("doc_id"), 5) != 1, F.lit(False))
    model = language_model.fit(docs, teaches)
    assert (len(model.hot) > 0) == (hot_share < 1)
    rows = language_model.score(model).collect()
    c, texts = Counter(), []
    for d, t in docs.select("doc_id", "text").collect():
        texts.append((d, [*plain_words(t), " end"]))
        if d is not None and zlib.crc32(str(d).encode()) % 5 != 1:
            c.update(texts[-1][1])
    n, v = sum(c.values()), len(c)
    assert (model.totals.tokens, model.totals.types) == (n, v)
    code = {w: int(h) for ws in [sorted({w for _, ws in texts for w in ws} | {" start"})] for w, h in zip(ws, language_model.hash_words(language_model.pa.array(ws)).astype(np.int64), strict=True)}
    cells = {(r["context"], r["word"]): r for r in language_model.cells(model).collect()}
    assert set(cells) == {(code[a], code[b]) for _, ws in texts for a, b in zip([" start", *ws], ws, strict=False)}
    trained = [r for r in cells.values() if r["n"]]
    assert all(1 <= t <= r["n"] for r in trained for t in r["tables"])
    d, d0, k = model.totals.discount, model.totals.parent_discount, model.samples
    customers, tables, served, top = Counter(), Counter(), Counter(), {}
    for r in trained:
        customers[r["context"]] += r["n"]
        for s in range(k):
            tables[r["context"], s] += r["tables"][s]
            served[r["word"], s] += r["tables"][s]
            top[r["word"], s] = r["parent_tables"][s]

    def parent(w, s):
        rest = (1 + d0 * sum(x for (_, j), x in top.items() if j == s)) / (v + 1)
        return (max(served[w, s] - d0 * top.get((w, s), 0), 0) + rest) / (1 + sum(x for (_, j), x in served.items() if j == s))

    parents = {(w, s): parent(w, s) for w in [*code.values(), 0] for s in range(k)}

    def p(u, w):
        r = cells.get((u, w))
        return sum((r["n"] - d * r["tables"][s] if r and r["n"] else 0) + (1 + d * tables[u, s]) * parents[w, s] for s in range(k)) / k / (1 + customers[u])

    assert all(math.isclose(10 ** r["log10_p"], p(*x), rel_tol=1e-9) for x, r in cells.items())
    seen = {code[w] for w in c}
    for u in list(customers)[:20]:  # known words and one unknown one add up to 1
        assert math.isclose(sum(p(u, w) for w in seen) + p(u, 0), 1, rel_tol=1e-9)
    want = Counter()
    for i, ws in texts:
        want[i, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5), round(sum(math.log10(p(code[a], code[b])) for a, b in zip([" start", *ws], ws, strict=False)), 5)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5)) for r in rows) == want
    assert all(math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"]), rel_tol=1e-5, abs_tol=1e-5) for r in rows)


def test_language_model_of_nothing(docs):
    assert language_model.score(language_model.fit(empty(docs), F.lit(True))).count() == 0
    rows = language_model.score(language_model.fit(docs, F.lit(False))).collect()
    assert len(rows) == docs.count() and all(math.isclose(r["score"], 0, abs_tol=1e-6) for r in rows)  # one unknown word is all there is


def test_stirling_sampler():
    """Tables drawn from the full conditional have the mean that enumeration gives."""
    d, rate, step, c = 0.5, 0.8, 0.1, 6
    s = np.exp(language_model.log_stirling(d, 8))
    odds = np.array([s[c, t] * np.prod([rate + step * j for j in range(t)]) for t in range(1, c + 1)])
    want = (odds * np.arange(1, c + 1)).sum() / odds.sum()
    drawn = language_model.draw_tables(np.random.default_rng(0), np.full(40_000, c), np.full(40_000, rate), language_model.log_stirling(d), step, d)
    assert abs(drawn.mean() - want) < 0.03
    big = language_model.draw_tables(np.random.default_rng(0), np.array([100_000, 1, 0]), np.array([2.0, 2.0, 2.0]), language_model.log_stirling(d), 0.0, d)
    assert 1 <= big[0] <= 100_000 and big[1] == 1 and big[2] == 0


def test_reseating_has_the_same_distribution():
    """Single customers who change tables reach the distribution that the Stirling numbers give."""
    d, rate, step, c, m = 0.6, 3.0, 0.05, 40, 4000
    s = language_model.log_stirling(d, c)
    odds = s[c, 1 : c + 1] + np.cumsum(np.log(rate + step * np.arange(c)))
    odds = np.exp(odds - odds.max())
    want = (odds * np.arange(1, c + 1)).sum() / odds.sum()
    held = language_model.Tables(np.random.default_rng(1), np.full(m, c), None, np.ones(m, np.int64), d)
    for i in range(2000):
        held.reseat(np.full(m, rate), np.full(m, step))
        if i % 50 == 49:
            held.compact()
    assert held.sizes.sum() == m * c and len(held.sizes) == held.tables.sum()
    assert abs(held.tables.mean() - want) < 0.1


def test_audio(docs):
    rows = media.audio_digest(media.with_audio(docs)).collect()
    want = Counter()
    for d, t in docs.select("doc_id", "text").collect():
        raw = (t or "").encode()
        size = max(192, -(-len(raw) // 192) * 192)
        p = raw + b" " * (size - len(raw))
        want[d, len(raw), size, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), size + 44] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"]) for r in rows) == want
    by = defaultdict(set)
    for r in rows:
        by[r["payload_sha256"]].add((r["feature"], r["media_sha256"]))
    assert all(len(x) == 1 for x in by.values())
    assert media.audio_digest(media.with_audio(empty(docs))).count() == 0


def test_audio_parts(spark, docs):
    t = np.arange(16_000) / 16_000
    x = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    y = media.resample(x)
    want = np.sin(2 * np.pi * 440 * np.arange(12_000) / 12_000)
    assert len(y) == 12_000 and np.abs(y - want)[100:-100].max() < 0.02
    high = media.resample(np.sin(2 * np.pi * 7500 * t).astype(np.float32))
    assert np.abs(high[200:-200]).max() < 0.1  # above the new rate's half
    mel, _ = media.log_mel(y)
    assert mel.shape == (1 + (12_000 - 300) // 120, 32) and len(set(mel.argmax(axis=1)[2:-2])) == 1
    power = np.array([0, 0.2, 0.13, 0.11, 0.2, 0.13])
    assert media.hysteresis(power).tolist() == [[1, 3], [4, 6]]
    audio = media.audio_spans(media.with_audio(docs.where("doc_id = 96")))
    spans = audio.orderBy("span").collect()
    assert [r["span"] for r in spans] == list(range(len(spans))) and all(len(r["tensor"]) == 64 * 32 for r in spans)
    arrow = media.tensor_array(audio.select("tensor").toArrow()["tensor"].combine_chunks())
    assert arrow.to_numpy_ndarray().shape == (len(spans), 64, 32)


@pytest.mark.parametrize("units", [1, 2, 3, 4, 5, 6, 7, 11])
def test_audio_features_reach_the_end(units):
    """A change in the last byte alone changes the features, wherever the last whole frame ends."""
    base = "the words of a text " * 120
    texts = [base[: 192 * units - 1] + end for end in "aZ"]
    first, second = (media.features(media.to_wav(media.payload_of(t)[0])) for t in texts)
    assert first[0].shape == second[0].shape
    assert not np.array_equal(np.round(first[0] * 256), np.round(second[0] * 256))


@pytest.fixture(scope="module")
def voices(spark):
    rng = np.random.default_rng(4)
    words = {"xa": ["the", "and", "of", "thing"], "xb": ["der", "und", "die", "schön"], "xc": ["le", "et", "les", "très"]}
    rows = [(i, lang := list(words)[i % 3], " ".join(rng.choice(words[lang], 12))) for i in range(300)]
    rows += [(300, None, "the and"), (301, "xa", None), (302, "xa", "123 ..."), (303, "xb", "schönung undder"), (304, "xa", "")]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_language_id(voices):
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(voices, ~held)
    got = {r["doc_id"]: r for r in langid.identify(voices, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in voices.where("doc_id < 300").collect()}
    assert all(got[d]["lang_pred"] == lang for d, lang in truth.items())
    assert got[303]["lang_pred"] == "xb" and got[300]["lang_pred"] == "xa"
    assert [got[d]["lang_pred"] for d in (301, 302, 304)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.identified_documents(voices, model, "p", "s")
    assert kept.columns == ["doc_id", "lang", "text", "p", "s"] and kept.count() == voices.count()
    assert all(r["lang_pred"] == "und" for r in langid.identify(voices, langid.fit(empty(voices))).collect())


@pytest.fixture(scope="module")
def judged(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        own = text(rng, 30).split() + (list(rng.choice(["vile", "foul", "nasty"], 2)) if bad else [])
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    rows += [(400, None), (401, ""), (None, "vile foul"), (402, "VILE!"), (5, rows[5][1])]
    labels += [(400, 1), (401, 0), (None, 1), (0, None), (0, 1), (999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"label": F.lit("x"), "ex_id": F.lit(1), "rank": F.lit(2)})
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int").withColumns({"label": F.lit("y"), "rank": F.lit(3), "ex_id": F.lit(4)})


def test_toxicity(judged):
    docs, labels = judged
    index = toxicity.fit(docs, labels, ~langid.held_out(F.col("doc_id")))
    rows = toxicity.score(docs, index).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert (r["score"] >= 0.3) == (r["doc_id"] % 5 == 0)
    by = {r["doc_id"]: r for r in rows}
    assert by[402]["score"] >= 0.3 and by[None]["score"] >= 0.3 and by[402]["evidence"] and by[400]["score"] < 0.3
    nothing = toxicity.fit(docs, empty(labels))
    assert all(r["score"] == 0 for r in toxicity.score(docs, nothing).collect())


def test_toxicity_looks_at_all_words(spark):
    """Cosines are those of vectors of all words, with frequencies over all documents, whether or not an example holds the word."""
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice([f"r{j}" for j in range(500)], 12)) + (" vile" if i % 4 == 0 else "") for i in range(240)] + ["r1 new new words", "r2", "", "only new"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    words = [Counter(t.split()) for t in texts]
    df = Counter(w for c in words for w in c)
    weight = {w: math.log((1 + len(texts)) / n) + 1 for w, n in df.items()}
    code = {int(h): w for w, h in zip(df, toxicity.hash_words(toxicity.pa.array(list(df))).astype(np.int64), strict=True)}
    assert {code[h] for h in index.known.tolist()} == {w for c in words[:160] for w in c}
    assert all(x >= weight[code[h]] - 1e-9 for h, x in zip(index.known.tolist(), index.idf, strict=True))
    weight |= {code[h]: x for h, x in zip(index.known.tolist(), index.idf, strict=True)}
    vectors = [{w: (1 + math.log(n)) * weight[w] for w, n in c.items()} for c in words]
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    for r in toxicity.score(docs, index).collect():
        v = vectors[r["doc_id"]]
        want = [sum(x * u.get(w, 0) for w, x in v.items()) / (norms[r["doc_id"]] * n) for u, n in zip(vectors[:160], norms, strict=False)] if v else []
        assert np.allclose(r["cosines"], sorted([x for x in want if x > 0], reverse=True)[:15], atol=1e-6)
        assert np.allclose(r["cosines"], [want[i] for i in r["evidence"]], atol=1e-6)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(6)
    terms, n = 40, 700
    vectors = [(np.sort(rng.choice(terms, int(rng.integers(0, 9)), replace=False)), rng.integers(1, 4, 9)) for _ in range(n)]
    vectors = [(t, c[: len(t)]) for t, c in vectors]
    index = toxicity.Index(np.arange(terms), rng.random(terms) + 0.5, np.arange(n), rng.integers(0, 2, n), np.ones(n), vectors)
    dense = np.zeros((len(index.ids), terms))
    for t, (at, w) in enumerate(zip(index.where, index.what, strict=True)):
        dense[at, t] = w
    assert np.allclose((dense**2).sum(axis=1), 1)
    for t, c in vectors[:100]:
        if len(t):
            q = np.zeros(terms)
            q[t] = index.vector(t, c)
            want = np.sort(np.round(dense @ q, 12))[::-1][:15]
            assert np.allclose(index.nearest(t, c, 15)[1], want[want > 0])


def test_texts_are_searched_together_however_long_their_lists(monkeypatch):
    rng = np.random.default_rng(12)
    n, terms = 300, 60
    vectors = [(np.sort(rng.choice(terms, int(rng.integers(1, 9)), replace=False)), rng.integers(1, 4, 9)) for _ in range(n)]
    vectors = [(t, c[: len(t)]) for t, c in vectors]
    index = toxicity.Index(np.arange(terms), rng.random(terms) + 0.5, np.arange(n), rng.integers(0, 2, n), np.ones(n), vectors)
    vectors[5] = (index.column >= 0).nonzero()[0], np.ones((index.column >= 0).sum(), int)  # no word that is in a list
    alone = [index.nearest(t, c, 15) for t, c in vectors[:40] if len(t)]
    monkeypatch.setattr(toxicity, "ENTRIES", 7)
    own = [v for v in vectors[:40] if len(v[0])]
    groups = list(index.together(own))
    assert len(groups) == -(-len(own) // toxicity.QUERIES)  # each reads the matrix once
    for one, many in zip(alone, [x for g in groups for x in index.search(own[g], 15)], strict=True):
        assert one[0].tolist() == many[0].tolist() and np.array_equal(one[1], many[1])



def test_isotonic():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert np.all(np.diff(y) >= 0) and np.allclose(y, [0, 0.5, 1])


def test_ann(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((900, 16)).astype(np.float32) * rng.uniform(0.2, 3, (900, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, x[40].tolist()) for i in range(60)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, [float("inf")] * 16), (None, x[1].tolist()), (40, x[40].tolist()), (1005, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest_inner(df, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([*range(900), *range(900, 960)])
    full = np.vstack([x, np.repeat(x[40:41], 60, axis=0)]).astype(float)
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        s = (full * full[q]).sum(axis=1)
        order = [int(ids[i]) for i in np.lexsort((ids, -np.round(s, 9))) if ids[i] != q][:20]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        assert all(abs(sc - s[list(ids).index(v)]) < 1e-9 for _, v, sc in own)
        assert [v for _, v, _ in own] == [v for _, v, sc in sorted(own, key=lambda z: (-z[2], z[1]))]
        hits, total = hits + len(set(order) & {v for _, v, _ in own}), total + 20
    assert hits / total >= 0.9
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    assert ann.nearest_inner(df.where("false"), F.lit(True)).count() == 0


def recall_and_share(x, queries, k=20):
    """Mean share of the true k nearest (of `queries` first rows, others only) that the forest finds, and of rows that it scores."""
    forest = ann.Forest(x, np.arange(len(x)), float(np.sqrt((x * x).sum(axis=1)).max()))
    hits = []
    for i, (rows, _) in enumerate(forest.nearest(x[:queries], k + 1)):
        true = [j for j in np.argsort(-(x @ x[i]), kind="stable")[: k + 1] if j != i][:k]
        hits.append(np.isin(true, rows).mean())
    return np.mean(hits), forest.scored / queries / len(x)


def unit(x):
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def test_forest_recall_of_a_full_block():
    """Unit vectors without structure, as many as a block holds: the hardest case, in which much of the block is scored."""
    rng = np.random.default_rng(1)
    found, share = recall_and_share(unit(rng.standard_normal((ann.BLOCK, 64))), 120)
    assert found >= 0.95 and share < 0.6


def test_forest_scores_few_rows_where_neighbours_are_near():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1000, 64))[rng.integers(0, 1000, 50_000)] + 0.35 * rng.standard_normal((50_000, 64))
    found, share = recall_and_share(unit(x), 120)
    assert found >= 0.95 and share < 0.1
    found, share = recall_and_share(x * rng.uniform(0.9, 1.1, (50_000, 1)), 60)
    assert found >= 0.9


def test_forest_ranges_hold_prefixes():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((200, 8))
    forest = ann.Forest(x, np.arange(200), float(np.sqrt((x**2).sum(axis=1)).max()), trees=4, bits=8)
    assert (np.diff(forest.sorted, axis=1) >= 0).all()
    codes = np.take_along_axis(forest.sorted, np.zeros((4, 1), int), axis=1)
    for depth in range(9):
        low, high = forest.ranges(codes, np.array([depth]))
        for t in range(4):
            assert (low[t, 0], high[t, 0]) == (0, (forest.sorted[t] >> (8 - depth) == codes[t, 0] >> (8 - depth)).sum())
    rows, scores = forest.nearest(x[:1], 300)[0]  # more than there are: all, by score
    assert sorted(rows) == list(range(200)) and np.allclose(scores, np.sort(x @ x[0])[::-1])


def test_ann_of_many_blocks(spark, monkeypatch):
    """Blocks, groups of queries, vectors of two widths and columns with names used inside; few rows, so that the result is exact."""
    monkeypatch.setattr(ann, "BLOCK", 60)
    monkeypatch.setattr(ann, "QUERIES", 40)
    monkeypatch.setattr(ann, "MISS", 1e-9)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(4 + 2 * (i % 3 == 0)).tolist(), "x", 1.5, i) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, `class_id` string, score double, cell long")
    got = defaultdict(list)
    for r in ann.nearest_inner(df, F.col("vec_id") % 2 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for i, v, *_ in rows:
        others = [(-float((np.array(v) * w).sum()), j) for j, w, *_ in rows if j != i and len(w) == len(v)]
        assert got.get(i, []) == ([j for _, j in sorted(others)[:5]] if i % 2 == 0 else [])


def test_token_counts(docs):
    vocabulary = token_counts.zipf_vocabulary(PIECES)
    words = sorted({w for (t,) in docs.select("text").collect() for w in re.findall("[^\x20\x09-\x0d]+", t or "")} | {"é", "ab" * 80, "漢字", "internationalisation", "inter", "the"})
    assert token_counts.word_counts(words, vocabulary).tolist() == [token_counts.long_count(token_counts.MARK + w, vocabulary) for w in words]

    @functools.cache
    def best(word):  # all ways to cut
        s = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            ways = [(s[end - 1][0] + token_counts.BYTE_SCORE * n, -(s[end - 1][1] + n))]
            ways += [(s[a][0] + vocabulary.pieces[word[a:end]], -(s[a][1] + 1)) for a in range(end) if word[a:end] in vocabulary.pieces]
            top = max(round(x, 7) for x, _ in ways)
            score, k = max((w for w in ways if round(w[0], 7) == top), key=lambda w: w[1])
            s.append((score, -k))
        return s[-1][1]

    rows = token_counts.token_counts(docs, PIECES).collect()
    want = Counter()
    for d, t in docs.select("doc_id", "text").collect():
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        want[d, len(w), sum(best(token_counts.MARK + x) for x in w)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in rows) == want
    assert token_counts.token_counts(empty(docs), PIECES).count() == 0


def test_token_counts_are_the_same_when_remembered(monkeypatch):
    """Words met again, words after the memory was emptied, and words that are too long for it."""
    monkeypatch.setattr(token_counts, "MEMORY", 5)
    vocabulary = token_counts.zipf_vocabulary(PIECES)
    parts = [["the", "then", "theory", "é", "x" * 200], ["then", "x" * 200, "漢字"], ["the", "a", "b", ""], ["the", "漢字"], []]
    for words in parts:
        assert token_counts.remembered_counts(words, vocabulary).tolist() == token_counts.word_counts(words, vocabulary).tolist()
        assert all(len(w) <= token_counts.LONG for w in vocabulary.known)
    assert len(vocabulary.known) < 10


def test_sharding(spark, docs, tmp_path):
    root = f"file://{tmp_path}/set"
    assert sharding.compact(spark, docs.schema, root) is None and sharding.read(spark, docs.schema, root).count() == 0
    for i in range(9):
        assert sharding.append(docs.where(F.col("value") % 9 == i).coalesce(1), root) == i + 1
    before = sharding.manifest(spark, root).count()
    assert before == 9
    v = sharding.compact(spark, docs.schema, root, target_bytes=1 << 20, fan_in=4)
    assert v == 10 and sharding.manifest(spark, root).count() < before
    assert sharding.manifest(spark, root, 9).count() == 9  # older versions stay readable
    back = sharding.read(spark, docs.schema, root).drop("shard_path")
    assert back.exceptAll(docs).isEmpty() and docs.exceptAll(back).isEmpty()
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.commit(sharding.manifest(spark, root), root, v)
    while sharding.compact(spark, docs.schema, root, target_bytes=1 << 20, fan_in=2):
        pass
    sharding.expire(spark, root)
    assert len(sharding.versions(spark, root)) == 1 and sharding.manifest(spark, root).agg(F.sum("rows")).first()[0] == docs.count()
    assert sharding.read(spark, docs.schema, root).count() == docs.count()
    assert sharding.append(empty(docs), root) > v
    clash = docs.withColumns({"path": F.lit(1), "Arrival": F.lit(2), "file": F.create_map(F.lit("k"), "value")})
    other = f"file://{tmp_path}/clash"
    for i in range(3):
        sharding.append(clash, other, F.col("value") % 2)
    assert sharding.compact(spark, clash.schema, other, target_bytes=1 << 17, fan_in=2) == 4
    back = sharding.read(spark, clash.schema, other).drop("shard_path")
    assert back.columns == clash.columns and back.count() == 3 * clash.count()
    assert Counter(map(str, back.collect())) == Counter(str(r) for r in clash.collect() for _ in range(3))


def test_sharding_arrivals(spark, docs, tmp_path, monkeypatch, sf_dir):
    """Each arrival is a commit of its own, which sees what came before; the query makes twelve."""
    from tabloom.llm import queries

    root, seen = f"file://{tmp_path}/set", []
    part = F.pmod(F.xxhash64("value"), F.lit(5))
    look = lambda: seen.append({r[0] for r in sharding.manifest(spark, root).select("born").distinct().collect()})
    assert sharding.append_each(docs, root, part, range(5), look) == [1, 2, 3, 4, 5]
    assert seen == [set(range(1, i + 1)) for i in range(1, 6)]
    back = sharding.read(spark, docs.schema, root).drop("shard_path")
    assert back.exceptAll(docs).isEmpty() and docs.exceptAll(back).isEmpty()
    rounds = []
    own = sharding.compact
    monkeypatch.setattr(sharding, "compact", lambda *a, **k: rounds.append(sharding.versions(spark, a[2])[-1]) or own(*a, **k))
    assert queries.op5_sharding(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len(rounds) >= 12 and rounds[0] == 1 and rounds[11] >= 12


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= 3 * docs.count()
        docs = out
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_filters_take_any_table(spark, docs, sf_dir, tmp_path):
    """Names that the stages use themselves, nulls, repeated rows and empty tables."""
    import corpus_pipeline

    labels = docs.where("doc_id < 30").select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd = docs.withColumns({"toxic_score": F.lit(1), "Lang_Pred": F.lit("x"), "lang_score": F.lit(2), "lang_pred__kept": F.lit(3), "m": F.create_map(F.lit("k"), "value")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and out.count() <= 3 * odd.count()
        assert stage(spark, empty(odd), str(tmp_path)).count() == 0


def test_smallest_by_range(spark):
    from tabloom.llm._common import smallest

    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h")).where("g < 2 or h > 9e18")
    want = {r["g"]: sorted(r["x"])[:100][-1] for r in df.groupBy("g").agg(F.collect_set("h").alias("x")).collect()}
    assert {r["g"]: r["end"] for r in smallest(df, "g", "h", 100).collect()} == want


def test_packing_keeps_ids_beside_nulls(spark):
    """Ids beyond 2^53 stay what they are beside a null one in the same batch."""
    ids = [9007199254740993, None, 9007199254740995]
    docs = spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in packing.pack(packing.token_pieces(docs, BPE)).collect()} == set(ids)


def test_packing_forgets_beyond_what_it_is_told_to_remember(spark):
    texts = pa.array([f"word{i} other{i} third{i}" for i in range(40)])
    free, tight = packing.Encoder(BPE), packing.Encoder(BPE)
    tight.most = 6
    for i in range(0, 40, 2):
        assert [x.tolist() for x in free(texts[i : i + 2])] == [x.tolist() for x in tight(texts[i : i + 2])]
        assert len(tight.place) <= 6 + 6  # what it may hold and the cuts of one batch
    assert len(free.place) > 100
    import corpus_pipeline

    assert corpus_pipeline.REMEMBERED < packing.MEMORY
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts.to_pylist())], "doc_id long, text string")
    assert sorted(packing.token_pieces(docs, BPE, remembered=6).collect()) == sorted(packing.token_pieces(docs, BPE).collect())


def test_a_shard_is_gathered_within_a_few_times_its_tokens():
    import tracemalloc

    class Kept:
        def groupBy(self, *_):
            return self

        def applyInArrow(self, f, _):
            self.f = f
            return self

    kept, rng, n, blocks = Kept(), np.random.default_rng(3), 50_000, 16
    language_model.shard_states(kept, np.zeros(0, np.uint64))
    rows = []
    for b in range(blocks):
        h, u, doc = np.sort(language_model.mixed(rng.integers(0, 5000, n).astype(np.uint64))), language_model.mixed(rng.integers(0, 5000, n).astype(np.uint64)), rng.integers(0, 2 * language_model.HOME, n)
        w, (contexts, at) = language_model.runs(h), np.unique(u, return_inverse=True)
        rows.append((b, 3, None, language_model.packed(h[w[:-1]]), language_model.small(np.diff(w)), language_model.packed(contexts), language_model.small(at), language_model.small(doc)))
    schema = language_model.arrow_schema("home bigint, shard int, texts binary, words binary, sizes binary, contexts binary, at binary, docs binary")
    table = pa.Table.from_batches([language_model.batch_of(schema, *zip(*rows, strict=True))])
    tracemalloc.start()
    out = kept.f(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 1 and out["tokens"][0].as_py() > 0
    assert peak < 85 * n * blocks, peak / (n * blocks)
