"""Vector codes, near vectors and the Merkle manifest against brute force, with every awkward row."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import embedding_neardup, merkle, vector_codes


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, exact copies, scaled copies, nulls, zeros, odd widths, repeated and missing ids, and columns with names used inside."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist(), i % 3) for i in range(200)]
    centre = rng.standard_normal(16)
    rows += [(i, (centre + 0.16 * rng.standard_normal(16)).tolist(), 1) for i in range(200, 320)]
    rows += [(i, rows[7][1], 1) for i in range(320, 330)] + [(330, (np.array(rows[7][1]) * 2.5).tolist(), 1), (331, rows[7][1], 2), (332, rows[7][1], None)]
    rows += [(333, None, 1), (334, [0.0] * 16, 1), (335, [float("nan")] * 16, 1), (336, [None, *[1.0] * 15], 1), (337, [float("inf"), *[1.0] * 15], 1), (338, [1.0, 2.0, 3.0], 1), (339, [2.0, 4.0, 6.0], 1), (340, [], 1), (341, [5.0], None), (342, [5.0], 9)]
    rows += [(343, rows[9][1], 0), (343, rows[9][1], 0), (None, rows[9][1], 0), (None, rng.standard_normal(16).tolist(), 4), (5, rows[11][1], 2)]
    return spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int, code string, class_id int").repartition(3)


def able(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(rows):
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, u, a), (_, v, b) = rows[i], rows[j]
            if a is not None and a == b and able(u) and able(v) and len(u) == len(v) and np.dot(u, v) / np.sqrt(np.dot(u, u)) / np.sqrt(np.dot(v, v)) >= 0.98:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i in range(n):
        low[find(i)].append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in low.items()}
    return Counter((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(n))


@pytest.mark.parametrize(("strip", "fill"), [(8192, 64), (16, 4)])
def test_near_vectors(vectors, monkeypatch, strip, fill):
    monkeypatch.setattr(embedding_neardup, "STRIP", strip)
    monkeypatch.setattr(embedding_neardup, "FILL", fill)
    monkeypatch.setattr(embedding_neardup, "TOGETHER", 7)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]
    got = Counter(map(tuple, embedding_neardup.near_vectors(vectors).collect()))
    assert got == brute_links(rows)
    assert max(n for _, n, _, _ in got) > 30
    floats = vectors.withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert embedding_neardup.near_vectors(floats).count() == len(rows)
    assert embedding_neardup.near_vectors(vectors.limit(0)).count() == 0


def test_bounds_lose_nothing():
    """No vector is nearer than the bound of its code says."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 8))
    book = embedding_neardup.fitted(x, 20)
    code, bound = embedding_neardup.bounds(x, book)
    true = ((x[:, None] - x) ** 2).sum(axis=2)
    assert all(bound[i, code[j]] <= true[i, j] + 1e-12 for i in range(400) for j in range(400))
    assert (bound > 0).mean() > 0.8


def test_rounding_at_the_threshold():
    """A cosine of exactly the threshold links."""
    u, v = np.array([[3.0, 4.0]]), np.array([[3.0, 4.0], [4.0, 3.0]])
    strip = embedding_neardup.Strip(np.array([0, 1]), np.array([1, 1]), v, np.array([0, 0]), None, 0.96)
    links, a, b = strip.meet(np.array([5]), np.array([1]), u)
    assert links.tolist() == [2] and a == [5, 5] and b == [0, 1]


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) and abs(x) < 4096 for x in r[1])]
    width = parts * max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[int(np.floor(4096 * c)) for c in v] + [0] * (width - len(v)) for _, v, _ in kept]).reshape(len(kept), parts, -1)
    books = [[x[i, p].tolist() for i in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v.tolist(), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            own = [nearest(p, v)[1] for v in x[:, p]]
            for k in range(len(books[p])):
                mine = [x[i, p].tolist() for i, o in enumerate(own) if o == k]
                if mine:
                    new[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        books = new
    out = []
    for (vec_id, _, label), v in zip(kept, x, strict=True):
        found = [nearest(p, v[p]) for p in range(parts)]
        out.append((vec_id, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    total = Counter()
    for _, label, _, error in out:
        total[label] += error
    text = ",".join(str(c) for b in books for e in b for c in e)
    return Counter((i, code, error, total[label]) for i, label, code, error in out), hashlib.sha256(text.encode()).hexdigest()


def test_vector_codes(vectors, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 50)
    table = vectors.unionByName(vectors.sparkSession.createDataFrame([(-1, [4096.0] * 16, 1, "x", 0), (-2, [-4095.9] * 16, 1, "x", 0)], vectors.schema))
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    want, print_ = brute_codes(rows)
    out, books = vector_codes.compress(table)
    for labels in (100_000, 2):  # sums of labels broadcast, and joined by a shuffle
        monkeypatch.setattr(vector_codes, "LABELS", labels)
        got = vector_codes.with_label_error(out).select("vec_id", "code", "error", "label_error").collect()
        assert Counter(map(tuple, got)) == want
    assert vector_codes.fingerprint(books) == print_
    few = table.where("vec_id < 5 AND vec_id >= 0")
    out, books = vector_codes.compress(few)
    want, print_ = brute_codes([(r["vec_id"], r["embedding"], r["label"]) for r in few.collect()])
    assert Counter(map(tuple, vector_codes.with_label_error(out).select("vec_id", "code", "error", "label_error").collect())) == want
    assert vector_codes.fingerprint(books) == print_
    assert vector_codes.with_label_error(vector_codes.compress(vectors.where("embedding IS NULL"))[0]).count() == 0


@pytest.mark.parametrize("span", [2, 60, 1 << 24])
def test_filtering_is_lloyd(span):
    """Subtrees go to the entries that their points would go to one by one, ties to the lower index."""
    rng = np.random.default_rng(span)
    for n, width in ((1, 1), (9, 3), (700, 4), (4096, 8)):
        x = rng.integers(-span, span + 1, (n, width))
        entries = x[: min(16, n)].copy()
        entries[-1] = entries[0]
        tree = vector_codes.Tree.over(x)
        owner, counts, sums = tree.owners(entries)
        want = ((x[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (owner == want[tree.order]).all() and (counts == np.bincount(want, minlength=len(entries))).all()
        plain = np.zeros_like(entries)
        np.add.at(plain, want, x)
        assert (sums == plain).all()


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def way(tree, i):
    for nodes in tree[:-1]:
        yield nodes[i // 8 * 8 : i], nodes[i + 1 : i // 8 * 8 + 8]
        i //= 8


def brute_manifest(rows):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for r in rows:
        leaf = lambda t, r=r: h("".join(map(said, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t))))
        low = None if r["text"] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
        touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r["text"]), leaf(low if touched else r["text"]), r["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([r[2] for r in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(sorted(groups[g])):
            path, node = [*way(trees[g], i), *way(top, k)], r[3]
            for before, after in path:
                node = h("".join(before) + node + "".join(after))
            out.append((r[4], r[2], trees[g][-1][0], top[-1][0], h("".join("".join(b) + "".join(a) for b, a in path)), node, node == top[-1][0]))
    return Counter(out)


@pytest.fixture(scope="module")
def papers(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abcXYZ É\n", k=30)), "en", f"s{i % 3}", i) for i in range(700)]
    rows += [(i, "plain", f"l{i % 90}", None, None) for i in range(700, 1000)]
    rows += [(None, "A", "en", "s", 1), (None, "A", "en", "s", 1), (None, "B", None, "s", 1), (3, "again", "en", "s", 1), (1000, None, None, "s", 2), (1001, "", "", "", 0), (1002, "Long " * 50_000, "en", "s", 1), (-7, "Ä1", "-", "s", 3)] + [(2000, "Same", "en", "s", 1)] * 40
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, leaf string").repartition(5)


@pytest.mark.parametrize(("parts", "together"), [(1, 32), (4, 32), (97, 3), (401, 2)])
def test_manifest(spark, papers, monkeypatch, parts, together):
    monkeypatch.setattr(merkle, "TOGETHER", together)
    monkeypatch.setattr(merkle, "ROWS", -(-papers.count() // parts))
    monkeypatch.setattr(merkle, "FEW", 1 << 40)
    if parts > 97:
        papers = papers.where("lang = 'en'").repartition(2)  # parts of three leaves, one group, more than a level above the last merge
        monkeypatch.setattr(merkle, "ROWS", 3)
    rows = [r.asDict() for r in papers.collect()]
    assert Counter(map(tuple, merkle.manifest(papers).collect())) == brute_manifest(rows)


def test_small_manifests(papers):
    assert merkle.manifest(papers.limit(0)).count() == 0
    for n in (1, 2):
        some = papers.where(f"doc_id < {n} AND doc_id >= 0")
        assert Counter(map(tuple, merkle.manifest(some).collect())) == brute_manifest([r.asDict() for r in some.collect()])


def test_forests_are_a_monoid():
    """Any order and bracketing of the sums of pieces gives the same tops, and holds no complete run."""
    rng = random.Random(1)
    for n in (1, 7, 8, 9, 64, 65, 500):
        leaves = [h(str(i)) for i in range(n)]
        top = levels(leaves)[-1][0]
        pieces, at = [], 0
        while at < n:
            size = rng.randint(1, 23)
            patch = merkle.Patch(leaves[at : at + size], at, n)
            pieces.append(merkle.Forest({("g", level, i): v for level, i, v in patch.open_nodes()}, {"g": n}))
            at += size
        for _ in range(4):
            left = list(pieces) + [merkle.Forest()]
            rng.shuffle(left)
            while len(left) > 1:
                a, b = left.pop(rng.randrange(len(left))), left.pop(rng.randrange(len(left)))
                left.append(a + b)
            assert left[0].nodes == {("g", len(merkle.widths(n)) - 1, 0): top}
