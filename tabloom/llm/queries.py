"""The operators of this subpackage as queries over the tables of a folder, with their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, embedding_neardup, langid, language_model, media, merkle, mixing, neardup, packing, sharding, token_counts, toxicity, vector_codes
from ._common import fold_of, shared_dir

BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TOXIC_FROM = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_fold(folds: int, fold: int):
    return F.coalesce(fold_of(F.col("doc_id"), folds) == fold, F.lit(False))


def not_fold(folds: int, fold: int):
    return F.coalesce(fold_of(F.col("doc_id"), folds) != fold, F.lit(False))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_inner(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_model.fit(table(spark, sf_dir, "documents"), not_fold(5, 1))
    out = language_model.score(model)
    return out.select("doc_id", is_fold(5, 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.totals.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_digest(media.with_audio(table(spark, sf_dir, "documents")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve arrivals of documents, each a commit with a round of compaction after it, and at the end
    compacted until no tier has a full group: each document as read back, with the rows, bytes and
    version of its shard."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"

    def compacted() -> bool:
        done = sharding.compact(spark, docs.schema, root, target_bytes=64 << 20, fan_in=8) is not None
        sharding.expire(spark, root)
        return done

    sharding.append_each(docs, root, F.pmod(F.xxhash64("doc_id"), F.lit(12)), range(12), compacted)
    while compacted():
        pass
    files = sharding.manifest(spark, root).select(F.col("path").alias("shard_path"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), F.col("born").alias("shard_version"))
    rows = sharding.read(spark, docs.schema, root)
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text.cast("binary")).alias("text_md5"), "shard_path").join(files, "shard_path")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PIECES)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, not_fold(4, 2))
    return langid.identify(docs, model).select("doc_id", is_fold(4, 2).alias("held_out"), "lang_pred", "score")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, similarity=0.8)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), not_fold(4, 2))
    out = toxicity.score(docs, index)
    return out.select("doc_id", is_fold(4, 2).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "evidence", "cosines")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), BPE, capacity=2048), capacity=2048)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(rows).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.fingerprint(books)).alias("codebooks_sha256"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neardup.near_vectors(table(spark, sf_dir, "embeddings"), similarity=0.98)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann, op2_mixing, op3_language_model, op4_audio, op5_sharding, op6_token_counts, op7_language_id, op8_near_duplicates, op9_toxicity, op10_packing, op11_vector_codes, op12_near_vectors, op13_merkle)}


OP2 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents),
w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
l AS (
  SELECT *, cap / weight AS ratio,
         (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1)) AS target FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
g AS (
  SELECT *, sum(size * copies) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM (SELECT source, k, size, count(*) AS copies FROM d GROUP BY source, k, size))
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST(b.epochs * d.size + CASE WHEN g.upto <= b.budget - b.epochs * b.source_size THEN d.size
            WHEN g.upto - g.size * g.copies < b.budget - b.epochs * b.source_size THEN (b.budget - b.epochs * b.source_size - (g.upto - g.size * g.copies)) // g.copies
            ELSE 0 END AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.k = g.k AND d.size = g.size
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 2 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE words END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id, w.doc_id = c.low AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS low FROM r GROUP BY x) c ON c.x = w.doc_id
"""


#: One round of plain Lloyd from the codebooks c{i}: the nearest entries a{i} and the next codebooks.
LLOYD = """
a{i} AS MATERIALIZED (
  SELECT vec_id, label, p, any_value(v) AS v, arg_min(e, d * 16 + e) AS e, CAST(min(d) AS BIGINT) AS d
  FROM (SELECT x.*, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN c{i} c ON x.p = c.p)
  GROUP BY vec_id, label, p),
c{j} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v
    FROM (SELECT p, e, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM a{i}) GROUP BY p, e, i) GROUP BY p, e) m
  ON m.p = c.p AND m.e = c.e)"""

OP11 = (
    """
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS v FROM k, range(8) t(p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 16),
c0 AS MATERIALIZED (SELECT p, e, v FROM x JOIN f USING (vec_id)),"""
    + ",".join(LLOYD.format(i=i, j=i + 1) for i in range(7))
    + """,
r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS y, unnest(range(len(v))) AS i FROM c6))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h
"""
)

OP12 = """
WITH RECURSIVE w AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (
  SELECT *, sqrt(list_dot_product(v, v)) AS n FROM w
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.vec_id, coalesce(l.n, 0) AS n_links, c.low AS component_id, w.vec_id = c.low AS kept
FROM w LEFT JOIN (SELECT x, count(*) AS n FROM e GROUP BY x) l ON l.x = w.vec_id JOIN (SELECT x, min(y) AS low FROM r GROUP BY x) c ON c.x = w.vec_id
"""

OP13 = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-')) AS head, text,
    list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda i: -1))))),
      lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END) AS register
  FROM documents),
l AS MATERIALIZED (
  SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(register, 4294967295) % 3 = 0 THEN sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS altered,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i
  FROM d),
t AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY i) AS nodes FROM l GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range((len(nodes) + 7) // 8), lambda j: sha256(array_to_string(nodes[8 * j + 1 : 8 * j + 8], ''))) FROM t WHERE len(nodes) > 1),
s AS MATERIALIZED (SELECT lang, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM t WHERE len(nodes) = 1),
g AS (
  SELECT 0 AS level, list(subroot ORDER BY i) AS nodes FROM s
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 7) // 8), lambda j: sha256(array_to_string(nodes[8 * j + 1 : 8 * j + 8], ''))) FROM g WHERE len(nodes) > 1),
steps AS MATERIALIZED (
  SELECT l.doc_id, t.level, l.i // CAST(pow(8, t.level) AS BIGINT) AS place, t.nodes FROM l JOIN t ON l.lang IS NOT DISTINCT FROM t.lang WHERE len(t.nodes) > 1
  UNION ALL
  SELECT l.doc_id, s.height + g.level, s.i // CAST(pow(8, g.level) AS BIGINT), g.nodes FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang, g WHERE len(g.nodes) > 1),
sides AS MATERIALIZED (
  SELECT doc_id, level, array_to_string(nodes[place // 8 * 8 + 1 : place], '') AS before, array_to_string(nodes[place + 2 : place // 8 * 8 + 8], '') AS behind FROM steps),
fold AS (
  SELECT doc_id, 0 AS level, coalesce(altered, leaf) AS node FROM l
  UNION ALL
  SELECT fold.doc_id, fold.level + 1, sha256(before || node || behind) FROM fold JOIN sides ON sides.doc_id = fold.doc_id AND sides.level = fold.level),
folded AS (SELECT doc_id, arg_max(node, level) AS folded_root FROM fold GROUP BY doc_id),
proof AS (SELECT doc_id, sha256(string_agg(before || behind, '' ORDER BY level)) AS proof_sha256 FROM sides GROUP BY doc_id),
root AS (SELECT nodes[1] AS root FROM g WHERE len(nodes) = 1)
SELECT l.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN folded ON folded.doc_id = l.doc_id LEFT JOIN proof ON proof.doc_id = l.doc_id, root
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2, "op8_near_duplicates": OP8, "op11_vector_codes": OP11, "op12_near_vectors": OP12, "op13_merkle": OP13}
