"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import bpe, centroids, euler_trie, html_main, licenses, mih, nbsvm, ngram_join, packing, rp_forest, secrets_battery, suffix_lm, toxicity
from wardlake.llm.common import fold, ship, table


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return rp_forest.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
          WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.a AS vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.b)::BIGINT AS component_id, r.a = min(r.b) AS kept
FROM reach r LEFT JOIN n ON n.a = r.a GROUP BY r.a
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(docs, clusters=ngram_join.clusters(docs, 80, 5))
    return packed.withColumnRenamed("id", "doc_id")


def op3_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return mih.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)] END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (sh) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return licenses.scan(table(spark, sf_dir, "documents")).selectExpr(
        "id doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        "array_join(expressions, '; ') expressions", "cast(size(spans) as bigint) n_spans", "in_force", "restrictiveness")


def op6_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    pages = table(spark, sf_dir, "pages")
    return html_main.extract(pages, html_main.fit(pages)).select(
        F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("bigint").alias("n_chars"), "n_blocks")


def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffix_lm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    return nbsvm.score(docs, model).select(
        F.col("id").alias("doc_id"), (fold("id") == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"), (fold("id") == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("segments").alias("n_segments"), "expect")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vocabulary = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokenizer = bpe.Bpe(vocabulary, public_tokenizers.PATTERN)
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return decoded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))

def op11_euler_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return euler_trie.conversation_trie(table(spark, sf_dir, "conversations"))


# DuckDB has no crc32: its bits, eight steps a byte
_CRC_STEP = "xor({0} >> 1, CASE WHEN {0} & 1 = 1 THEN 3988292384 ELSE 0 END)"
OP11_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
bytes(conv_id, s, i, k, x) AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR, 0, 0, 4294967295::UBIGINT FROM t
  UNION ALL
  SELECT conv_id, s, i + (k = 8)::INT, CASE WHEN k = 8 THEN 0 ELSE k + 1 END,
         CASE WHEN k = 0 THEN xor(x, ascii(s[i + 1])::UBIGINT) ELSE """ + _CRC_STEP.format("x") + """ END
  FROM (SELECT conv_id, s, i, CASE WHEN k = 9 THEN 0 ELSE k END AS k, x FROM bytes) WHERE i < length(s)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS src, (xor(x, 4294967295::UBIGINT) % 6)::BIGINT AS h FROM bytes WHERE i = length(s)),
turns AS (
  SELECT c.conv_id, 0 AS part, r, role, text FROM c JOIN t ON t.conv_id = src AND r <= h
  UNION ALL SELECT conv_id, 1, r, role, text FROM t JOIN c USING (conv_id) WHERE r > h),
whole AS (
  SELECT c.conv_id, coalesce(w, []) AS w FROM c
  LEFT JOIN (SELECT conv_id, list(struct_pack(role, text) ORDER BY part, r) AS w FROM turns GROUP BY conv_id) USING (conv_id)),
starts AS (SELECT conv_id, w, unnest(range(len(w) + 1)) AS d FROM whole),
node AS (SELECT w[1:d] AS p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(w) = d) AS ends FROM starts GROUP BY ALL),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
leaf AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN kids USING (p)),
up AS (SELECT unnest(range(depth + 1)) AS d, p, n_children, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(p[depth].text) END AS saved FROM leaf),
sums AS (SELECT p[1:d] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM leaf n JOIN sums USING (p) LEFT JOIN node q ON n.depth > 0 AND q.p = n.p[1:n.depth - 1]
"""


def op12_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_battery.scan(table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda t: F.concat_ws(":", t["kind"], t["s"].cast("string"), t["e"].cast("string"))), ",")

    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(F.expr(f"filter(base, t -> t.kind = '{k}')")).cast("bigint").alias(f"n_{k}") for k in secrets_battery.KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op13_centroid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return centroids.cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _op13_sql(rounds: int = 3) -> str:
    """The rounds unrolled: distances to centroids, nearest, floor of the members' means."""
    sql = """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
x AS (SELECT r, unnest(range(64)) AS d, unnest(q) AS x FROM kept),
start AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c FROM kept WHERE vec_id IS NOT NULL
          ORDER BY c LIMIT 16),
c0 AS (SELECT c, d, x FROM start JOIN x USING (r))"""
    near = """,
a{i} AS (SELECT r, min(s) AS s, arg_min(c, (s, c)) AS c FROM (
  SELECT r, c, sum((x.x - k.x) * (x.x - k.x)) AS s FROM x JOIN c{i} k USING (d) GROUP BY r, c) GROUP BY r)"""
    move = """,
m{i} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY c, d),
c{j} AS (SELECT k.c, k.d, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, k.x) AS x FROM c{i} k LEFT JOIN m{i} m USING (c, d))"""
    for i in range(rounds):
        sql += near.format(i=i) + move.format(i=i, j=i + 1)
    return sql + near.format(i=rounds) + f""",
h AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, s::BIGINT AS distance, (sum(s) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(s) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN h USING (c)
"""



QUERIES = {
    "op1_rp_forest": op1_rp_forest,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_multi_index_hashing": op3_multi_index_hashing,
    "op4_ngram_join": op4_ngram_join,
    "op5_license_scan": op5_license_scan,
    "op6_html_main": op6_html_main,
    "op7_suffix_tree_lm": op7_suffix_tree_lm,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_euler_trie": op11_euler_trie,
    "op12_secret_battery": op12_secret_battery,
    "op13_centroid_tables": op13_centroid_tables,
}

ORACLE: dict[str, str] = {"op1_rp_forest": OP1_SQL, "op4_ngram_join": OP4_SQL, "op11_euler_trie": OP11_SQL,
                          "op13_centroid_tables": _op13_sql()}
