"""The registered queries of this subpackage, each over its whole table.

For all of them: null texts are empty; extra columns, whatever their names, are ignored;
empty tables give no rows; results do not depend on the order or partitioning of rows.
Rows with a null doc_id give a row like any other (op5: linked with nothing, its own
component is null; op6: not held out; op7: matches nothing), those with a null vec_id
take no part. Rows that repeat a doc_id each give a row; for op5 and op7, which compare
documents, they are one document. Ties: op2 by id, then text; op5 to the smallest id;
op7 to the smaller id, then the earlier start; op8 and op11 to the smaller id; op9 to the longer
last piece; op10 counts a token where it starts; op12 merges from the left; op13 ranks by
score, count and phrase, and takes the first of equal cuts. op13 has a row a phrase: null
languages are "und".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm.common import materialize, table, text_size
from hitloom.llm import bpe, collocations, media, mixing, near_dedup, negatives, pieces, repeats, secrets, sharding, token_counts, topk, toxicity


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, secrets.fit(docs))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards on a ring with 64 virtual nodes each, loads bounded by rows."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (text_size(F.col("text")) + 16).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")
    )
    return sharding.shard(docs, "doc_id", 40, ties=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, mixed by source to weights 3, 1, 2 and 150 % of all words."""
    sized = materialize(
        table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "mix-sizes"
    )
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a motion-JPEG file, read back: digests and timed clips."""
    return media.digest(media.encode(table(spark, sf_dir, "documents")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 4-word runs are similar by 0.8 or more."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a 100-byte string which also starts earlier."""
    return repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 100)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op10_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Tokens of every line of every document, each counted where it starts."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path or token_counts.public_path(token_counts.VOCABULARY))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    encoded = pieces.encode(table(spark, sf_dir, "documents"), path or token_counts.public_path(pieces.MODEL))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "exact")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fiftieth vector and each of its five positives, the three best rows of other labels with 50 to 95 % of the positive's score."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.quantised(table(spark, sf_dir, "embeddings"), 256, label=label)
    mined = negatives.mine(rows, F.col("id") % 50 == 0)
    return mined.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score"
    )


def op12_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of every document's ids in a BPE vocabulary and of the text that they decode to."""
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path or token_counts.public_path(bpe.VOCABULARY), decoded="decoded")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best-scoring phrases of two and three words of every language."""
    found = collocations.collocations(table(spark, sf_dir, "documents"))
    return found.withColumn("rank", F.col("rank").cast("long"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dedup": NEAR_DUPLICATES, "op8_topk": TOP_K, "op11_hard_negatives": HARD_NEGATIVES, "op13_collocations": COLLOCATIONS}


NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS sh FROM w) q),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)), both_ AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT y, c FROM r JOIN both_ ON x = doc_id), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

TOP_K = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS query_id, b.id AS vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND b.id <> a.id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""


HARD_NEGATIVES = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label, b.id, b.label AS other, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 50 = 0 AND b.id <> a.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = other QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND label <> other AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text <> ''),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]'), lambda x: x <> '') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
f1 AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM w) GROUP BY ALL),
f2 AS (SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w) GROUP BY ALL HAVING count(*) >= 10),
c3 AS (SELECT lang, g, f, split_part(g, ' ', 1) AS a1, split_part(g, ' ', 2) || ' ' || split_part(g, ' ', 3) AS a23, split_part(g, ' ', 1) || ' ' || split_part(g, ' ', 2) AS a12, split_part(g, ' ', 3) AS a3 FROM f3),
s2 AS (SELECT f2.lang, f2.g AS phrase, f2.f AS a, x.f AS l, y.f AS r, (1000000::HUGEINT * f2.f * f2.f) // (x.f::HUGEINT * y.f) AS score FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w = split_part(f2.g, ' ', 1) JOIN f1 y ON y.lang = f2.lang AND y.w = split_part(f2.g, ' ', 2)
  WHERE NOT EXISTS (SELECT 1 FROM c3 WHERE c3.lang = f2.lang AND c3.a12 = f2.g AND 100 * c3.f >= 50 * f2.f) AND NOT EXISTS (SELECT 1 FROM c3 WHERE c3.lang = f2.lang AND c3.a23 = f2.g AND 100 * c3.f >= 50 * f2.f)),
t3 AS (SELECT c3.lang, c3.g AS phrase, c3.f AS a, x1.f AS l1, x23.f AS r1, x12.f AS l2, x3.f AS r2, (1000000::HUGEINT * c3.f * c3.f) // (x1.f::HUGEINT * x23.f) AS k1, (1000000::HUGEINT * c3.f * c3.f) // (x12.f::HUGEINT * x3.f) AS k2
  FROM c3 JOIN f1 x1 ON x1.lang = c3.lang AND x1.w = a1 JOIN f2 x23 ON x23.lang = c3.lang AND x23.g = a23 JOIN f2 x12 ON x12.lang = c3.lang AND x12.g = a12 JOIN f1 x3 ON x3.lang = c3.lang AND x3.w = a3),
u AS (SELECT lang, phrase, a, l, r, score FROM s2 UNION ALL SELECT lang, phrase, a, CASE WHEN k2 < k1 THEN l2 ELSE l1 END, CASE WHEN k2 < k1 THEN r2 ELSE r1 END, least(k1, k2) FROM t3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM u JOIN n USING (lang)
QUALIFY rank <= 2000"""
