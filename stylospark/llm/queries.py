"""The registered queries of this subpackage and their SQL for DuckDB.

Each query applies its operator, with production parameters, to whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bwt_dedup, exact_dedup, html_blocks, mixing, near_dedup, quality, rlz_dedup, spelling, token_files, topk, warc, whitening
from .common import column, shared_dir, small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).drop("x")


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.digest(bwt_dedup.suffix_dedup(_table(spark, sf_dir, "documents")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlz_dedup.rlz_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_table(spark, sf_dir, "documents")).drop("h")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/tokens-{token_files.fresh()}"
    token_files.write_tokens(_table(spark, sf_dir, "documents"), out, _tokenizer("word_bpe_49k.json"), end_id=1)
    return token_files.read_tokens(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokenizer("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", bpe.encode(column(docs, "text", "string"), path).alias("ids"))
    rows = rows.withColumn("text", bpe.decode(F.col("ids"), path))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op11_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{token_files.fresh()}"
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.history(warc.index(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_exact_dedup, op3_html_blocks, op4_mixing, op5_suffix_dedup, op6_token_files, op7_substring_dedup, op8_near_dedup, op9_bpe, op10_topk, op11_warc_index, op12_whitening, op13_spelling)}

ORACLES = {
    "op2_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(n) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
    """,
    "op7_substring_dedup": r"""
        WITH d AS (SELECT n AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM (SELECT row_number() OVER () AS n, * FROM documents)),
        g AS (SELECT r, i, hash(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
        again AS (SELECT r, list(i ORDER BY i) AS starts FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1 GROUP BY r),
        gone AS (SELECT r, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 35)))) AS p FROM again),
        kept AS (
          SELECT d.r, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS t, count(*) AS n
          FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d) d
          LEFT JOIN (SELECT r, unnest(p) AS gp FROM gone) x ON x.r = d.r AND x.gp = d.pos WHERE x.gp IS NULL GROUP BY d.r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)
    """,
    "op10_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, p.vec_id, CAST(list_sum(list_transform(list_zip(q.e, p.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v p ON q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS b FROM pages)
        SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
        FROM (SELECT *, b >= 1000 AND last IS NOT NULL AND (page_id IS NULL OR page_id < last) AS again FROM (SELECT *, max(page_id) OVER (PARTITION BY t) AS last FROM p))
    """,
    "op13_spelling": r"""
        WITH RECURSIVE crc AS (
          SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
        run AS (
          SELECT w, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x, count(*) AS n FROM (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents) WHERE length(w) >= 5 GROUP BY w, x),
        h AS (
          SELECT w, n, xor(4294967295, list_reduce(list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
            lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]), 4294967295)) AS h FROM run, crc),
        word AS (
          SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM h) WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
        less AS (SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS v FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM word)),
        near AS (
          SELECT a.w, b.w AS o, b.n FROM less a JOIN less b ON a.i = b.i AND a.v = b.v AND a.w <> b.w
          UNION SELECT a.w, b.w, b.n FROM less a JOIN word b ON a.v = b.w UNION SELECT b.w, a.w, a.n FROM less a JOIN word b ON a.v = b.w),
        best AS (SELECT w, count(*) AS c, first(o ORDER BY n DESC, o) AS o, max(n) AS m FROM near GROUP BY w),
        form AS (SELECT word.w, word.n, coalesce(c, 0) AS c, CASE WHEN m >= 2 * word.n THEN o END AS f, CASE WHEN m >= 2 * word.n THEN m END AS m FROM word LEFT JOIN best USING (w)),
        walk AS (SELECT w, w AS r FROM form UNION ALL SELECT walk.w, f FROM walk JOIN form ON form.w = walk.r WHERE f IS NOT NULL)
        SELECT form.w AS word, form.f AS form, walk.r AS root, form.n AS n, CAST(form.c AS BIGINT) AS n_near, form.m AS form_n
        FROM form JOIN walk ON walk.w = form.w JOIN form z ON z.w = walk.r AND z.f IS NULL
    """,
}
