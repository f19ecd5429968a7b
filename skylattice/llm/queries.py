"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, html_extract, importance, infilling, language, lm_scoring, mixing, ngram_join, packing, quality, secret_scan, warc
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratio = secret_scan.train(secret_scan.labelled_samples(docs))
    return secret_scan.digest(secret_scan.scan(docs, ratio))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.main_text(pages, html_extract.train(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False).drop("ids")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~quality.held_out())
    rows = quality.score(docs, quality.train(docs, labels))
    return rows.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = lm_scoring.score(docs, held_out=lm_scoring.held_out())
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = language.predict(docs, language.train(docs.where(~language.held_out())))
    return rows.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digest(infilling.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    rows = warc.read(spark, folder, payloads=False)
    return rows.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_html_extraction, op3_ngram_join, op4_packing, op5_mixing, op6_quality, op7_nearest_neighbours, op8_exact_dedup, op9_lm_scoring, op10_language_id, op11_infilling, op12_importance, op13_warc)}

ORACLE_SQL = {
    "op3_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d
        ), e AS (
            SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
        ), l AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), r AS (
            SELECT doc_id, doc_id AS seen FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen
        )
        SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.seen) AS component_id FROM s JOIN r USING (doc_id) GROUP BY ALL
    """,
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS nth
            FROM d
        )
        SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM g
    """,
    "op11_infilling": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
                   sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
        ), u AS (
            SELECT doc_id, x, w, len(w) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t
        ), c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
        ), p AS (
            SELECT doc_id, n, form, x, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c
        )
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(x) AS restored_sha256
        FROM p
    """,
    "op12_importance": r"""
        WITH RECURSIVE bits(i, k, c) AS (
            SELECT i, 0, i FROM range(256) t(i)
            UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
        ), crc AS (
            SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
        ), d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark
        ), e AS (
            SELECT doc_id, unnest(w) AS x FROM d
        ), words AS (
            SELECT DISTINCT x FROM (SELECT x FROM e UNION ALL SELECT x FROM b)
        ), hashed AS (
            SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(x))), lambda i: ('0x' || hex(encode(x))[2 * i + 1:2 * i + 2])::BIGINT)),
                lambda a, v: xor(a >> 8, crc.t[(xor(a, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM words, crc
        ), s AS (
            SELECT bucket, count(*) AS s FROM e JOIN hashed USING (x) GROUP BY bucket
        ), t AS (
            SELECT bucket, count(*) AS t FROM b JOIN hashed USING (x) GROUP BY bucket
        ), g AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)
        ), w AS (
            SELECT doc_id, sum(gain)::BIGINT AS total FROM e JOIN hashed USING (x) JOIN g USING (bucket) GROUP BY doc_id
        ), v AS (
            SELECT doc_id, len(w) AS n_features, CASE WHEN len(w) > 0 THEN (total - ((total % len(w)) + len(w)) % len(w)) // len(w) ELSE 0 END::BIGINT AS weight,
                   ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN w USING (doc_id)
        ), z AS (
            SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM v
        ), r AS (
            SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS nth FROM z
        )
        SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN nth <= 10 * (SELECT count(*) FROM z WHERE n_features >= 20) // 100 THEN nth END AS rank FROM r
    """,
    "op13_warc": r"""
        WITH p AS (
            SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), g AS (
            SELECT *, n >= 100 AND page_id <> min(page_id) OVER (PARTITION BY d) AS again, min(page_id) OVER (PARTITION BY d) AS first FROM p
        )
        SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to, url FROM g
    """,
}
