"""Queries and SQL of the operators here. Each query takes (spark, sf_dir) and reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import embedding_dedup, exact_dedup, importance, language_id, license_scan, mixing, quality, sentencepiece_trie, simhash, spelling, substring_dedup, toxicity, warc_zip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mixture of as many tokens, at 98 % of the largest entropy, reads each document."""
    return mixing.mixture(_table(spark, sf_dir, "documents"), target="entropy", value=0.98)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share, with the integer ids of both documents."""
    return substring_dedup.shared_passages(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"), 5, 0)
    model = language_id.fit_language_model(docs.filter(~out))
    return language_id.identify_languages(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = language_id.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.fit_toxicity(docs, labels.filter(~out))
    return toxicity.score_toxicity(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.through_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of each text's pieces, and whether they decode to the text."""
    return sentencepiece_trie.piece_digests(_table(spark, sf_dir, "documents"), sentencepiece_trie.load_model())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of each document, as numbers and labels."""
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the words of the benchmark; all documents have a row."""
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_embedding_dedup, op3_substring_dedup, op4_exact_dedup, op5_language_id,
        op6_toxicity, op7_warc_zip, op8_simhash, op9_sentencepiece, op10_quality, op11_license_scan, op12_importance, op13_spelling,
    )
}

# the checksums of words in SQL: the table of 256 entries by its rule, then one step for each byte
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs)"""
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(hex(encode({0}))) // 2 + 1),
            lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)])))"""

ORACLE_SQL: dict[str, str] = {
    "op12_importance": rf"""
        WITH {_CRC_TABLE},
        rows_ AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        target AS (SELECT unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        here AS (SELECT doc_id, unnest(ws) AS w FROM rows_),
        words AS (SELECT w, {_CRC.format("w")} % 10000 AS bucket FROM (SELECT w FROM here UNION SELECT w FROM target) x, crc_table),
        s AS (SELECT bucket, count(*) AS n FROM here JOIN words USING (w) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS n FROM target JOIN words USING (w) GROUP BY bucket),
        gains AS (SELECT b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
                         / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
                  FROM (SELECT unnest(range(10000)) AS b) x LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
        weights AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM here JOIN words USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
        scored AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                          coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
                   FROM rows_ LEFT JOIN weights USING (doc_id)),
        places AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
        SELECT doc_id, n_features, weight, score,
               CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
        FROM places""",
    "op13_spelling": rf"""
        WITH RECURSIVE {_CRC_TABLE},
        runs AS (SELECT doc_id, {_LOWER.format("run")} AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) x WHERE length(run) >= 7),
        each AS (SELECT run, n, {_CRC.format("(doc_id || ':' || run)")} AS h FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run) x, crc_table),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM (
                    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM each) x
                  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words) x),
        pairs AS (SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                  UNION SELECT a.word, b.word FROM words a JOIN cuts b ON a.word = b.rest UNION SELECT b.word, a.word FROM words a JOIN cuts b ON a.word = b.rest),
        near AS (SELECT a AS word, n AS m, b AS other, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM pairs JOIN words ON b = word),
        forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n
                  FROM words w LEFT JOIN near x ON x.word = w.word AND place = 1),
        follow AS (SELECT word, word AS root, form AS onward FROM forms UNION ALL SELECT w.word, f.word, f.form FROM follow w JOIN forms f ON w.onward = f.word)
        SELECT f.word, f.form, root, f.n, f.n_near, f.form_n FROM forms f JOIN follow w ON f.word = w.word AND onward IS NULL""",
    "op4_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)""",
    # alpha is bisected in whole steps of 2^-20; md5 orders blocks and documents as in the operator
    "op1_mixing": """
        WITH RECURSIVE rows_ AS (
            SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS s,
                   coalesce(length(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS tokens FROM documents),
        sources AS (SELECT s, sum(tokens)::BIGINT AS tokens, count(*) AS documents FROM rows_ GROUP BY s HAVING sum(tokens) > 0),
        shares AS (SELECT list(tokens / total::DOUBLE) AS p, total FROM sources, (SELECT sum(tokens)::BIGINT AS total FROM sources) GROUP BY total),
        halving(k, lo, hi) AS (
            SELECT 0, 0::BIGINT, 1048576::BIGINT
            UNION ALL
            SELECT k + 1, CASE WHEN met THEN mid ELSE lo END, CASE WHEN met THEN hi ELSE mid END FROM (
                SELECT k, lo, hi, mid, ln(z) - e / z >= 0.98 * ln(n) - 1e-12 AS met FROM (
                    SELECT k, lo, hi, mid, len(p) AS n, list_sum(list_transform(p, lambda x: pow(x, mid / 1048576.0))) AS z,
                           list_sum(list_transform(p, lambda x: pow(x, mid / 1048576.0) * ln(pow(x, mid / 1048576.0)))) AS e
                    FROM (SELECT k, lo, hi, (lo + hi) // 2 AS mid FROM halving WHERE hi - lo > 1) h, shares))),
        whole AS (SELECT list_sum(list_transform(p, lambda x: -x * ln(x))) >= 0.98 * ln(len(p)) - 1e-12 AS met FROM shares),
        best AS (SELECT CASE WHEN (SELECT met FROM whole) THEN 1.0::DOUBLE ELSE max(lo) / 1048576.0::DOUBLE END AS alpha, (SELECT total FROM shares) AS total FROM halving),
        weights AS (SELECT s, tokens, documents, alpha, total, pow(tokens / total::DOUBLE, alpha) / sum(pow(tokens / total::DOUBLE, alpha)) OVER () AS weight FROM sources, best),
        plan AS (SELECT s, weight, floor(weight * total + 1e-6)::BIGINT // tokens AS epochs, floor(weight * total + 1e-6)::BIGINT % tokens AS rest,
                        ceil(greatest(tokens, documents) / 50000.0)::BIGINT AS blocks FROM weights),
        dealt AS (SELECT r.doc_id, r.source, r.s, r.tokens, p.weight, p.epochs, p.rest, md5('0/' || r.s || '/' || r.doc_id) AS name,
                         ('0x' || substr(md5('0/' || r.s || '/' || r.doc_id), 1, 8))::BIGINT % p.blocks AS block
                  FROM rows_ r LEFT JOIN plan p USING (s)),
        blocks AS (SELECT s, block, at_, at_ + size AS upto FROM (
                     SELECT s, block, size, coalesce(sum(size) OVER (PARTITION BY s ORDER BY md5('0/block/' || s || '/' || block), block
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_
                     FROM (SELECT s, block, sum(tokens) AS size FROM dealt GROUP BY s, block))),
        run AS (SELECT d.*, b.at_, b.upto, sum(d.tokens) OVER (PARTITION BY d.s, d.block ORDER BY d.name, d.doc_id, d.tokens) - d.tokens AS before
                FROM dealt d LEFT JOIN blocks b ON d.s = b.s AND d.block = b.block)
        SELECT doc_id, source, tokens, (SELECT alpha FROM best) AS alpha, coalesce(weight, 0.0) AS weight,
               coalesce(epochs, 0) + CASE WHEN rest > 0 AND at_ < rest AND (upto <= rest OR at_ + before < rest) THEN 1 ELSE 0 END AS copies
        FROM run""",
}
