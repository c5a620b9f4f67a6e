"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, minhash, mixing, pieces, pii, quality, token_io, winnowing, wrapper
from .common import staged, table, texts


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    narrow = staged(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size")), "sizes")
    out, _ = mixing.mix(narrow, size_col="size", text_col="size")
    return out.select("doc_id", F.col("size"), "source_size", "target", "taken")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_io.write(texts(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return token_io.read(spark, folder)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(texts(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.annotate(texts(spark, sf_dir, "documents"))


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.dialogues(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("trained", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return made.withColumn("trained", spans)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(texts(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(texts(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_texts(texts(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.annotate(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edited(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_token_files": op2_token_files,
    "op3_pii": op3_pii,
    "op4_minhash": op4_minhash,
    "op5_perspectives": op5_perspectives,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pieces": op7_pieces,
    "op8_wrapper": op8_wrapper,
    "op9_quality": op9_quality,
    "op10_winnowing": op10_winnowing,
}

SQL: dict[str, str] = {
    "op1_mixing": """
        WITH sizes AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                   substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS key
            FROM documents
        ), by_source AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
        ), caps AS (
            SELECT *, CAST(3 * source_size AS DOUBLE) AS cap,
                   CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
            FROM by_source
        ), tries AS (
            SELECT *, cap / weight AS level,
                   (sum(source_size) OVER () - coalesce(sum(cap) OVER below, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS try
            FROM caps WINDOW below AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), water AS (
            SELECT try AS water FROM tries WHERE try <= level ORDER BY level, source NULLS FIRST LIMIT 1
        ), targets AS (
            SELECT source, source_size, coalesce(least(cap, weight * (SELECT water FROM water)), cap) AS target FROM tries
        ), parts AS (
            SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM targets
        ), keys AS (
            SELECT source, key, sum(size) AS size FROM sizes GROUP BY ALL
        ), placed AS (
            SELECT source, key, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keys
        ), taken AS (
            SELECT k.source, k.key, CASE WHEN k.size = 0 THEN 0.0 ELSE greatest(0, least(k.size, round(p.target - p.whole * p.source_size) - k.before)) / k.size END AS share
            FROM placed k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source
        )
        SELECT s.doc_id, s.size, p.source_size, p.target, CAST(s.size * p.whole + floor(s.size * t.share + 1e-9) AS BIGINT) AS taken
        FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source JOIN taken t ON s.source IS NOT DISTINCT FROM t.source AND s.key = t.key
    """,
    "op5_perspectives": r"""
        WITH cleaned AS (
            SELECT conv_id, turn, regexp_replace(replace(coalesce(role, ''), '<|', '< |'), '[\x{0}-\x{1F}\x{7F}-\x{9F}\x{2028}\x{2029}]', ' ', 'g') AS speaker,
                   replace(coalesce(text, ''), '<|', '< |') AS words
            FROM conversations
        ), alone AS (
            SELECT *, md5(speaker || chr(10) || md5(words)) AS alone FROM cleaned
        ), turns AS (
            SELECT conv_id, turn, speaker, words, CASE WHEN turn IS NULL THEN alone ELSE md5(words) END AS digest,
                   coalesce('=' || CAST(conv_id AS VARCHAR), '#' || coalesce(CAST(turn AS VARCHAR), '') || '#' || alone) AS k,
                   CASE WHEN turn IS NULL THEN -1152921504606846976 + CAST('0x' || alone[1:3] AS BIGINT) ELSE CAST(floor(turn / 1024) AS BIGINT) END AS block
            FROM alone
        ), who AS (
            SELECT DISTINCT k, speaker AS perspective FROM turns WHERE speaker <> 'system'
        ), seen AS (
            SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
            FROM turns t JOIN who w ON t.k = w.k
        ), heads AS (
            SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM seen
        ), segments AS (
            SELECT *, head || words || '<|im_end|>' || chr(10) AS segment FROM heads
        ), placed AS (
            SELECT *, CAST(coalesce(sum(length(segment)) OVER (whole ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
                   (row_number() OVER (PARTITION BY k, block, perspective ORDER BY turn NULLS FIRST, CASE WHEN turn IS NOT NULL THEN speaker END, digest) - 1) // 1024 AS piece
            FROM segments WINDOW whole AS (PARTITION BY k, perspective ORDER BY block, turn NULLS FIRST, CASE WHEN turn IS NOT NULL THEN speaker END, digest)
        )
        SELECT any_value(conv_id) AS conv_id, perspective, min(start) AS start, count(*) AS n_turns, string_agg(segment, '' ORDER BY start) AS text,
               coalesce(string_agg(CAST(start + length(head) AS VARCHAR) || ':' || CAST(start + length(segment) - 1 AS VARCHAR), ',' ORDER BY start)
                        FILTER (role = 'assistant'), '') AS trained
        FROM placed GROUP BY k, block, perspective, piece
    """,
    "op4_minhash": """
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                             '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                                              ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
            FROM words
        ), classes AS (
            SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL
        ), items AS (
            SELECT rep, n, unnest(s) AS item FROM classes
        ), links AS (
            SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.item = b.item AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), both_ways AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach AS (
            SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
        ), least_of AS (
            SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(l.component_id, s.doc_id) AS kept
        FROM sets s LEFT JOIN classes c ON list_sort(s.s) = c.s LEFT JOIN least_of l ON l.rep = c.rep
    """,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
