"""Queries of the library over the test tables, and the DuckDB SQL they are checked against.

The tables hold almost nothing the rules look for, so each query first puts artifacts into the
texts, by an expression of the row's key that both engines understand.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layers import UPLOAD
from ..functions.rulebook import load
from ..operators import binary, findings, hits, native
from ..operators.clean import clean, normalized
from ..sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: What each family of queries puts into texts, by the remainder of the key.
# Spaces and marks that look like others stand as escapes.
ZW, NBSP, EM, THIN, LINE, PARA, PRIVATE = "\u200b", "\u00a0", "\u2003", "\u2009", "\u2028", "\u2029", "\ue000"
SEEDS = {
    "typography": {
        0: "concat('“', substr(text, 1, 30), '” and ‘x’ «y» ', substr(text, 31))",
        1: "concat(substr(text, 1, 20), ' — ', substr(text, 21, 20), '–', substr(text, 41))",
        2: "concat('From 5 – 7 and more… ', text, ' ......')",
        3: "concat('• first ‚quoted‘ ', text, ' .... and ..... end')",
        4: "concat('a‒b — c ― d', substr(text, 5))",
    },
    "invisible": {
        0: f"concat(substr(text, 1, 40), '{ZW}{ZW}⁠', substr(text, 41))",
        1: "concat('soft­hyphen 󠀁󠁨󠁩 ', text)",
        2: f"concat('private{PRIVATE}\u206a use ', text, '\ufffe')",
        3: "concat('‎bidi‮mark‬ ', text)",
        4: "concat('שלום ‎kept ', text)",
    },
    "spaces": {
        0: f"concat('one{EM}two　three ', text)",
        1: f"concat(substr(text, 1, 10), 'x{NBSP}y', substr(text, 11))",
        2: f"concat('10{NBSP}% and 5{THIN}kg of z.{NBSP}B. text ', text)",
        3: f"concat('line{LINE}x{PARA}para \u2801\u2800\u2803 a\u2800b ', text)",
    },
    "joiners": {
        0: "concat('क्‍ष wa‍ter ', text)",
        1: "concat('می‌خواهم wa‌ter ', text)",
        2: "concat('א͏ב a͏b 👩‍💻 ', text)",
        3: "concat('Hello︁︂󠄀 world️ ❤️ ', text)",
        4: "concat('🏴󠁧󠁢󠁥󠁮󠁧󠁿 flag 🏴󠁧󠁢󠁥 text ', text)",
    },
    "entities": {
        0: "concat('wa&#8203;ter &zwnj;and&#x200B; ', text)",
        1: "concat('&amp; &lt;b&gt; &shy;soft &#169; &#00173;x ', text)",
        2: "concat('&NoBreak;&bogus; &#xE0041; &#99999999999; ', text)",
    },
    "letters": {
        0: "concat('pаypal and Visit СОРЕ today ', text)",
        1: "concat('Привет а мир, pаypal ', text)",
        2: "concat('Αthens ЕЕ ', text)",
    },
    "code": {
        0: "concat('Use `“x”` and “y” ', text)",
        1: "concat('“a” ```\n“b”\n``` “c” ', text)",
        2: "concat('“a” ~~~ “open ', text)",
        3: "concat('---\ntitle: “t”\n---\n“body” ', text)",
        4: "concat('``a ` “b”`` “c” ', text)",
    },
    "voice": {
        0: "concat('In conclusion, we delve into it. ', text)",
        1: "concat('Without further ado, we ship the robust thing. ', text)",
        2: "concat('This isn''t a tool. This is a movement. It''s not just planning, it''s also psychology. ', text)",
        3: "concat('Not only fast, but also reliable. Less talking, more shipping. ', text)",
        4: "concat('At the end of the day, a plethora of vital and pivotal paradigms. ', text)",
        5: "concat('Es geht nicht um Tools. Es geht um Haltung. Meistern wir das nahtlos. ', text)",
    },
    "artifacts": {
        0: "concat('See source citeturn0search0 and more ', text)",
        1: "concat('Read [cite: 1, 2] this [span_1](start_span)now ', text)",
        2: "concat('at https://x.io/?utm_source=openai end and https://y.io/a?b=1&utm_source=chatgpt.com here ', text)",
        3: "concat('file https://ppl-ai-file-upload.s3.example.com/a.png and 【4†source】, done ', text)",
        4: "concat('at https://x.io/?utm_source=openai&k=v end ', text)",
        5: "concat('at https://x.io/?utm_source=newsletter end ', text)",
    },
    "normal": {0: "concat('e\u0301a\u0300o\u0308 ', text)", 1: "concat('A\u030a \u212b ', text)"},
}
MODULUS = 8


def seed(family: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {e}" for k, e in SEEDS[family].items())
    return f"CASE doc_id % {MODULUS} {cases} ELSE text END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return files.spread(df, df.columns[0])


def seeded(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # Spark reads \ in a string as an escape; the seeds hold none.
    return docs.withColumn("text", F.expr(seed(family)))


def source(family: str) -> str:
    return f"(SELECT doc_id, lang, source, {seed(family)} AS text FROM documents)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


RULES = load()
QUOTE_FROM, QUOTE_TO = "".join(RULES.quotes), "".join(RULES.quotes.values())


def sql_replaced(column: str, table: dict[str, str]) -> str:
    for a, b in table.items():
        column = f"replace({column}, {quoted(a)}, {quoted(b)})"
    return column


def sql_count(column: str, characters: str) -> str:
    return f"CAST(length({column}) - length(translate({column}, {quoted(characters)}, '')) AS BIGINT)"


# --- typography ---------------------------------------------------------------------------------


@query("quotes_straighten", f"SELECT doc_id, translate(text, {quoted(QUOTE_FROM)}, {quoted(QUOTE_TO)}) AS cleaned, {sql_count('text', QUOTE_FROM)} AS n_quotes FROM {source('typography')}")
def quotes_straighten(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return seeded(spark, sf_dir, "typography").select("doc_id", native.straight_quotes(t).alias("cleaned"), native.quote_count(t).alias("n_quotes"))


@query(
    "punctuation_normalize",
    f"""SELECT doc_id, regexp_replace(marked, '[.]{{4,}}', '...', 'g') AS cleaned, {sql_count("text", "".join(RULES.marks))} AS n_marks,
        CAST(len(regexp_extract_all(marked, '[.]{{4,}}')) AS BIGINT) AS n_runs
        FROM (SELECT *, {sql_replaced("text", RULES.marks)} AS marked FROM {source("typography")})""",
)
def punctuation_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir, "typography").select("doc_id", native.punctuation(F.col("text")).alias("p")).select("doc_id", F.col("p.text").alias("cleaned"), "p.n_marks", "p.n_runs")


@query(
    "dash_policy",
    f"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '([0-9][ \\t])[‒–—―]([ \\t][0-9])', '\\1-\\2', 'g') AS ranged FROM {source("typography")}),
        b AS (SELECT *, regexp_replace(ranged, '[ \\t]+[‒–—―][ \\t]+', ', ', 'g') AS spaced FROM a)
        SELECT doc_id, regexp_replace(spaced, '[‒–—―]', '-', 'g') AS cleaned,
               CAST(len(regexp_extract_all(text, '[0-9][ \\t][‒–—―][ \\t][0-9]')) AS BIGINT) AS n_range,
               CAST(len(regexp_extract_all(ranged, '[ \\t]+[‒–—―][ \\t]+')) AS BIGINT) AS n_spaced,
               CAST(len(regexp_extract_all(spaced, '[‒–—―]')) AS BIGINT) AS n_unspaced FROM b""",
)
def dash_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seeded(spark, sf_dir, "typography").select("doc_id", native.dashes(F.col("text")).alias("d"))
    return rows.select("doc_id", F.col("d.text").alias("cleaned"), "d.n_range", "d.n_spaced", "d.n_unspaced")


# --- characters ---------------------------------------------------------------------------------

GONE = "[\\x{200B}\\x{2060}\\x{FEFF}\\x{00AD}\\x{180E}\\x{2061}-\\x{2064}\\x{206A}-\\x{206F}\\x{FFF9}-\\x{FFFB}\\x{E000}-\\x{F8FF}\\x{E0000}-\\x{E007F}\\x{F0000}-\\x{FFFFD}\\x{100000}-\\x{10FFFD}\\x{FDD0}-\\x{FDEF}\\x{FFFE}\\x{FFFF}]"
BIDI = "[\\x{200E}\\x{200F}\\x{061C}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]"
INVISIBLE_SQL = f"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{{0590}}-\\x{{08FF}}]') THEN regexp_replace(text, '{GONE}', '', 'g')
    ELSE regexp_replace(text, '{GONE}|{BIDI}', '', 'g') END AS cleaned FROM {source("invisible")}"""


@query("invisible_remove", INVISIBLE_SQL)
def invisible_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir, "invisible").select("doc_id", native.without_invisible(F.col("text")).alias("cleaned"))


@query("invisible_remove_full", INVISIBLE_SQL)
def invisible_remove_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(seeded(spark, sf_dir, "invisible"), settings={"layers": ["characters"]}).select("doc_id", "cleaned")


SPACES_SQL = f"""SELECT doc_id, CASE doc_id % {MODULUS}
    WHEN 0 THEN replace(replace(text, '{EM}', ' '), '　', ' ') WHEN 1 THEN replace(text, '{NBSP}', ' ')
    WHEN 3 THEN replace(replace(replace(text, '{LINE}', ' '), '{PARA}', ' '), 'a\u2800b', 'a b') ELSE text END AS cleaned FROM {source("spaces")}"""


@query("exotic_spaces", SPACES_SQL)
def exotic_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir, "spaces").select("doc_id", native.plain_spaces(F.col("text")).alias("cleaned"))


@query("exotic_spaces_full", SPACES_SQL)
def exotic_spaces_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(seeded(spark, sf_dir, "spaces"), settings={"layers": ["characters"]}).select("doc_id", "cleaned")


@query(
    "joiner_context",
    f"""SELECT doc_id, CASE doc_id % {MODULUS}
        WHEN 0 THEN replace(text, 'wa‍ter', 'water') WHEN 1 THEN replace(text, 'wa‌ter', 'water') WHEN 2 THEN replace(text, 'a͏b', 'ab')
        WHEN 3 THEN replace(replace(text, 'Hello︁︂󠄀', 'Hello'), 'world️', 'world') WHEN 4 THEN replace(text, '🏴󠁧󠁢󠁥 ', '🏴 ')
        ELSE text END AS cleaned FROM {source("joiners")}""",
)
def joiner_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(seeded(spark, sf_dir, "joiners"), settings={"layers": ["characters"]}).select("doc_id", "cleaned")


@query(
    "codepoint_classify",
    f"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS char, generate_subscripts(string_split(text, ''), 1) - 1 AS idx,
                          regexp_matches(text, '[\\x{{0590}}-\\x{{08FF}}]') AS rtl FROM {source("invisible")})
        SELECT doc_id, CAST(idx AS INTEGER) AS idx, unicode(char) AS code,
               CASE WHEN regexp_matches(char, '{BIDI}') AND rtl THEN 'keep' ELSE 'remove' END AS action
        FROM c WHERE regexp_matches(char, '{GONE}|{BIDI}')""",
)
def codepoint_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.characters(seeded(spark, sf_dir, "invisible"), "doc_id").select("doc_id", F.col("index").alias("idx"), "code", "action")


@query(
    "codepoint_histogram",
    f"SELECT lang, char, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS char FROM {source('typography')}) WHERE char <> '' GROUP BY lang, char",
)
def codepoint_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seeded(spark, sf_dir, "typography").select("lang", F.explode(native.code_points(F.col("text"))).alias("char"))
    return rows.groupBy("lang", "char").agg(F.count(F.lit(1)).alias("n"))


@query("nfc_normalize", f"SELECT doc_id, nfc_normalize(text) AS cleaned FROM {source('normal')}")
def nfc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(seeded(spark, sf_dir, "normal"), "text").select("doc_id", F.col("text").alias("cleaned"))


ENTITY_SQL = f"""SELECT doc_id, CASE doc_id % {MODULUS} WHEN 0 THEN replace(replace(replace(text, '&#8203;', '{ZW}'), '&zwnj;', '‌'), '&#x200B;', '{ZW}')
    WHEN 1 THEN replace(replace(text, '&shy;', '­'), '&#00173;', '­') WHEN 2 THEN replace(replace(text, '&NoBreak;', '⁠'), '&#xE0041;', '󠁁')
    ELSE text END AS cleaned FROM {source("entities")}"""


@query("entity_decode", ENTITY_SQL)
def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir, "entities").select("doc_id", native.decoded_entities(F.col("text")).alias("cleaned"))


@query("entity_decode_full", ENTITY_SQL)
def entity_decode_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(seeded(spark, sf_dir, "entities"), settings={"layers": ["entities"]}).select("doc_id", "cleaned")


# --- look-alike letters -------------------------------------------------------------------------

TABLE = "".join(RULES.lookalikes)
LATIN_SQL = "[A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}\\x{1E00}-\\x{1EFF}]"
FOREIGN_SQL = "[" + "".join(f"\\x{{{c:X}}}" for c in range(0x370, 0x530) if chr(c) not in TABLE) + "]"
WORDS_SQL = f"""SELECT doc_id, text, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'),
    lambda w: regexp_matches(w, '[{TABLE}]') AND NOT regexp_matches(w, '{FOREIGN_SQL}')
              AND (regexp_matches(w, '{LATIN_SQL}') OR NOT regexp_matches(text, '{FOREIGN_SQL}'))) AS found FROM {source("letters")}"""


@query("homoglyph_words", f"SELECT doc_id, array_to_string(found, ',') AS words, CAST(len(found) AS BIGINT) AS n_words FROM ({WORDS_SQL})")
def homoglyph_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seeded(spark, sf_dir, "letters").select("doc_id", native.suspicious_words(F.col("text")).alias("found"))
    return rows.select("doc_id", F.array_join("found", ",").alias("words"), F.size("found").cast("long").alias("n_words"))


LETTERS_SQL = f"""SELECT doc_id, CASE doc_id % {MODULUS} WHEN 0 THEN replace(replace(text, 'pаypal', 'paypal'), 'СОРЕ', 'COPE')
    WHEN 1 THEN replace(text, 'pаypal', 'paypal') WHEN 2 THEN replace(replace(text, 'Αthens', 'Athens'), 'ЕЕ', 'EE') ELSE text END AS cleaned FROM {source("letters")}"""


@query("homoglyph_replace", LETTERS_SQL)
def homoglyph_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.ascii_lookalikes(seeded(spark, sf_dir, "letters"), "text").select("doc_id", F.col("text").alias("cleaned"))


@query("homoglyph_replace_full", LETTERS_SQL)
def homoglyph_replace_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = {"layers": ["homoglyphs"], "replace_homoglyphs": True}
    return clean(seeded(spark, sf_dir, "letters"), settings=how).select("doc_id", "cleaned")


# --- protected regions --------------------------------------------------------------------------

FENCE = "`" * 3
SHUT_SQL = f"(?s:^---[ \\t]*\\r?\\n.*?\\r?\\n---[ \\t]*(?:\\r?\\n|$))|(?s:{FENCE}.*?(?:{FENCE}|$))|(?s:~~~.*?(?:~~~|$))|``[^\\r\\n]*?``|`[^`\\r\\n]+`"
PARTS_SQL = f"""WITH p AS (SELECT doc_id, regexp_split_to_array(text, '{SHUT_SQL}') AS gaps, regexp_extract_all(text, '{SHUT_SQL}') AS code FROM {source("code")}),
    z AS (SELECT doc_id, unnest(range(1, len(gaps) + 1)) AS k, gaps, code FROM p),
    both_ AS (SELECT doc_id, 2 * k AS ord, false AS protected, gaps[k] AS part FROM z UNION ALL SELECT doc_id, 2 * k + 1, true, code[k] FROM z WHERE k <= len(code))"""


@query("protected_segments", f"{PARTS_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS ord, protected, part FROM both_ WHERE part <> ''")
def protected_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seeded(spark, sf_dir, "code").select("doc_id", F.posexplode(native.parts(F.col("text"))).alias("ord", "p"))
    return rows.select("doc_id", "ord", "p.protected", F.col("p.text").alias("part"))


OUTSIDE_SQL = f"""{PARTS_SQL} SELECT doc_id, string_agg(CASE WHEN protected THEN part ELSE translate(part, {quoted(QUOTE_FROM)}, {quoted(QUOTE_TO)}) END, '' ORDER BY ord) AS cleaned
    FROM both_ GROUP BY doc_id"""


@query("clean_outside_code", OUTSIDE_SQL)
def clean_outside_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir, "code").select("doc_id", native.outside_code(F.col("text"), native.straight_quotes).alias("cleaned"))


@query("clean_outside_code_full", OUTSIDE_SQL)
def clean_outside_code_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = {"layers": ["typography"], "fix_dashes": False, "fix_punctuation": False}
    return clean(seeded(spark, sf_dir, "code"), settings=how).select("doc_id", "cleaned")


# --- voice --------------------------------------------------------------------------------------


def sql_pattern(phrase: str) -> str:
    """A phrase between doubled separators, whose own separators are doubled too."""
    body = "".join(x if re.fullmatch(r"\w", x) else "[ \\t\\n]+" if x == " " else "['’]{2}" if x in "'’" else f"\\{x}\\{x}" for x in phrase.lower())
    return quoted(f"(?:^|[^\\p{{L}}\\p{{N}}_]){body}(?:$|[^\\p{{L}}\\p{{N}}_])")


def sql_total(phrases: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all(d, {sql_pattern(p)}))" for p in phrases)


DOUBLED = f"(SELECT doc_id, regexp_replace(lower(text), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') AS d FROM {source('voice')})"


@query("banned_count", f"SELECT doc_id, CAST({sql_total(RULES.banned)} AS BIGINT) AS n_banned FROM {DOUBLED}")
def banned_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir, "voice").select("doc_id", native.total(F.col("text"), native.banned_patterns()).alias("n_banned"))


@query("lexicon_count", f"SELECT doc_id, CAST({sql_total(RULES.lexicon)} AS BIGINT) AS n_lexicon FROM {DOUBLED}")
def lexicon_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir, "voice").select("doc_id", native.total(F.col("text"), native.lexicon_patterns()).alias("n_lexicon"))


SHAPES_SQL = ", ".join(f"CASE WHEN regexp_matches(text, {quoted('(?i)' + s.pattern())}) THEN {quoted(s.id)} END" for s in RULES.shapes)


@query("shape_flags", f"SELECT doc_id, array_to_string(list_filter([{SHAPES_SQL}], lambda x: x IS NOT NULL), ',') AS shapes FROM {source('voice')}")
def shape_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir, "voice").select("doc_id", F.array_join(native.shapes_present(F.col("text")), ",").alias("shapes"))


HITS_SQL = f"""SELECT doc_id, start, "end", kind, id, severity FROM documents JOIN (VALUES
    (0, 0, 14, 'filler', 'in conclusion,', 'fixed'), (0, 18, 28, 'banned', 'delve into', 'error'), (0, 18, 23, 'lexicon', 'delve', 'warn'),
    (1, 0, 19, 'filler', 'without further ado', 'fixed'), (1, 33, 39, 'lexicon', 'robust', 'warn'),
    (2, 0, 26, 'shape', 'this-isnt-this-is', 'error'), (2, 39, 72, 'shape', 'its-not-just-its-also', 'error'),
    (3, 0, 23, 'shape', 'not-only-but-also', 'warn'), (3, 34, 61, 'shape', 'less-x-more-y', 'warn'),
    (4, 0, 21, 'banned', 'at the end of the day', 'error'), (4, 23, 36, 'banned', 'a plethora of', 'error'), (4, 37, 42, 'lexicon', 'vital', 'warn'), (4, 47, 54, 'lexicon', 'pivotal', 'warn'),
    (5, 0, 34, 'shape', 'es-geht-nicht-um-es-geht-um', 'error'), (5, 44, 52, 'lexicon', 'meistern', 'warn'), (5, 61, 68, 'lexicon', 'nahtlos', 'warn')
    ) AS v(k, start, "end", kind, id, severity) ON doc_id % {MODULUS} = k"""


@query("phrase_hits", HITS_SQL)
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.phrases(seeded(spark, sf_dir, "voice"), "doc_id").select("doc_id", "start", "end", "kind", "id", "severity")


@query(
    "hits_not_in_filler",
    f"""WITH all_hits AS ({HITS_SQL}) SELECT h.* FROM all_hits h WHERE kind <> 'filler'
        AND NOT EXISTS (SELECT 1 FROM all_hits f WHERE f.kind = 'filler' AND f.doc_id = h.doc_id AND f.start <= h.start AND h."end" <= f."end")""",
)
def hits_not_in_filler(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits.phrases(seeded(spark, sf_dir, "voice"), "doc_id").select("doc_id", "start", "end", "kind", "id", "severity")
    return hits.outside(found.where("kind <> 'filler'"), found.where("kind = 'filler'"), "doc_id")


@query(
    "filler_delete",
    f"""SELECT doc_id, CASE doc_id % {MODULUS} WHEN 0 THEN 'We delve into it. ' || substr(text, 34) WHEN 1 THEN 'We ship the robust thing. ' || substr(text, 48)
        ELSE text END AS cleaned FROM {source("voice")}""",
)
def filler_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(seeded(spark, sf_dir, "voice"), settings={"layers": ["voice"]}).select("doc_id", "cleaned")


# --- artifacts ----------------------------------------------------------------------------------

TRACKING_SQL = f"""CASE doc_id % {MODULUS} WHEN 2 THEN replace(replace(text, '?utm_source=openai ', ' '), '&utm_source=chatgpt.com ', ' ')
    WHEN 4 THEN replace(text, '?utm_source=openai&', '?') ELSE text END"""


@query("tracking_params", f"SELECT doc_id, {TRACKING_SQL} AS cleaned FROM {source('artifacts')}")
def tracking_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir, "artifacts").select("doc_id", native.without_tracking(F.col("text")).alias("cleaned"))


ARTIFACT_SQL = f"""CASE doc_id % {MODULUS} WHEN 0 THEN replace(text, 'source citeturn0search0 and', 'source and')
    WHEN 1 THEN replace(replace(text, 'Read [cite: 1, 2] this', 'Read this'), 'this [span_1](start_span)now', 'this now')
    WHEN 3 THEN replace(text, ' 【4†source】,', ',') ELSE {TRACKING_SQL} END"""


@query("artifact_remove", f"SELECT doc_id, {ARTIFACT_SQL} AS cleaned FROM {source('artifacts')}")
def artifact_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(seeded(spark, sf_dir, "artifacts"), settings={"layers": ["artifacts"]}).select("doc_id", "cleaned")


@query("warn_urls", f"SELECT doc_id, CAST(len(regexp_extract_all(text, {quoted(UPLOAD[2])})) AS BIGINT) AS n_uploads FROM {source('artifacts')}")
def warn_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir, "artifacts").select("doc_id", native.upload_links(F.col("text")).alias("n_uploads"))


# --- the whole cleaner and its reports ----------------------------------------------------------


@query(
    "full_clean",
    f"""SELECT doc_id, cleaned, cleaned <> text AS changed
        FROM (SELECT doc_id, text, regexp_replace({ARTIFACT_SQL}, '[.]{{4,}}', '...', 'g') AS cleaned FROM {source("artifacts")})""",
)
def full_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(seeded(spark, sf_dir, "artifacts")).select("doc_id", "cleaned", F.col("report.changed").alias("changed"))


def voiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(seeded(spark, sf_dir, "voice"), settings={"layers": ["voice"]})


COUNTS_SQL = f"""(SELECT doc_id, lang, source, k, CASE WHEN k IN (0, 1) THEN 1 ELSE 0 END AS fixed,
    CASE k WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS error,
    CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 0 END AS warn
    FROM (SELECT *, doc_id % {MODULUS} AS k FROM documents))"""
SUMS = "CAST(count(*) AS BIGINT) AS files, CAST(sum(fixed) AS BIGINT) AS changed, CAST(count(*) FILTER (error > 0) AS BIGINT) AS blocked, CAST(sum(fixed) AS BIGINT) AS fixed, CAST(sum(warn) AS BIGINT) AS warn, CAST(sum(error) AS BIGINT) AS error"


@query("clean_summary", f"SELECT lang, {SUMS} FROM {COUNTS_SQL} GROUP BY lang")
def clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summary(voiced(spark, sf_dir), "lang")


@query("run_summary", f"SELECT {SUMS} FROM {COUNTS_SQL}")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summary(voiced(spark, sf_dir))


@query("findings_by_severity", f"SELECT doc_id, CAST(fixed AS BIGINT) AS fixed, CAST(0 AS BIGINT) AS info, CAST(warn AS BIGINT) AS warn, CAST(error AS BIGINT) AS error FROM {COUNTS_SQL} WHERE k < 6")
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.by_severity(findings.exploded(voiced(spark, sf_dir), "doc_id"), "doc_id")


KINDS_SQL = """(VALUES (0, 'filler-phrase', 'fixed', 1), (0, 'banned-phrase', 'error', 1), (0, 'lexicon', 'warn', 1), (1, 'filler-phrase', 'fixed', 1), (1, 'lexicon', 'warn', 1),
    (2, 'sentence-shape', 'error', 2), (3, 'sentence-shape', 'warn', 2), (4, 'banned-phrase', 'error', 2), (4, 'lexicon', 'warn', 2),
    (5, 'sentence-shape', 'error', 1), (5, 'lexicon', 'warn', 2)) AS v(k, kind, severity, n)"""


@query(
    "findings_cube",
    f"SELECT lang, kind, severity, CAST(sum(n) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS findings FROM documents JOIN {KINDS_SQL} ON doc_id % {MODULUS} = k GROUP BY CUBE (lang, kind, severity)",
)
def findings_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.cube(findings.exploded(voiced(spark, sf_dir), "lang"), "lang", "kind", "severity")


@query("findings_merged", f"SELECT source, kind, severity, CAST(sum(n) AS BIGINT) AS count FROM documents JOIN {KINDS_SQL} ON doc_id % {MODULUS} = k GROUP BY ALL")
def findings_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = findings.merged(findings.exploded(voiced(spark, sf_dir), "source"), "source")
    # The counts by rule must add up to the count.
    same = F.aggregate(F.map_values("by_rule"), F.lit(0).cast("long"), lambda a, b: a + b) == F.col("count")
    return made.where(same).select("source", "kind", "severity", "count")


@query("top8_examples", f"SELECT doc_id, kind, severity, examples FROM documents JOIN (VALUES (0, 'banned-phrase', 'error', 'delve into'), (0, 'lexicon', 'warn', 'delve'), (1, 'lexicon', 'warn', 'robust'), (2, 'sentence-shape', 'error', 'this-isnt-this-is,its-not-just-its-also'), (3, 'sentence-shape', 'warn', 'not-only-but-also,less-x-more-y'), (4, 'banned-phrase', 'error', 'at the end of the day,a plethora of'), (4, 'lexicon', 'warn', 'pivotal,vital'), (5, 'sentence-shape', 'error', 'es-geht-nicht-um-es-geht-um'), (5, 'lexicon', 'warn', 'nahtlos,meistern')) AS v(k, kind, severity, examples) ON doc_id % {MODULUS} = k")
def top8_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings.exploded(voiced(spark, sf_dir), "doc_id").where(F.size("examples") > 0)
    return rows.select("doc_id", "kind", "severity", F.array_join("examples", ",").alias("examples"))


@query("gate", f"SELECT CAST(CASE WHEN count(*) FILTER (error > 0) > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM {COUNTS_SQL}")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.gate(voiced(spark, sf_dir))


@query("length_delta", f"SELECT doc_id, CAST(length(text) AS BIGINT) AS before, CAST(length({ARTIFACT_SQL}) AS BIGINT) AS after FROM {source('artifacts')}")
def length_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = clean(seeded(spark, sf_dir, "artifacts"), settings={"layers": ["artifacts"]})
    return done.select("doc_id", F.col("report.original_length").alias("before"), F.col("report.cleaned_length").alias("after"))


#: The lines of each case, the gravest findings first.
LINES = {
    0: ("1 error, 1 warn, 1 fixed", [("banned-phrase", "error", 1, "delve into"), ("lexicon", "warn", 1, "delve"), ("filler-phrase", "fixed", 1, "")]),
    1: ("1 warn, 1 fixed", [("lexicon", "warn", 1, "robust"), ("filler-phrase", "fixed", 1, "")]),
    2: ("2 error", [("sentence-shape", "error", 2, "this-isnt-this-is, its-not-just-its-also")]),
    3: ("2 warn", [("sentence-shape", "warn", 2, "not-only-but-also, less-x-more-y")]),
    4: ("2 error, 2 warn", [("banned-phrase", "error", 2, "at the end of the day, a plethora of"), ("lexicon", "warn", 2, "pivotal, vital")]),
    5: ("1 error, 2 warn", [("sentence-shape", "error", 1, "es-geht-nicht-um-es-geht-um"), ("lexicon", "warn", 2, "nahtlos, meistern")]),
}
TAGS = {"error": "block", "warn": "warn", "fixed": "fixed"}


def sql_lines(k: int) -> str:
    head, found = LINES[k]
    lines = [f"  [{TAGS[severity]}] {RULES.messages['voice', kind, severity]} x{n}" + (f"  ({examples})" if examples else "") for kind, severity, n, examples in found]
    return f"WHEN {k} THEN 'doc ' || CAST(doc_id AS VARCHAR) || {quoted(f'  ({head})')} || " + " || ".join(f"chr(10) || {quoted(line)}" for line in lines)


@query(
    "report_lines",
    f"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE CASE doc_id % {MODULUS} {" ".join(map(sql_lines, LINES))} ELSE 'clean  doc ' || CAST(doc_id AS VARCHAR) END END AS lines
        FROM {source("voice")}""",
)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return voiced(spark, sf_dir).select("doc_id", findings.lines(F.col("report"), name).alias("lines"))


# --- tables and files ---------------------------------------------------------------------------


@query("dedupe_first", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return files.first_of_each(docs, "text", "doc_id").select("doc_id", "source")


@query("html_comment_strip", "SELECT page_id, CAST(len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS BIGINT) AS n_comments, regexp_replace(html, '<!--.*?-->', '', 'gs') AS cleaned FROM pages")
def html_comment_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", native.svg_hits(F.col("html")).alias("n_comments"), native.svg_stripped(F.col("html")).alias("cleaned"))


@query("valid_text", "SELECT doc_id, doc_id % 3 <> 0 AS valid FROM documents")
def valid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content: Column = F.when(F.col("doc_id") % 3 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("text", "UTF-8"))
    return docs.select("doc_id", files.text_of(content).isNotNull().alias("valid"))


@query("pdf_scan", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id % 5 + 1 AS BIGINT) END AS hits FROM documents")
def pdf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    body = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("no ")).otherwise(F.lit("")), F.lit("%PDF-1.7 /Producer "), F.repeat(F.lit("/Author (x) "), (F.col("doc_id") % 5).cast("int")))
    return docs.select("doc_id", native.pdf_hits(F.encode(body, "UTF-8")).alias("hits"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


PNG_BYTES = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", bytes(13)) + _chunk(b"tEXt", b"Author\0someone") + _chunk(b"tIME", bytes(7)) + _chunk(b"IDAT", b"x") + _chunk(b"IEND", b"")
JPEG_BYTES = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + b"\xff\xfe\x00\x06note" + b"\xff\xda\x00\x02pixels\xff\xd9"


def _docx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("docProps/core.xml", "<core><dc:title>Some title</dc:title><dc:creator>A</dc:creator><cp:lastModifiedBy>B</cp:lastModifiedBy></core>")
        z.writestr("word/document.xml", '<w:ins w:author="A"><w:t>text</w:t></w:ins>')
    return out.getvalue()


@query(
    "image_strip",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS stripped, CAST(CASE WHEN doc_id % 2 = 0 THEN 'text,timestamp' ELSE 'comment' END AS VARCHAR) AS kinds FROM documents""",
)
def image_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.col("doc_id") % 2 == 0
    rows = docs.select("doc_id", F.when(even, ".png").otherwise(".jpg").alias("suffix"), F.when(even, F.lit(PNG_BYTES)).otherwise(F.lit(JPEG_BYTES)).alias("content"))
    return binary.stripped(rows, "doc_id").select("doc_id", "stripped", F.array_join(F.transform("blocks", lambda b: b["kind"]), ",").alias("kinds"))


@query("office_strip", "SELECT doc_id, 3 AS stripped, 1 AS n_findings FROM documents")
def office_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.lit(".docx").alias("suffix"), F.lit(_docx()).alias("content"))
    return binary.stripped(rows, "doc_id").select("doc_id", "stripped", F.size("findings").alias("n_findings"))


@query("neighbours_window", f"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS char, generate_subscripts(string_split(text, ''), 1) AS idx FROM {source("spaces")})
    SELECT doc_id, CAST(idx - 1 AS INTEGER) AS idx, before, after FROM (SELECT *, lag(char) OVER w AS before, lead(char) OVER w AS after FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) WHERE char = '{NBSP}'""")
def neighbours_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    # By index within the row: no row for each character, and no window.
    rows = seeded(spark, sf_dir, "spaces").where(F.contains("text", F.lit(NBSP))).select("doc_id", native.code_points(F.col("text")).alias("chars"))
    near = F.transform("chars", lambda c, i: F.when(c == NBSP, F.struct(i.alias("idx"), F.get("chars", i - 1).alias("before"), F.get("chars", i + 1).alias("after"))))
    return rows.select("doc_id", F.explode(F.array_compact(near)).alias("x")).select("doc_id", "x.*")
