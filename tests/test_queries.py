"""Queries against DuckDB, native against full, streams."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillsieve.functions import layers
from quillsieve.functions.settings import checked
from quillsieve.operators import findings, native
from quillsieve.operators.clean import clean
from quillsieve.plans import casebook, catalog  # noqa: F401
from quillsieve.streaming import live

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(map(repr, (tuple(r) for r in df.select(columns).collect())))
    if name in catalog.SQL:
        other = duck.sql(catalog.SQL[name])
        assert sorted(other.columns) == columns
        assert mine == sorted(map(repr, other.select(*[f'"{c}"' for c in columns]).fetchall()))
    assert mine


def test_full_clean_covers_every_document(spark, tmp_path):
    texts = {5: "plain", 6: "so ..... and .... end", 7: None, 10: "wait....", 13: "three... only"}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.cleaned, r.changed) for r in catalog.QUERIES["full_clean"](spark, str(tmp_path)).collect()}
    assert got == {
        5: ("at https://x.io/?utm_source=newsletter end plain", False), 6: ("so ... and ... end", True), 7: (None, None),
        10: ("at https://x.io/ end and https://y.io/a?b=1 here wait...", True), 13: ("at https://x.io/?utm_source=newsletter end three... only", False),
    }


TEXTS = [
    None, "", "plain", "x" * 50_000, "“a” — b… .....", "a​b‌م‌ ­", "1\u00a0%\u2003 z.\u00a0B. a\u2009b \u3000 5\u202fkg\u2028x\u2029 \u2801\u2800\u2803 a\u2800b",
    "&#8203;&amp;&zwj;&#x202E;&#xE0041;&#9999999;", "pаypal Привет", "```\n“x”", "u?utm_source=openai&x=1 v?utm_source=openai",
    "א‎‪ b", "️️a️ ❤️ ᠠ᠋", "a͏b א͏",
]


def test_native_is_as_full(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")

    def full(*names, **how):
        how = checked({"layers": list(names), "normalize_form": "none", **how})
        return {i: None if t is None else layers.clean_text(t, how)[0] for i, t in enumerate(TEXTS)}

    def fast(column):
        return {r.id: r.t for r in rows.select("id", column.alias("t")).collect()}

    t = F.col("text")
    assert fast(native.decoded_entities(t)) == full("entities", protect_code=False)
    assert fast(native.plain_spaces(native.without_invisible(t))) == full("characters")
    assert fast(native.outside_code(t, lambda p: native.punctuation(native.dashes(native.straight_quotes(p))["text"])["text"])) == full("typography")
    assert fast(native.without_tracking(t)) == full("artifacts")
    swapped = {r.id: r.text for r in native.ascii_lookalikes(rows, "text").collect()}
    assert swapped == full("homoglyphs", replace_homoglyphs=True)


def test_clean_keeps_columns_and_nulls(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "a​", "y"), (2, "a​", "y")], "id int, text string, cleaned string")
    done = clean(rows)
    assert done.columns == ["id", "text", "cleaned", "cleaned_", "report"]
    got = done.orderBy("id").collect()
    assert got[0].cleaned_ is None and got[0].report is None and got[1].cleaned_ == "a" and len(got) == 3
    assert clean(rows.limit(0)).count() == 0
    assert findings.gate(done).first().exit_code == 0


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a​b"), (2, "we delve into it"), (2, "we delve into it")], "doc_id long, text string").withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00"))).write.parquet(source)
    stream = live.read(spark, source, spark.read.parquet(source).schema)
    live.run_available(live.cleaned(live.once_each(stream, "doc_id", "ts")).select("doc_id", "cleaned", "report"), out, str(tmp_path / "c"))
    assert {r.doc_id: r.cleaned for r in spark.read.parquet(out).collect()} == {1: "ab", 2: "we delve into it"}
    query = live.windowed_summary(live.cleaned(stream), "ts").writeStream.format("memory").queryName("summed").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    row = spark.sql("SELECT * FROM summed").first()
    assert (row.files, row.changed, row.blocked) == (3, 1, 2)


def test_sql_names(spark):
    from quillsieve.functions.registry import register

    register(spark)
    row = spark.sql("SELECT clean_text(t) AS c, text_findings(t) AS f, text_phrases(t) AS p, clean_text(CAST(NULL AS STRING)) AS n FROM (SELECT 'a“b” we delve into it' AS t)").first()
    assert row.c == 'a"b" we delve into it' and '"smart-quote"' in row.f and row.p.startswith("[[8, 18") and row.n is None


def test_merged_goes_through_texts_once(spark):
    rows = spark.createDataFrame([(1, "We delve into it. `x` We dive deep, delve."), (1, "We dive into it."), (None, "Moreover, we delve into it."), (2, "plain")], "k long, text string")
    made = findings.merged(findings.exploded(clean(rows, settings={"layers": ["voice"]}), "k"), "k")
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {(r.k, r.kind): (r.severity, r["count"], r.ord, r.examples, dict(r.by_rule)) for r in made.collect()}
    assert got == {
        (1, "banned-phrase"): ("error", 3, 0, ["delve into", "dive into", "dive deep"], {"delve into": 1, "dive into": 1, "dive deep": 1}), (1, "lexicon"): ("warn", 2, 1, ["delve"], {"delve": 2}),
        (None, "banned-phrase"): ("error", 1, 0, ["delve into"], {"delve into": 1}), (None, "lexicon"): ("warn", 2, 1, ["delve", "moreover"], {"delve": 1, "moreover": 1}),
    }
    assert made.columns == ["k", "layer", "kind", "severity", "message", "count", "ord", "examples", "by_rule"]
    none = spark.createDataFrame([(1, "a", "b", "warn", "m", 2, 0, None, None)], "k int, layer string, kind string, severity string, message string, count long, ord int, examples array<string>, by_rule map<string,bigint>")
    (row,) = findings.merged(none, "k").collect()
    assert (row["count"], row.ord, row.examples, row.by_rule) == (2, 0, [], {})


def test_phrases_are_counted_where_their_words_stand(spark):
    texts = [None, "", "We DELVE INTO it, delve  into, delveinto", "9delve into", "ſhed light on", "it\u2019s worth noting it's worth noting", "MA\u1e9eGESCHNEIDERT nahtlos", "\u212aey takeaways", "\u0130ndeed ındeed indeed_", "that said", "said that", "game-changer,game-changer"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    t = F.col("text")
    done = rows.select("id", native.total(t, native.banned_patterns()).alias("b"), native.total(t, native.lexicon_patterns()).alias("w"))
    assert "(?iu)(?:" not in done._jdf.queryExecution().optimizedPlan().toString()  # no pattern of all phrases is tried on every text
    one = lambda patterns: sum(F.coalesce(F.regexp_count(t, F.lit(p)), F.lit(0)) for p in patterns.values())
    whole = {r.id: (r.b, r.w) for r in rows.select("id", one(native.banned_patterns()).alias("b"), one(native.lexicon_patterns()).alias("w")).collect()}
    got = {r.id: (r.b, r.w) for r in done.collect()}
    assert got == whole and [got[i][0] for i in (2, 4, 5, 7, 11)] == [2, 1, 2, 1, 2] and got[8][1] == 2 and got[6][1] == 2


def test_workers_hold_pieces_of_batches():
    import pyarrow as pa

    from quillsieve.operators import clean as cleaner
    from quillsieve.operators import hits
    from quillsieve.shipping import PIECE, pieces

    texts = [None, "x" * (PIECE + 5), "", *["ab " * 100_000] * 9, None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["text", "k"])
    how = checked({"layers": ["voice"]})
    for run in (lambda b: pieces(b), cleaner._clean(how, None, ["cleaned", "report"]), hits._rows(hits._hits, how, hits.HIT_ARROW)):
        made = list(run(iter([batch, batch.slice(3, 4), batch.slice(0, 0)])))
        assert [k for b in made for k in b.column("k").to_pylist()] == [*range(len(texts)), 3, 4, 5, 6] and max(b.num_rows for b in made) == 4


def test_stream_is_read_as_the_table_is(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"a​{i}" if i % 5 else None) for i in range(400)], "doc_id long, text string")
    rows.repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a part for each file
    try:
        done = casebook.stream_clean(spark, str(tmp_path))
        made = {r.f for r in done.select(F.input_file_name().alias("f")).collect()}
        assert {r.doc_id: r.cleaned for r in done.collect()} == {i: f"a{i}" for i in range(400) if i % 5} and len(made) == 9
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
