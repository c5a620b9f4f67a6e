"""Document fingerprints by winnowing, with DataFrame operations only.

Words are hashed to 31 bits, every run of `k` words to a Karp-Rabin polynomial of its word
hashes, and of each `window` runs in a row the least hash is kept, the rightmost where hashes tie.
A fingerprint holds the kept hashes with the position (word number) of their run. Two texts that
share k + window - 1 words in a row share a hash; nothing shorter than k words matches.

The polynomials and the window minima are built by doubling: each array of runs of 1, 2, 4, ...
words comes from the one before, so the cost a word doesn't grow with k or window by more than
their logarithm, and nothing is gathered from other rows.

Defined results: a null text counts as empty; a text without words has the empty fingerprint; one
of fewer than k words is one run; equal texts have equal fingerprints; two empty fingerprints
have likeness 1, an empty one and another 0; repeated rows follow each other; an empty table gives
an empty table. In a text without blanks there is one word, so its likeness to another is 0 or 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh, id_ranges, literal_array

K = 5
WINDOW = 4
PRIME = (1 << 31) - 1
BASE = 1_000_003
POSITIONS = 1 << 31


def _power(n: int) -> int:
    return pow(BASE, n, PRIME)


def _parts(n: int) -> list[int]:
    """Powers of two, falling, whose sum is n."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _pairs(xs: Column, shift: int, join) -> Column:
    """join(x[i], x[i + shift]) for every i that has both."""
    return F.when(F.size(xs) > shift, F.zip_with(F.slice(xs, F.lit(1), F.greatest(F.size(xs) - shift, F.lit(0))), F.slice(xs, F.lit(shift + 1), F.size(xs)), join)).otherwise(F.slice(xs, F.lit(1), F.lit(0)))


def _sized(join, n: int):
    return lambda a, b: join(a, b, n)


def _doubled(df: DataFrame, column: str, n: int, join) -> DataFrame:
    """Turns an array of values of runs of 1 into one of runs of n. join(left, right, length of right)."""
    stages, size, start = {1: column}, 1, len(df.columns)
    names = iter(fresh(df, *(f"{column}_{i}" for i in range(2 * n.bit_length() + 2))))
    while size * 2 <= n:
        made = next(names)
        df = df.withColumn(made, _pairs(F.col(stages[size]), size, _sized(join, size)))
        size *= 2
        stages[size] = made
    parts = _parts(n)
    have, at = stages[parts[0]], parts[0]
    for p in parts[1:]:
        made = next(names)
        left, right = F.col(have), F.slice(F.col(stages[p]), F.lit(at + 1), F.size(stages[p]))
        m = F.least(F.size(left), F.greatest(F.size(stages[p]) - at, F.lit(0)))
        df = df.withColumn(made, F.zip_with(F.slice(left, F.lit(1), m), F.slice(right, F.lit(1), m), _sized(join, p)))
        have, at = made, at + p
    return df.withColumn(column, F.col(have)).drop(*df.columns[start:])


def fingerprints(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds `out`: the fingerprint, an array of longs: hash * 2^31 + (2^31 - 1 - position), by position."""
    w, h, c = fresh(df, f"{out}_w", f"{out}_h", f"{out}_c")
    word = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), f"[{SPACE}]+"), lambda x: x != "")
    df = df.withColumn(w, F.transform(word, lambda x: F.xxhash64(x).bitwiseAND(F.lit(PRIME)) % PRIME))
    df = df.withColumn(h, F.col(w))
    df = _doubled(df, h, k, lambda a, b, n: (a * _power(n) + b) % PRIME)
    short = F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(F.array(F.aggregate(F.col(w), F.lit(0).cast("long"), lambda a, x: (a * BASE + x) % PRIME)))
    df = df.withColumn(h, F.when(F.size(w) < k, short).otherwise(F.col(h)))
    # Least hash first, then the rightmost: one number orders both.
    df = df.withColumn(c, F.transform(F.col(h), lambda x, i: x * POSITIONS + (POSITIONS - 1 - i)))
    df = df.withColumn(w, F.col(c))
    df = _doubled(df, c, window, lambda a, b, n: F.least(a, b))
    whole = F.when(F.size(w) == 0, F.col(w)).otherwise(F.array(F.array_min(w)))
    return df.withColumn(out, F.when(F.size(w) < window, whole).otherwise(F.array_distinct(c))).drop(w, h, c)


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 31)))


def rendered(fingerprint: Column) -> Column:
    """hash:position of each, comma-joined; hashes in hex."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit(":"), (F.lit(POSITIONS - 1) - x.bitwiseAND(F.lit(POSITIONS - 1))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two arrays of distinct hashes (Jaccard)."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def with_next(docs: DataFrame, id_col: str, text: str, prepare, carried: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """prepare(docs), with columns of the following row for each c in `carried`, and the names these have (next_<c> if free).

    The following row is the one next in ascending order of id; after the last comes the first.
    Rows of one id follow each other by text, a null id comes first. Ids are cut into ranges at
    approximate quantiles, each a task of its own, and the first row of each range is also sent
    to the range before, so the text moves once and no order over all rows is needed. prepare
    runs after that move.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, copy, wraps, own = fresh(docs, "range_no", "range_copy", "range_wraps", "range_own")
    key = F.col(id_col)
    place, ranges = id_ranges(docs, id_col, 2 * tasks)
    heads = sorted(docs.select(place.alias("part"), key.alias("id")).groupBy("part").agg(F.min(F.struct("id")).alias("head")).collect())  # one row a range
    rows = docs.withColumn(own, place)
    copies = F.array(F.struct(F.col(own).alias("p"), F.lit(0).alias("w")))
    if heads:
        first, to = [0] * ranges, [0] * ranges
        for i, r in enumerate(heads):
            first[r.part], to[r.part] = 0 if r.head.id is None else r.head.id, heads[i - 1].part
        least = F.get(literal_array(first, docs.schema[id_col].dataType.simpleString()), F.col(own))
        if heads[0].head.id is None:
            least = F.when(F.col(own) == heads[0].part, F.lit(None)).otherwise(least)
        again = F.struct(F.get(literal_array(to, "int"), F.col(own)).alias("p"), (F.col(own) == heads[0].part).cast("int").alias("w"))
        copies = F.when(key.eqNullSafe(least), F.array(F.element_at(copies, 1), again)).otherwise(copies)
    rows = rows.select("*", F.posexplode(copies).alias(wraps, copy))
    rows = rows.withColumn(part, F.col(f"{copy}.p")).drop(own).repartitionById(ranges, F.col(part))
    rows = prepare(rows)
    order = Window.partitionBy(part).orderBy(F.col(f"{copy}.w"), key.asc_nulls_first(), F.col(text).asc_nulls_first())
    new = dict(zip(carried, fresh(rows, *(f"next_{c}" for c in carried)), strict=True))
    (following,) = fresh(rows, "following")
    rows = rows.withColumn(following, F.lead(F.struct(*carried)).over(order)).where(F.col(wraps) == 0)
    return rows.withColumns({new[c]: F.col(f"{following}.{c}") for c in carried}).drop(part, copy, wraps, following), new


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness of both and of the next text's."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def prepare(rows: DataFrame) -> DataFrame:
        return fingerprints(rows, "text", "fp", k, window).withColumn("hs", hashes(F.col("fp")))

    rows, _ = with_next(base, "doc_id", "text", prepare, ["text", "hs"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    moved = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - moved).cast("int")), F.substring("next_text", F.lit(1), moved)))
    rows = fingerprints(rows, "edited", "edited_fp", k, window)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        rendered(F.col("fp")).alias("fingerprint"),
        rendered(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("hs"), hashes(F.col("edited_fp"))).alias("near_edited"),
        likeness(F.col("hs"), F.col("next_hs")).alias("near_next"),
    )
