"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents are sets of word shingles. Equal sets become one class; the smallest row of a class is
its node. Each node has a signature of `bands * rows` minima, and nodes that agree in a band are
candidates. A candidate pair's signatures are compared batch by batch: after m matches of n the
posterior of its similarity (flat prior) is Beta(m + 1, n - m + 1), and the pair goes once the
chance that it reaches the threshold falls below `miss`. Survivors are verified on full sets.

Groups stay whole without listing their pairs. First every node is compared with one node alone,
the least of most of its buckets (its pivot); the links give components. Then only buckets that
still hold several components are searched, for pairs across components, in blocks of bounded
size: members of a bucket's largest component meet only those outside it, and a pair meets in the
first band it shares. A block first passes on, by signatures alone, the nodes that have a pair
left; those meet again with their texts, and the block gives no more links than join its nodes.
So what is written grows with the nodes in blocks, never with their pairs, and as every pair
across components is tested, each component is the same as all links would give.

Defined results: words are runs without blanks, with A-Z in lower case; a text with fewer words
than a shingle is one shingle; without words or with a null text the set is empty and linked with
nothing, so its row stays; a null id comes after all others; rows of one id and text are one
class, of which one row stays; an empty table gives an empty table; other columns pass through.

The chance that no band holds a pair of similarity 0.8 is (1 - 0.8**5)**32 = 3e-6.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import ragged
from .common import fresh, scratch, small, staged
from .exact_dedup import heavy_hitters

BANDS, ROWS = 32, 5
BATCH = 32
MISS = 1e-6
BLOCK = 1024  # nodes of a bucket that are compared with as many others in one step
SHINGLES = 1 << 20  # or nodes of so many shingles together

_rng = np.random.default_rng(20_240_611)
TURN = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
FACTOR = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


# --- sets and signatures ------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = ragged.utf8(texts)
    for i, j in ragged.chunks(offsets):
        part, at = ragged.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = ragged.words(part, at)
        h = ragged.span_hashes(part, starts, ends)
        n = len(h)
        run = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width if n >= width else 0):
            run += h[k : n - width + 1 + k] * PLACE[k]
        run = ragged.mixed(run)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(run[a : b - width + 1])
            elif b > a:
                yield ragged.mixed(np.array([(h[a:b] * PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield h[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(len(TURN), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(out, ((low[i : i + 2048] ^ TURN) * FACTOR).min(0), out=out)
    return out


def _sign(width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, signatures = [], [], []
            for s in shingle_sets(batch.column(0), width):
                n.append(len(s))
                keys.append(np.array([ragged.mixed(s ^ PLACE[-1]).sum(), ragged.mixed(s ^ PLACE[-2]).sum() + np.uint64(len(s))], np.uint64).tobytes() if len(s) else None)
                signatures.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], [*batch.schema.names[1:], *names])

    return run


# --- the sequential test ------------------------------------------------------------------------


def least_matches(threshold: float, miss: float = MISS, batch: int = BATCH, total: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """For n = batch, 2 * batch, ...: the fewest matches with which the posterior chance of the threshold is at least `miss`.

    P(Beta(m + 1, n - m + 1) >= t) is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, total + 1, batch):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signature rows: the numbers of those that pass every batch, and their matches."""
    alive, matches, before = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in steps:
        matches = matches + (a[alive, before:n] == b[alive, before:n]).sum(1)
        good = matches >= least
        alive, matches, before = alive[good], matches[good], n
    return alive, matches


def near_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Sets whose sizes differ too much can't be alike enough."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint32).reshape(len(column), -1)


def _prune(steps: list[tuple[int, int]], percent: int):
    """Rows pivot, node, side, size, sig in runs of one pivot, itself first (side 0): the pairs that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            pivot, node, side, size = (batch.column(i).to_numpy() for i in range(4))
            sig = _rows(batch.column(4))
            if held is not None:
                pivot, node, side, size = (np.append(x, y) for x, y in zip(held[:4], (pivot, node, side, size), strict=True))
                sig = np.vstack([held[4], sig])
            at = np.maximum.accumulate(np.where(side == 0, np.arange(len(side)), 0))
            held = *(x[at[-1]] for x in (pivot, node, side, size)), sig[at[-1]][None]
            members = np.flatnonzero(side)
            members = members[near_sizes(size[at[members]], size[members], percent)]
            alive, _ = survivors(sig[at[members]], sig[members], steps)
            yield pa.RecordBatch.from_arrays([pa.array(pivot[members][alive]), pa.array(node[members][alive])], ["a", "b"])

    return run


def _verify(width: int, percent: int):
    """Rows pivot, node, side, text in runs of one pivot, itself first: the pairs whose sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for pivot, node, side, other in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), shingle_sets(batch.column(3), width), strict=True):
                if not side:
                    mine = other
                    continue
                at = np.searchsorted(mine, other)
                at[at == len(mine)] = 0
                both = int((mine[at] == other).sum())
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    a.append(pivot)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _against_pivots(pairs: DataFrame, payload: DataFrame, run: Callable) -> DataFrame:
    """Pairs (a, b) with the payload of both brought together: a pivot's members follow it, many of them in several places."""
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 2000).alias("places"))
    salted = pairs.join(hot, "a").withColumn("place", F.pmod(F.hash("b"), F.col("places")))
    sides = salted.select("a", "place", F.col("b").alias("node"), F.lit(1).alias("side"))
    sides = sides.unionByName(salted.select("a", "place", F.col("a").alias("node"), F.lit(0).alias("side")).distinct())
    rows = payload.join(small(sides, sides.count()), "node").repartition(tasks, "a", "place").sortWithinPartitions("a", "place", "side", "node")
    return rows.select("a", "node", "side", *payload.columns[1:]).mapInArrow(run, "a long, b long")


# --- pairs across components --------------------------------------------------------------------


KEYS = ("b0", "b1", "bucket")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block pair, which follow each other, as one table."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        keys = np.stack([rows[k].to_numpy() for k in KEYS])
        edges = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0), True]).tolist()
        for s, e in zip(edges[:-2], edges[1:-1], strict=True):
            yield rows.slice(s, e - s)
        held = rows.slice(edges[-2])
    if held is not None:
        yield held


def _partners(rows: pa.Table, steps: list[tuple[int, int]], percent: int, a_band: int, joined: Callable[[int], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each row of a block pair: the later rows (of the other half, if there are two) that pass the test with it and meet it in no earlier band.

    a_band: rows of the signature in a band. joined gives the present components of the rows;
    pairs within one are left out.
    """
    half, band, size = (rows[c].to_numpy() for c in ("half", "band", "size"))
    sig = _rows(rows["sig"].combine_chunks())
    one, two = np.flatnonzero(half == 0), np.flatnonzero(half == 1)
    for k, i in enumerate(one.tolist()):
        rest = two if len(two) else one[k + 1 :]
        comp = joined(i)
        rest = rest[(comp[rest] != comp[i]) & near_sizes(size[rest], size[i], percent)]
        if len(rest):
            passed, _ = survivors(np.broadcast_to(sig[i], (len(rest), sig.shape[1])), sig[rest], steps)
            rest = rest[passed]
            same = (sig[rest] == sig[i])[:, : BANDS * a_band].reshape(len(rest), BANDS, a_band).all(2)
            rest = rest[same.argmax(1) == band[i]]
            if len(rest):
                yield i, rest


def _active(steps: list[tuple[int, int]], percent: int, a_band: int):
    """Rows of block pairs: those that have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            comp, keep = rows["comp"].to_numpy(), np.zeros(rows.num_rows, bool)
            for i, partners in _partners(rows, steps, percent, a_band, lambda _, comp=comp: comp):
                keep[i] = keep[partners] = True
            if keep.any():
                yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _link(width: int, steps: list[tuple[int, int]], percent: int, a_band: int):
    """Rows of block pairs with texts: links (a, b) that join what all links between partners join, verified on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            node, comp = rows["node"].to_numpy(), rows["comp"].to_numpy().copy()
            sets = list(shingle_sets(rows["text"].combine_chunks(), width))
            a, b = [], []
            for i, partners in _partners(rows, steps, percent, a_band, lambda _, comp=comp: comp):
                mine, sizes = sets[i], np.array([len(sets[j]) for j in partners])
                every = np.concatenate([sets[j] for j in partners])
                at = np.searchsorted(mine, every)
                at[at == len(mine)] = 0
                both = np.add.reduceat((mine[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
                for j in partners[100 * both >= percent * (len(mine) + sizes - both)].tolist():
                    if comp[j] != comp[i]:
                        comp[comp == comp[j]] = comp[i]
                        a.append(node[i])
                        b.append(node[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, comp of every node that has an edge (a, b); comp is the least node reachable.

    Each round every node points to its least neighbour, pointers are followed once, and edges
    are redrawn between what is pointed to, so long chains shrink by half or more.
    """
    with scratch() as keep:
        edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
        whole = None
        while True:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            to = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
            far = to.select(F.col("a").alias("to"), F.col("to").alias("far"))
            to = staged(to.join(far, "to", "left").select("a", F.coalesce("far", "to").alias("to")), "pointers")
            if whole is None:
                whole = to
            else:
                whole = whole.join(to.select(F.col("a").alias("to"), F.col("to").alias("far")), "to", "left").select("a", F.coalesce("far", "to").alias("to"))
                whole = staged(whole, "pointers")
            left, right = to.select("a", F.col("to").alias("x")), to.select(F.col("a").alias("b"), F.col("to").alias("y"))
            edges = edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            edges = staged(edges, "edges")
            if edges.isEmpty():
                return keep(whole).select(F.col("a").alias("node"), F.col("to").alias("comp"))


def links(sigs: DataFrame, texts: DataFrame, width: int, percent: int, miss: float) -> DataFrame:
    """sigs: node, size, sig; texts: node, text. Edges (a, b) that connect what all links of at least `percent` connect."""
    spark = sigs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = least_matches(percent / 100, miss)
    width_of = 4 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width_of + 1, F.lit(width_of))))
    banded = sigs.select("node", "size", F.posexplode(bands).alias("band", "bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = staged(banded.join(buckets, "bucket"), "buckets")
    votes = shared.where("node <> pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("node").agg(F.max(F.struct("votes", (-F.col("pivot")).alias("pivot"))).alias("best"))
    pairs = best.select((-F.col("best.pivot")).alias("a"), F.col("node").alias("b"))
    pruned = staged(_against_pivots(staged(pairs, "pairs"), sigs, _prune(steps, percent)), "pairs")
    found = staged(_against_pivots(pruned, texts, _verify(width, percent)), "links")
    marked = staged(shared.join(components(found), "node", "left").select("bucket", "band", "node", "size", F.coalesce("comp", "node").alias("comp")), "marked")
    # In each open bucket all but its largest component are strays; only pairs with a stray can be new.
    sized = marked.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    open_ = sized.groupBy("bucket").agg(F.max(F.struct("n", "comp", "shingles")).alias("most"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    pieces = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, shingles / SHINGLES)).cast("int")
    open_ = open_.select("bucket", F.col("most.comp").alias("largest"), pieces(F.col("n") - F.col("most.n"), F.col("shingles") - F.col("most.shingles")).alias("strays"), pieces(F.col("most.n"), F.col("most.shingles")).alias("others"))
    rows = marked.join(open_, "bucket")
    stray, spread = F.col("comp") != F.col("largest"), F.hash("node")
    rows = rows.withColumn("mine", F.when(stray, F.pmod(spread, F.col("strays"))).otherwise(F.col("strays") + F.pmod(spread, F.col("others"))))
    meets = F.when(stray, F.col("strays") + F.col("others")).otherwise(F.col("strays"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), meets - 1)).alias("other"))
    rows = rows.select(F.least("mine", "other").alias("b0"), F.greatest("mine", "other").alias("b1"), "bucket", "band", (F.col("mine") > F.col("other")).cast("int").alias("half"), "node", "comp")
    brought = lambda some: some.repartition(tasks, *KEYS).sortWithinPartitions("bucket", "b0", "b1", "half", "node")
    columns = [*KEYS, "band", "half", "node", "comp", "size", "sig"]
    kinds = "b0 int, b1 int, bucket long, band int, half int, node long, comp long, size long, sig binary"
    left = staged(brought(rows.join(sigs, "node").select(columns)).mapInArrow(_active(steps, percent, ROWS), kinds), "left")
    # Of the texts only those needed are moved; ids alone say which.
    needed = left.select("node").distinct()
    some = texts.join(small(needed, needed.count()), "node", "left_semi")
    left = brought(some.join(left, "node").select(*columns, "text"))
    return found.unionByName(staged(left.mapInArrow(_link(width, steps, percent, ROWS), "a long, b long"), "links"))


def grouped(docs: DataFrame, width: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS) -> DataFrame:
    """All rows and columns of docs, and a struct column (named by the result's last column): n, best (of its component: none, id, row), row."""
    ship(docs.sparkSession)
    row, n, key, sig, of = fresh(docs, "near_row", "near_n", "near_key", "near_sig", "near_of")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    names = numbered.columns
    schema = ", ".join(f"`{c}` {numbered.schema[c].dataType.simpleString()}" for c in names)
    signed = numbered.select(F.col(text_col).cast("string").alias("near_text__"), *[F.col(f"`{c}`") for c in names]).mapInArrow(_sign(width, [n, key, sig]), f"{schema}, `{n}` long, `{key}` binary, `{sig}` binary")
    with scratch() as keep:
        base = keep(staged(signed, "signed"))
        settled = keep(_settled(base, width, percent, miss, (id_col, text_col, row, n, key, sig, of)))
    return _labelled(docs, base, settled, (id_col, row, n, key, of))


def _settled(base: DataFrame, width: int, percent: int, miss: float, names: tuple[str, ...]) -> DataFrame:
    """The first row of the component of each set."""
    id_col, text_col, row, n, key, sig, of = names
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))).alias("best")
    full = base.where(F.col(key).isNotNull())
    classes = full.groupBy(key).agg(best, F.first(n).alias("size"), F.first(sig).alias("sig"))
    classes = staged(classes.select(F.col(key).alias("key"), F.col("best.row").alias("node"), "best", "size", "sig"), "classes")
    text = base.select(F.col(row).alias("node"), F.col(text_col).alias("text"))
    found = links(classes.select("node", "size", "sig"), text, width, percent, miss)
    comp = components(found)
    labelled = classes.join(comp, "node", "left").select("key", "best", F.coalesce("comp", "node").alias("comp"))
    least = labelled.groupBy("comp").agg(F.min("best").alias("best"))
    return staged(labelled.select("key", "comp").join(least, "comp").select(F.col("key").alias(key), F.col("best").alias(of)), "settled")


def _labelled(docs: DataFrame, base: DataFrame, settled: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Every row with what its set is; sets of very many rows are settled where the rows are read."""
    id_col, row, n, key, of = names
    hot = heavy_hitters(base.where(F.col(key).isNotNull()), key)
    spark = docs.sparkSession
    kinds = spark.createDataFrame([(bytearray(h),) for h in hot], f"`{key}` binary")
    few = spark.createDataFrame(settled.join(F.broadcast(kinds), key, "left_semi").collect(), settled.schema)  # at most as many as counters
    cold = base.join(F.broadcast(kinds), key, "left_anti").join(settled, key, "left")
    out = cold.unionByName(base.join(F.broadcast(few), key))
    own = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    of_all = F.struct(F.col(n).alias("n"), F.coalesce(F.col(of), own).alias("best"), F.col(row).alias("row"))
    return out.withColumn(of, of_all).select(*docs.columns, of)


def annotate(docs: DataFrame, width: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    out = grouped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), width, percent)
    of = out.columns[-1]
    return out.select("doc_id", F.col(f"{of}.n").alias("n_shingles"), F.col(f"{of}.best.id").alias("component_id"), (F.col(f"{of}.best.row") == F.col(f"{of}.row")).alias("kept"))


def dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay: the one of the least id of each component, with all columns."""
    out = grouped(docs, width, percent, id_col, text_col)
    of = out.columns[-1]
    return out.where(F.col(f"{of}.best.row") == F.col(f"{of}.row")).select(docs.columns)
