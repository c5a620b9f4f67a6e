"""Chat formatting by rotation of perspectives.

For every participant of a conversation the dialogue is rendered once, with that participant as
the assistant and all others as named users; only the participant's own words are trained on. A
conversation of three gives three training dialogues. System turns are nobody's: they stay system
turns in every perspective.

Turns are placed first, so that a conversation of any length is rendered without being gathered:
lengths are summed over blocks of turns, then within blocks. dialogues() joins the placed turns to
texts, of at most `BLOCK` turns each; almost all dialogues are one text.

Defined results: a null role is the participant with the empty name, a null text is empty; turns of
one number are ordered by role, then by the digest of their text; a turn without a number comes
before all with one, by the digest of its role and text; turns without a conversation have none in
common, so each different one is a conversation (whose id is null); repeated rows are repeated
turns; control characters and line breaks in a name become blanks and "<|" in a text or name
becomes "< |", so none can forge a header or marker; a conversation of system turns alone has no
perspective; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
SYSTEM = "system"
TAIL = "<|im_end|>\n"
FIRST = -(1 << 60)  # the blocks of turns without a number begin here
BREAKS = "[\\x{0}-\\x{1F}\\x{7F}-\\x{9F}\\x{2028}\\x{2029}]"


def _placed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A row for each turn of each perspective, with its conversation key k and its block of turns."""
    clean = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.regexp_replace(clean(role_col), BREAKS, " ").alias("speaker"), clean(text_col).alias("words"))
    rows = rows.withColumn("digest", F.md5("words"))
    alone = F.md5(F.concat("speaker", F.lit("\n"), F.col("digest")))
    # Keys without nulls: joins and windows then share one partitioning, and the texts move once.
    rows = rows.withColumn("k", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.concat(F.lit("#"), F.coalesce(F.col("turn").cast("string"), F.lit("")), F.lit("#"), alone)))
    unnumbered = F.lit(FIRST) + F.conv(F.substring(alone, 1, 3), 16, 10).cast("long")
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), unnumbered))
    rows = rows.withColumn("digest", F.when(F.col("turn").isNull(), alone).otherwise(F.col("digest")))
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    head = F.concat(F.lit("<|im_start|>"), role, F.when(role == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(F.lit("")), F.lit("\n"))
    # Lengths by speaker and block are a few numbers; from them comes where each block begins.
    sums = rows.groupBy("k", "block", "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("words")).alias("chars"))
    who = sums.where(F.col("speaker") != SYSTEM).select("k", F.col("speaker").alias("perspective")).distinct()
    blocks = sums.join(who, "k").groupBy("k", "block", "perspective").agg(F.sum(F.col("n") * (F.length(head) + len(TAIL)) + F.col("chars")).alias("size"))
    before = Window.partitionBy("k", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("k", "block", "perspective", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    seen = rows.join(blocks, ["k", "block"]).withColumn("head", head).withColumn("role", role)
    seen = seen.withColumn("segment", F.concat("head", "words", F.lit(TAIL)))
    size = F.length("segment").cast("long")
    by_number = [F.col("turn").asc_nulls_first(), F.when(F.col("turn").isNotNull(), F.col("speaker")), "digest"]
    inside = Window.partitionBy("k", "block", "perspective").orderBy(*by_number)
    seen = seen.withColumn("start", F.col("base") + F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("end", F.col("start") + size)
    mine = F.col("role") == "assistant"
    trained = {"trained_start": F.when(mine, F.col("start") + F.length("head")), "trained_end": F.when(mine, F.col("end") - 1)}
    return seen.withColumns({"piece": F.floor((F.row_number().over(inside) - 1) / BLOCK)} | trained)


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, turn, role, name, segment, start, end, trained_start, trained_end; the last two null where nothing is trained.

    Offsets are code points in the dialogue of that perspective, ends exclusive; what is trained
    are the words and the end marker.
    """
    placed = _placed(turns, conv_col, turn_col, role_col, text_col)
    return placed.select("conv_id", "perspective", "turn", "role", F.col("speaker").alias("name"), "segment", "start", "end", "trained_start", "trained_end")


def dialogues(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, start, n_turns, text, trained: the rendered dialogues.

    A dialogue of more than BLOCK turns is several rows; start is where a row's text begins in the
    whole. trained is an array of struct(start, end), offsets in the whole dialogue.
    """
    rows = F.array_sort(F.collect_list(F.struct("start", "end", "segment", "trained_start", "trained_end")))  # of at most BLOCK turns
    made = _placed(turns, conv_col, turn_col, role_col, text_col).groupBy("k", "block", "perspective", "piece").agg(F.first("conv_id").alias("conv_id"), rows.alias("rows"))
    trained = F.filter(F.transform("rows", lambda r: F.struct(r["trained_start"].alias("start"), r["trained_end"].alias("end"))), lambda s: s["start"].isNotNull())
    return made.select("conv_id", "perspective", F.col("rows")[0]["start"].alias("start"), F.size("rows").cast("long").alias("n_turns"), F.array_join(F.transform("rows", lambda r: r["segment"]), "").alias("text"), trained.alias("trained"))
