"""Parts of the cleaning layers as column expressions: they stay in the JVM and need no shuffle.

Java's regular expressions see the text as given, so one alternation with look-around decides
removals by the original neighbours. Whatever needs a callback per match works on the pieces
between matches and the matches themselves, put together again by position.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layers import ARTIFACTS, UPLOAD, protected_pattern, rarity, runs_of
from ..functions.rulebook import Rulebook, Span, bounded, coarse_class, java_class, java_word, load, phrase_body

LETTERS = "[\\p{L}\\p{Nl}\\p{No}]+"
ENTITY = "&(?:#[xX][0-9A-Fa-f]+|#[0-9]+|\\p{Alpha}\\p{Alnum}*);"
PROTECTED = protected_pattern(java=True)


def occurrences(text: Column, characters: str) -> Column:
    """How many of the characters a text holds."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def quoted(replacement: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", replacement)


def rebuilt(text: Column, pattern: str, change) -> Column:
    """The text with every match m replaced by change(m)."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(change(h), F.lit("")))), "")


# --- typography ---------------------------------------------------------------------------------


def straight_quotes(text: Column, rules: Rulebook | None = None) -> Column:
    table = (rules or load()).quotes
    return F.translate(text, "".join(table), "".join(table.values()))


def quote_count(text: Column, rules: Rulebook | None = None) -> Column:
    return occurrences(text, "".join((rules or load()).quotes))


DASH = "[\\x{2012}-\\x{2015}]"
DASHES = {"range": f"(?<=\\p{{Nd}}[ \\t]){DASH}(?=[ \\t]\\p{{Nd}})", "spaced": f"[ \\t]+{DASH}[ \\t]+", "unspaced": DASH}


def dashes(text: Column, spaced: str = ", ", unspaced: str = "-") -> Column:
    """Struct of the text with its dashes replaced, and the counts range, spaced, unspaced."""
    new = {"range": "-", "spaced": quoted(spaced), "unspaced": quoted(unspaced)}
    counts = []
    for name, pattern in DASHES.items():
        counts.append(F.regexp_count(text, F.lit(pattern)).cast("long").alias(f"n_{name}"))
        text = F.regexp_replace(text, pattern, new[name])
    return F.struct(text.alias("text"), *counts)


def punctuation(text: Column, rules: Rulebook | None = None) -> Column:
    """Struct of the text with plain marks, and how many marks and runs of dots there were."""
    table = (rules or load()).marks
    marks = occurrences(text, "".join(table))
    for mark, plain in table.items():
        text = F.replace(text, F.lit(mark), F.lit(plain))
    runs = F.regexp_count(text, F.lit("\\.{4,}")).cast("long")
    return F.struct(F.regexp_replace(text, "\\.{4,}", "...").alias("text"), marks.alias("n_marks"), runs.alias("n_runs"))


# --- characters ---------------------------------------------------------------------------------


def removal_pattern(rules: Rulebook | None = None, rtl: bool = False) -> str:
    """Everything the character layer removes, by original neighbours; rtl: bidi controls stay."""
    rules = rules or load()
    joining, emoji, hebrew = (java_class(rules.spans(k)) for k in ("joining", "emoji", "cgj-keep"))
    code = lambda kind: java_class(rules.spans(kind))
    around = lambda c, keep: f"(?<![{keep}]){c}(?![{keep}])"
    selectors = code("selector-basic") + code("selector-supplementary") + code("selector-mongolian")
    blank = " \\t\\r\\n\\f\\x0B"
    parts = [
        around(code("zwnj"), joining),
        around(code("zwj"), joining + emoji),
        around(code("cgj"), hebrew),
        f"[{java_class(rules.spans('always'))}]",
        f"[{java_class(rules.spans('range'))}]",
        f"(?:\\A|(?<=[{blank}{selectors}]))[{selectors}]",
        f"(?<![{java_class(rules.spans('ideographic'))}])[{code('selector-supplementary')}]",
        f"(?<![{java_class(rules.spans('mongolian'))}])[{code('selector-mongolian')}]",
        f"(?<=[\\p{{L}}&&[\\x{{0}}-\\x{{1FFF}}]])[{code('selector-basic')}]",
    ]
    if not rtl:
        parts.insert(3, f"[{java_class(rules.spans('bidi'))}]")
    return f"{ahead(rules.special)}(?:{'|'.join(parts)})"


def ahead(spans: list[Span]) -> str:
    """A look-ahead to one of these characters, a coarse one first: most places fail there."""
    return f"(?=[{coarse_class(spans)}])(?=[{java_class(spans)}])"


def one_of(text: Column, spans: list[Span]) -> Column:
    """Whether a text holds one of these characters."""
    return text.rlike(f"(?=[{coarse_class(spans)}])[{java_class(spans)}]")


def has_special(text: Column, rules: Rulebook | None = None) -> Column:
    return one_of(text, (rules or load()).special)


def without_invisible(text: Column, rules: Rulebook | None = None) -> Column:
    """The text without its invisible characters; texts with flag sequences must go to the full cleaner."""
    rules = rules or load()
    rtl = text.rlike(f"[{java_class(rules.spans('rtl'))}]")
    out = F.when(rtl, F.regexp_replace(text, removal_pattern(rules, True), "")).otherwise(F.regexp_replace(text, removal_pattern(rules), ""))
    return F.when(has_special(text, rules), out).otherwise(text)


def plain_spaces(text: Column, rules: Rulebook | None = None) -> Column:
    """Exotic spaces as blanks, but those that guard numbers, marks and abbreviations, or stand in braille."""
    rules = rules or load()
    latin = "A-Za-z\\xC0-\\xD6\\xD8-\\xF6\\xF8-\\x{24F}"
    spaces, guarded = (java_class(rules.spans(k)) for k in ("space", "space-guard"))
    before, after, braille = (java_class(rules.spans(k)) for k in ("guard-before", "guard-after", "braille"))
    short = f"(?<=[0-9]\\.)(?=.[{latin}])|(?:(?<=\\A[{latin}]\\.)|(?<=[^{latin}][{latin}]\\.))(?=.[{latin}]\\.)"
    guard = f"(?<=[0-9{after}])|(?=.[0-9{before}])|{short}"
    pattern = f"(?s){ahead(rules.spans('space'))}(?:(?!\\x{{2800}})[{spaces}&&[^{guarded}]]|(?!{guard})[{guarded}]|(?<![{braille}])\\x{{2800}}(?![{braille}]))"
    return F.when(one_of(text, rules.spans("space")), F.regexp_replace(text, pattern, " ")).otherwise(text)


def code_points(text: Column) -> Column:
    """The characters of a text as an array; bind it to a column before using it in a lambda."""
    return F.filter(F.split(text, ""), lambda c: c != "")


# --- entities -----------------------------------------------------------------------------------


def decoded_entities(text: Column, rules: Rulebook | None = None) -> Column:
    """Invisible characters written as references, decoded; all other references stay."""
    rules = rules or load()
    spellings: dict[str, str] = {}
    codes = [c for a, b in rules.spans("entity-code") for c in range(a, b + 1)]
    allowed = set(codes)
    for name, c in rules.entity_names.items():
        if c in allowed:
            spellings[f"&{name};"] = chr(c)
    by_code = F.create_map(*[F.lit(x) for c in codes for x in (c, chr(c))])
    by_name = F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])

    def one(m: Column) -> Column:
        digits = F.regexp_extract(m, "^&#[xX]?0*([0-9A-Fa-f]{1,7});$", 1)
        code = F.when(digits == "", F.lit(None).cast("int")).when(m.rlike("^&#[xX]"), F.conv(digits, 16, 10).try_cast("int")).otherwise(digits.try_cast("int"))
        return F.coalesce(F.try_element_at(by_name, m), F.try_element_at(by_code, code), m)

    return F.when(F.contains(text, F.lit("&")), rebuilt(text, ENTITY, one)).otherwise(text)


# --- protected regions --------------------------------------------------------------------------


def parts(text: Column) -> Column:
    """Array of struct(protected, text) of the non-empty parts of a text, in order."""
    gaps, code = F.split(text, PROTECTED, -1), F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0))
    pairs = F.zip_with(gaps, code, lambda g, c: F.array(F.struct(F.lit(False).alias("protected"), g.alias("text")), F.struct(F.lit(True).alias("protected"), F.coalesce(c, F.lit("")).alias("text"))))
    return F.filter(F.flatten(pairs), lambda p: p["text"] != "")


def outside_code(text: Column, change) -> Column:
    """The text with change(part) in place of each part that isn't protected."""
    made = F.array_join(F.transform(parts(text), lambda p: F.when(p["protected"], p["text"]).otherwise(change(p["text"]))), "")
    return F.when(text.rlike("`|~~~|\\A---"), made).otherwise(change(text))


# --- look-alike letters -------------------------------------------------------------------------


def suspicious_words(text: Column, rules: Rulebook | None = None) -> Column:
    """Words of a text that hold look-alike letters and aren't of a foreign script."""
    table = "".join((rules or load()).lookalikes)
    foreign = f"[\\x{{370}}-\\x{{52F}}&&[^{table}]]"
    latin = "[A-Za-z\\xC0-\\xD6\\xD8-\\xF6\\xF8-\\x{24F}\\x{1E00}-\\x{1EFF}]"
    # Words that hold one of them: at the start of a word, past its other letters.
    word = f"(?<!{LETTERS[:-1]})[{LETTERS[1:-2]}&&[^{table}]]*+[{table}]{LETTERS[:-1]}*+"
    mixed = F.filter(F.regexp_extract_all(text, F.lit(word), F.lit(0)), lambda w: ~w.rlike(foreign))
    # Whether the whole text holds foreign letters is asked once, not for each word.
    found = F.when(text.rlike(foreign), F.filter(mixed, lambda w: w.rlike(latin))).otherwise(mixed)
    return F.when(one_of(text, [(ord(c), ord(c)) for c in table]), found).otherwise(F.array().cast("array<string>"))


def ascii_lookalikes(df: DataFrame, text_col: str, rules: Rulebook | None = None) -> DataFrame:
    """df with the look-alike letters of suspicious words replaced. The words are bound to a column: in a lambda they would be found anew for each word."""
    rules = rules or load()
    table = rules.lookalikes
    words = "lookalike_words__"
    df = df.withColumn(words, suspicious_words(F.col(text_col), rules))
    swap = lambda w: F.when(F.array_contains(F.col(words), w), F.translate(w, "".join(table), "".join(table.values()))).otherwise(w)
    return df.withColumn(text_col, F.when(F.size(words) > 0, rebuilt(F.col(text_col), LETTERS, swap)).otherwise(F.col(text_col))).drop(words)


# --- phrases ------------------------------------------------------------------------------------


def phrase_count(text: Column, phrase: str) -> Column:
    return F.regexp_count(text, F.lit(bounded(phrase_body(phrase, True), True))).cast("long")


def word_count(text: Column, word: str) -> Column:
    return F.regexp_count(text, F.lit(java_word(word))).cast("long")


def total(text: Column, patterns: dict[str, str]) -> Column:
    """The sum of the counts of many phrases (with their patterns); one is counted only where all of its words stand.

    A phrase doesn't touch letters, so each run of letters in it is one between other characters of the text.
    """
    words = {p: sorted({m[0].lower() for m in runs_of(p)}, key=rarity, reverse=True) for p in patterns}
    needed = F.array(*[F.lit(w) for w in sorted({w for some in words.values() for w in some})])

    def counts(there: Column) -> Column:
        def count(phrase: str, pattern: str) -> Column:
            counted = F.regexp_count(text, F.lit(pattern)).cast("long")
            return F.when(reduce(and_, (F.array_contains(there, w) for w in words[phrase])), counted).otherwise(F.lit(0).cast("long")) if words[phrase] else counted

        return F.array(*[count(*x) for x in patterns.items()])

    # In an array of one, so that the words are looked for once and not for each phrase.
    found = F.flatten(F.transform(F.array(F.array_intersect(F.split(lowered(text), "[^\\p{L}]+"), needed)), counts))
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(found, F.lit(0).cast("long"), lambda a, b: a + b))


def banned_patterns(rules: Rulebook | None = None) -> dict[str, str]:
    return {p: bounded(phrase_body(p, True), True) for p in (rules or load()).banned}


def lexicon_patterns(rules: Rulebook | None = None) -> dict[str, str]:
    return {w: java_word(w) for w in (rules or load()).lexicon}


def lowered(text: Column) -> Column:
    """Lower case, with the characters that ignoring case pairs with ASCII letters as these."""
    return F.lower(F.when(text.rlike("[ıİſK]"), F.translate(text, "ıİſK", "iisk")).otherwise(text))


def shapes_present(text: Column, rules: Rulebook | None = None) -> Column:
    """Ids of the sentence shapes of a text, in the order of the rules; a shape is looked for where a word it needs stands."""
    shapes = (rules or load()).shapes

    def found(low: Column) -> Column:
        may = lambda s: reduce(or_, (F.contains(low, F.lit(w)) for w in s.needed()))
        return F.array(*[F.when(may(s) & text.rlike("(?iu)" + s.pattern(True)), F.lit(s.id)) for s in shapes])

    # In an array of one, so that the lower case is made once and not for each shape.
    return F.array_compact(F.flatten(F.transform(F.array(lowered(text)), found)))


# --- links --------------------------------------------------------------------------------------


def without_tracking(text: Column, rules: Rulebook | None = None) -> Column:
    """Links without the parameters assistants add."""
    for name, values in (rules or load()).tracking.items():
        either = "|".join(map(re.escape, values))
        pattern = f"[?&]{re.escape(name)}=(?:{either})(?=[&\\s\\x0B\\x1C-\\x1F\\x85\\p{{Z}})\\]\"'>]|\\z)&?"
        change = lambda m: F.when(m.endswith("&"), F.substring(m, 1, 1)).otherwise(F.lit(""))
        text = F.when(F.contains(text, F.lit(f"{name}=")), rebuilt(text, pattern, change)).otherwise(text)
    return text


def upload_links(text: Column) -> Column:
    return F.regexp_count(text, F.lit(UPLOAD[2])).cast("long")


def artifact_signs(text: Column) -> Column:
    """Whether a text may hold artifacts at all."""
    out = F.lit(False)
    for _, sign, _ in ARTIFACTS:
        out = out | F.contains(text, F.lit(sign))
    return out


# --- markup -------------------------------------------------------------------------------------

SVG = ("(?is)<(metadata)\\b[^>]*+>.*?</\\1>", "(?is)<x:xmpmeta\\b.*?</x:xmpmeta>", "(?s)<!--.*?-->")


def svg_hits(text: Column) -> Column:
    """Metadata, XMP packets and comments, counted on the markup as given."""
    return sum((F.regexp_count(text, F.lit(p)) for p in SVG[1:]), F.regexp_count(text, F.lit(SVG[0]))).cast("long")


def svg_stripped(text: Column) -> Column:
    for pattern in SVG:
        text = F.regexp_replace(text, pattern, "")
    return text


PDF_NEEDLES = ("<x:xmpmeta", "/C2PA_Manifest", "/Producer", "/Creator", "/Author")


def pdf_hits(content: Column) -> Column:
    """Fields of a PDF that name people or programs; null if it is no PDF."""
    text = F.decode(content, "ISO-8859-1")
    hits = sum((F.regexp_count(text, F.lit(re.escape(n))) for n in PDF_NEEDLES[1:]), F.regexp_count(text, F.lit(re.escape(PDF_NEEDLES[0]))))
    return F.when(text.startswith("%PDF"), hits.cast("long"))
