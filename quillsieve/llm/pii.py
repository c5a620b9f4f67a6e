"""Personal data in texts, with DataFrame operations only.

Regular expressions propose spans, checksums and value ranges confirm them (Luhn for cards,
mod-97 for IBANs, 255 for the parts of an address), and words nearby adjust a score. The base
kinds email, ip, card and phone stay once confirmed, whatever their score. The further kinds need
a score of `threshold`: iban (confirmed by mod-97), and tel, a number written without a plus
sign, and secret, a run of letters and digits such as a key (confirmed by having three of either),
which only context makes personal.

Offsets are code points, the end exclusive. They come from the lengths of the pieces between and
in the matches of one pattern. Patterns are written so that a match can only start where a run of
its characters starts, with possessive loops: this finds what the plain patterns find, leftmost
and without overlap, in time linear in the text and without recursion. Of an IBAN only the first
four characters are matched: it ends at its country's length, whatever follows a blank after it,
and where no length is known, at the longest whole word up to which mod-97 holds.

Defined results: a null text counts as empty; a text without matches has no spans; spans of two
kinds may overlap, and of those with one start the kind listed first comes first; repeated rows are
searched each on their own; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, prefix_sums

NEAR = 48  # code points before and after a span that count as its context
THRESHOLD = 0.6
#: ISO 13616 registry: characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
REACH = NEAR + 67  # code points after a match that are looked at: the longest IBAN with its blanks, and its context
PIECES = REACH // 3 + 1  # a match and the gap before the next have 3 code points at least


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    guard: str  # a pattern each text with a match contains
    literal: str | None  # or a string it contains
    score: float
    context: str  # words that raise the score
    base: bool = True


LOCAL = "A-Za-z0-9._%+-"
KEY = "A-Za-z0-9+/_-"
KINDS = (
    Kind("email", f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "", "@", 0.9, "mail|contact|write"),
    Kind("ip", "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "[0-9]\\.[0-9]", None, 0.6, "\\bip\\b|address|host|server"),
    Kind("card", "(?<![0-9])[0-9](?:[\\x20-]?[0-9])++", "[0-9](?:[\\x20-]?[0-9]){11}", None, 0.8, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "\\+[0-9]", None, 0.7, "phone|tel|call|mobile|fax|handy|m[oó]vil"),
    Kind("iban", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\\x20?[A-Z0-9]){11})", "[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11}", None, 0.7, "iban|account|bank|konto|compte|cuenta", False),
    Kind("tel", "(?<![+0-9A-Za-z.-])(?<!\\+[0-9]{1,3}[\\x20.-])\\(?[0-9]{2,5}\\)?[\\x20./-][0-9]{3,4}[\\x20.-]?[0-9]{3,5}(?!\\x20?[0-9])(?![A-Za-z])", "[0-9]{2}\\)?[\\x20./-][0-9]{3}", None, 0.3, "phone|\\btel|call|mobile|fax|handy|m[oó]vil", False),
    Kind("secret", f"(?<![={KEY}])[{KEY}]{{20,}}+={{0,2}}+(?![={KEY}])", f"[{KEY}]{{20}}", None, 0.4, "token|secret|passw|passphrase|api[\\x20_-]?key|access[\\x20_-]?key|private[\\x20_-]?key|credential|bearer|\\bauth", False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def iban_ok(text: Column) -> Column:
    """ISO 13616: the first four characters go to the end, letters count 10 to 35, the number mod 97 is 1."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    step = lambda acc, c: (acc * F.when(c >= "A", F.lit(100)).otherwise(F.lit(10)) + F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)) % 97
    return F.length(plain).between(15, 34) & (F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1)


def iban_at(text: Column) -> Column:
    """The IBAN that a text starts with, blanks included; empty if there is none."""
    body, end = "[0-9]{2}(?:\\x20?[A-Z0-9])", "(?![A-Za-z0-9])"
    listed = "|".join(f"(?:{codes.replace(' ', '|')}){body}{{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
    known = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    other = [F.regexp_extract(text, f"^[A-Z]{{2}}{body}{{{n - 4}}}{end}", 0) for n in range(34, 14, -1)]
    longest = F.get(F.filter(F.array(*other), iban_ok), F.lit(0))
    return F.when(text.rlike(f"^(?:{known})"), F.regexp_extract(text, f"^(?:{listed}){end}", 0)).otherwise(F.coalesce(longest, F.lit("")))


def confirmed(kind: Kind, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind.name == "ip":
        return match.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind.name == "card":
        return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind.name in ("phone", "tel"):
        return F.length(digits).between(9 if kind.base else 7, 15)
    if kind.name == "iban":
        return iban_ok(match)
    if kind.name == "secret":
        return (F.length(digits) >= 3) & (F.length(F.regexp_replace(match, "[^A-Za-z]", "")) >= 3)
    return F.lit(True)


def _found(gaps: str, near: str):
    """Turns match i into its text and the text around; gaps holds the text before each match, near what stands around each. start counts from the match before."""

    def found(hit: Column, i: Column) -> Column:
        gap = F.get(F.col(gaps), i)
        texts = lambda start, n, side: F.array_join(F.transform(F.slice(F.col(near), start, n), lambda x: x[side]), "")
        earlier = F.when(i > 0, texts(F.greatest(i - PIECES + 1, F.lit(1)), F.least(i, F.lit(PIECES)), "before")).otherwise(F.lit(""))
        before = F.right(F.concat(earlier, F.right(gap, F.lit(NEAR))), F.lit(NEAR))
        later = texts(i + 2, F.lit(PIECES), "after")
        after = F.left(F.concat(F.left(F.get(F.col(gaps), i + 1), F.lit(REACH)), F.when(i + 1 < F.size(near), later).otherwise(F.lit(""))), F.lit(REACH))
        return F.struct(F.length(gap).alias("start"), hit.alias("hit"), before.alias("before"), after.alias("after"))

    return found


def _whole(x: Column) -> Column:
    """The match of an IBAN's head as one of the IBAN."""
    ahead = F.concat(x["hit"], x["after"])
    hit = iban_at(ahead)
    return F.struct(x["start"].alias("start"), hit.alias("hit"), x["before"].alias("before"), F.substr(ahead, F.length(hit) + 1).alias("after"))


def _judge(kind: Kind, rank: int):
    """Turns what _found gives into a span."""

    def span(x: Column) -> Column:
        score = F.lit(kind.score) + F.when(F.lower(F.concat(x["before"], F.lit("\n"), F.left(x["after"], F.lit(NEAR)))).rlike(kind.context), F.lit(0.3)).otherwise(F.lit(0.0))
        score = F.when(confirmed(kind, x["hit"]), score).otherwise(F.lit(-1.0))
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (x["start"] + F.length(x["hit"])).alias("end"), score.alias("score"))

    return span


def _at_least(least: float):
    return lambda span: span["score"] >= least


def spans(df: DataFrame, text_col: str, out: str, kinds: tuple[Kind, ...] = KINDS, threshold: float = THRESHOLD) -> DataFrame:
    """Adds `out`: array of struct(start, rank, kind, end, score), by start, then kind as listed."""
    (text,) = fresh(df, f"{out}_text")
    df = df.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    made = []
    for rank, kind in enumerate(kinds):
        parts, gaps, hits, starts, near = fresh(df, *(f"{out}_{kind.name}_{x}" for x in ("parts", "gaps", "hits", "starts", "near")))
        has = F.contains(F.col(text), F.lit(kind.literal)) if kind.literal else F.col(text).rlike(kind.guard)
        pair = F.struct(F.split(F.col(text), kind.pattern, -1).alias("gaps"), F.regexp_extract_all(F.col(text), F.lit(kind.pattern), F.lit(0)).alias("hits"))
        df = df.withColumn(parts, F.when(has, pair))
        df = df.withColumn(gaps, F.col(f"{parts}.gaps")).withColumn(hits, F.col(f"{parts}.hits"))
        lengths = F.zip_with(gaps, hits, lambda g, h: (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("long"))
        df = df.withColumn(starts, F.when(F.size(hits) > 0, prefix_sums(lengths)))

        df = df.withColumn(near, F.transform(hits, lambda h, j: F.struct(F.right(F.concat(F.get(F.col(gaps), j), h), F.lit(NEAR)).alias("before"), F.left(F.concat(h, F.get(F.col(gaps), j + 1)), F.lit(REACH)).alias("after"))))  # noqa: B023

        # starts is an argument and not used within the function, where it might be computed for each match.
        found = F.zip_with(F.transform(hits, _found(gaps, near)), F.slice(starts, F.lit(1), F.size(hits)), lambda x, s: x.withField("start", s + x["start"]))
        found = F.transform(found, _whole) if kind.name == "iban" else found
        least = 0.0 if kind.base else threshold
        df = df.withColumn(starts, F.filter(F.transform(found, _judge(kind, rank)), _at_least(least)))
        df = df.drop(parts, gaps, hits, near)
        made.append(starts)
    nothing = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>")
    return df.withColumn(out, F.array_sort(F.concat(*[F.coalesce(F.col(c), nothing) for c in made]))).drop(text, *made)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, counts of the base kinds, a digest of the base spans, all spans, their number, and the score of each in hundredths."""
    rows = spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "found")
    count = lambda name: F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    scores = F.array_join(F.transform("found", lambda s: F.round(100 * s["score"]).cast("int").cast("string")), ",")
    return rows.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"), scores.alias("scores"))
