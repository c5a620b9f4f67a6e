"""The rule tables, read from text files and compiled once."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from importlib.resources import files
from pathlib import Path

HOME = files("quillsieve").joinpath("rules")  # in a folder or an archive
Span = tuple[int, int]

#: Characters that ignoring case pairs with ASCII letters, beyond what folding does.
FOLD = str.maketrans({"ı": "i", "İ": "i", "ſ": "s"})


def fold(text: str) -> str:
    """Text in which a word that a pattern finds ignoring case is found as it is."""
    return evened(text).casefold()


def evened(text: str) -> str:
    """Text without those characters; a table costs more than asking whether there are any."""
    return text.translate(FOLD) if any(chr(c) in text for c in FOLD) else text


def levelled(text: str) -> str:
    """As fold(), with a character for each of the text, for words of ASCII letters and these: äöüß."""
    return evened(text).lower()


def inside(code: int, spans: list[Span]) -> bool:
    return any(a <= code <= b for a, b in spans)


def _span(text: str) -> Span:
    a, _, b = text.partition("..")
    return int(a, 16), int(b or a, 16)


def char_class(spans: list[Span]) -> str:
    """The inner part of a character class, for Python and Java alike when given as literals."""
    return "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans)


def java_class(spans: list[Span]) -> str:
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)


def coarse_class(spans: list[Span]) -> str:
    """A class of two or three ranges that holds all of these characters: quick to test, to be asked before the exact class."""
    low, high = [s for s in spans if s[1] < 0x300], [s for s in spans if s[1] >= 0x300]
    return java_class(low + ([(min(a for a, _ in high), max(b for _, b in high))] if high else []))


@dataclass(frozen=True)
class Shape:
    id: str
    severity: str
    source: str

    def pattern(self, java: bool = False) -> str:
        """The pattern in one of the two dialects."""
        word = "[\\p{L}\\p{N}_]" if java else "\\w"
        blank = "[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]" if java else "\\s"
        edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))" if java else "\\b"
        within = "[^.!?]"
        opening = re.match(r"#(\w+|\([^()]*\))", self.source)
        # What follows the edge is asked first, as it is quicker to test at every place.
        out, at = f"(?={opening[1].replace(' ', blank)})" if java and opening else "", 0
        for m in re.finditer(r"<(\+?)(\d*)(\.?)(w?)>|[ '_#]", self.source):
            out += self.source[at : m.start()]
            at = m.end()
            if m[0][0] != "<":
                out += {" ": blank + "+", "'": "['’]?", "_": blank + "?", "#": edge}[m[0]]
            elif m[3]:
                out += "[.!?]" + blank + "+"
            elif m[4]:
                out += word + "+"
            elif m[1]:
                out += f"(?:[.!?]{blank}+{within}{{0,{m[2]}}})?"
            elif m[2]:
                out += f"{within}{{0,{m[2]}}}"
            else:
                out += blank + "*"
        return out + self.source[at:]


    def needed(self) -> list[str]:
        """Words one of which stands in every match: the options of a group or a single one, the longest there are."""
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"\([^()]*\)\?", " ", self.source))
        groups = [g.split("|") for g in re.findall(r"\(([^()]*)\)", plain)]
        singles = [[w] for w in re.findall(r"[^\W\d_]+", re.sub(r"\([^()]*\)", " ", plain))]
        return max((g for g in groups + singles if all(re.fullmatch(r"[^\W\d_]+", w) for w in g)), key=lambda g: min(map(len, g)))

    def needs(self) -> list[list[str]]:
        """Groups of words, of each of which one stands in every match; none where the source isn't of the plain kind."""
        if not re.fullmatch(r"(?:[^\W\d_]|[ ,'_#]|<[^>]*>|\([^()]*\)\??)*", self.source):
            return []
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"\([^()]*\)\?", " ", self.source))
        groups = [g.split("|") for g in re.findall(r"\(([^()]*)\)", plain)]
        singles = [[w] for w in dict.fromkeys(re.findall(r"[^\W\d_]+", re.sub(r"\([^()]*\)", " ", plain)))]
        return [g for g in groups + singles if all(re.fullmatch(r"[^\W\d_]+", w) for w in g)]


# A sentence end takes the blank after it with it.
def _shape_source(text: str) -> str:
    return text.replace("<.> ", "<.>")


@dataclass
class Rulebook:
    chars: dict[str, list[tuple[Span, str]]]
    quotes: dict[str, str]
    marks: dict[str, str]
    lookalikes: dict[str, str]
    banned: list[str]
    fillers: list[str]
    lexicon: list[str]
    shapes: list[Shape]
    tracking: dict[str, list[str]]
    messages: dict[tuple[str, str, str], str] = field(default_factory=dict)

    def spans(self, *kinds: str) -> list[Span]:
        return [span for kind in kinds for span, _ in self.chars.get(kind, [])]

    def one(self, kind: str) -> int:
        return self.chars[kind][0][0][0]

    @cached_property
    def entity_names(self) -> dict[str, int]:
        return {name: span[0] for span, name in self.chars["entity-name"]}

    @cached_property
    def special(self) -> list[Span]:
        """Every code point the character layer may act on."""
        return self.spans("always", "range", "zwnj", "zwj", "cgj", "bidi", "selector-basic", "selector-supplementary", "selector-mongolian", "space")


def _lines(home, name: str) -> list[str]:
    return [x for x in home.joinpath(f"{name}.txt").read_text("utf-8").split("\n") if x and not x.startswith("# ")]


@lru_cache(maxsize=8)
def load(home: str | None = None) -> Rulebook:
    """Rules from a folder: the argument, else $QUILLSIEVE_RULES, else those of the package."""
    named = home or os.environ.get("QUILLSIEVE_RULES")
    at = Path(named) if named else HOME
    chars: dict[str, list[tuple[Span, str]]] = {}
    for line in _lines(at, "characters"):
        kind, span, *name = line.split(" ", 2)
        chars.setdefault(kind, []).append((_span(span), name[0] if name else ""))
    typography = [x.split(" ", 2) for x in _lines(at, "typography")]
    numbered = lambda name: [x.split(" ", 1)[1] for x in _lines(at, name)]
    shapes = [Shape(i, s, _shape_source(p)) for i, s, p in (x.split(" ", 2) for x in _lines(at, "shapes"))]
    tracking: dict[str, list[str]] = {}
    for _, name, value in (x.split(" ", 2) for x in _lines(at, "artifacts")):
        tracking.setdefault(name, []).append(value)
    messages = {}
    for line in _lines(at, "messages"):
        head, _, text = line.partition(": ")
        messages[tuple(head.split(" "))] = text
    return Rulebook(
        chars,
        {chr(int(c, 16)): t for k, c, t in typography if k == "quote"},
        {chr(int(c, 16)): t for k, c, t in typography if k == "mark"},
        {chr(int(c, 16)): t for c, t in (x.split(" ") for x in _lines(at, "lookalikes"))},
        numbered("banned"),
        numbered("fillers"),
        numbered("lexicon") + numbered("transitions"),
        shapes,
        tracking,
        messages,
    )


def phrase_body(phrase: str, java: bool = False) -> str:
    """A phrase as a pattern: either apostrophe, any white space between words."""
    blank = "[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+" if java else "\\s+"
    parts = [re.sub("['’]", "['’]", re.escape(p)) for p in phrase.split(" ")]
    return blank.join(parts)


def bounded(body: str, java: bool = False) -> str:
    """A pattern that must not touch word characters, ignoring case."""
    word = "[\\p{L}\\p{N}_]" if java else "\\w"
    return f"{'(?iu)' if java else '(?i)'}(?<!{word}){body}(?!{word})"


def java_word(word: str) -> str:
    return bounded(re.sub(r"([^\w\s'’])", r"\\\1", word), True)
