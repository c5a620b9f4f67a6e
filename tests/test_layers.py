"""The layers on single texts."""

import pytest
from hypothesis import given, settings as hypothesis_settings, strategies as st

from quillsieve.functions import layers, rulebook
from quillsieve.functions.settings import aggressive, checked, defaults

ZW, NB = "​", " "


def clean(text, **how):
    return layers.clean_text(text, checked(how))


CASES = [
    (f"a{ZW}b", {}, "ab"),
    ("x﻿y⁠z", {}, "xyz"),
    (f"10{NB}%", {}, f"10{NB}%"),
    (f"5{NB}kg", {}, f"5{NB}kg"),
    (f"Nr.{NB}5", {}, f"Nr.{NB}5"),
    (f"z.{NB}B. so", {}, f"z.{NB}B. so"),
    (f"am 5.{NB}Mai", {}, f"am 5.{NB}Mai"),
    (f"Hallo{NB}Welt", {}, "Hallo Welt"),
    (f"Ende.{NB}Neuer Satz.", {}, "Ende. Neuer Satz."),
    (f"Dr.{NB}Müller", {}, "Dr. Müller"),
    (f"10{NB}% z.{NB}B.", {"keep_nbsp_in_numbers": False}, "10 % z. B."),
    ("one two three⠀four", {}, "one two three four"),
    ("a⁪b⁯c￹d￺e￻fㅤgﾠh", {}, "abcdefgh"),
    ("ᠠ᠋ᠡ", {}, "ᠠ᠋ᠡ"),
    ("a᠋b", {}, "ab"),
    ("‎foo bar", {}, "foo bar"),
    ("\U0001f3f4\U000e0067\U000e0062\U000e0065 text", {}, "\U0001f3f4 text"),
    ("Hello︁︂\U000e0100 world️", {}, "Hello world"),
    ("❤️", {"strip_variation_selectors": True}, "❤"),
    ("⠁⠀⠁", {}, "⠁⠀⠁"),
    ("a⠀b", {}, "a b"),
    ("a\U000f0000b\U0010fffdc﷐d￾e", {}, "abcde"),
    ("wa&zwj;ter", {}, "water"),
    ("\U0001f469&zwj;\U0001f4bb", {}, "\U0001f469‍\U0001f4bb"),
    ("Use `a&#8203;b`", {}, "Use `a&#8203;b`"),
    ("&amp; &#169;", {}, "&amp; &#169;"),
    ("fast — slow", {}, "fast, slow"),
    ("fast — slow", {"dash_policy": {"spaced_replacement": ""}}, "fastslow"),
    ("Open 10 – 20 Uhr, from 1990 — 2000.", {}, "Open 10 - 20 Uhr, from 1990 - 2000."),
    ("quick — calm, 1980–85, x‒y, z―w", {}, "quick, calm, 1980-85, x-y, z-w"),
    ("Without further ado, we ship.", {}, "We ship."),
    ("They came. It's worth noting that\nit rained.", {}, "They came.\nIt rained."),
    ("We ship, without further ado, tomorrow.", {}, "We ship, tomorrow."),
    ("We ship without further ado.", {}, "We ship."),
    ("Top.\r\nIt's worth noting that my tea is cold.\r\n", {}, "Top.\r\nMy tea is cold.\r\n"),
    ("log in at pаypal now", {"replace_homoglyphs": True}, "log in at paypal now"),
    ("Visit СОРЕ today", {"replace_homoglyphs": True}, "Visit COPE today"),
    ("See source citeturn0search0 and more", {}, "See source and more"),
    ("[as citeturn1news2] or [citeturn0file3 else]", {}, "[as] or [else]"),
    ("citeturn0view0 first, last citeturn2map1\nthen", {}, "first, last\nthen"),
    ("tab\tciteturn0search0\tsep", {}, "tab\tsep"),
    ("and [cite: 1] `code`", {}, "and`code`"),
    ("https://y.org/a?utm_source=mail", {}, "https://y.org/a?utm_source=mail"),
    ("u?utm_source=openai&utm_source=openai", {}, "u?utm_source=openai"),
    ("`“x”`", {"protect_code": False}, '`"x"`'),
    ("", {}, ""),
]


@pytest.mark.parametrize(("text", "how", "wanted"), CASES)
def test_text(text, how, wanted):
    assert clean(text, **how)[0] == wanted


def found(text, **how):
    return {(f["layer"], f["severity"]): f for f in clean(text, **how)[1]}


def test_findings_count_by_rule():
    f = found("citeturn0search0 and citeturn0search1 at https://x.io/?utm_source=openai")["artifacts", "fixed"]
    assert f["by_rule"] == {"utm_source-tracking": 1, "chatgpt-citation-token": 2}
    f = found("“a” “b”")["typography", "fixed"]
    assert f["by_rule"] == dict.fromkeys(("U+201D", "U+201C"), 2)
    f = found(f"&#8203; {ZW}{ZW}")
    assert f["entities", "fixed"]["by_rule"] == {"&#8203;": 1}
    assert f["characters", "fixed"]["by_rule"] == {"U+200B": 3}
    assert "artifacts", "fixed" not in found("plain")


def test_findings_merge_across_code():
    f = found("[cite: 1] a `x` citeturn0search0 b `y` [cite: 2] [cite_start]")["artifacts", "fixed"]
    assert f["count"] == 4 and f["examples"] == ["gemini-citation", "chatgpt-citation-token"]


def test_shapes_count_once_a_segment():
    text = "Not only fast, but also good. Not only fast, but also good. `x` Not only a, but also b."
    assert found(text)["voice", "warn"]["count"] == 2


def test_every_shape_has_its_word():
    assert {s.id for s in rulebook.load().shapes} == set(layers.SHAPE_WORDS)


@pytest.mark.parametrize(
    ("text", "shape"),
    [
        ("This isn't a cat. This is a dog.", "this-isnt-this-is"),
        ("It's not just about bread, it's about butter.", "its-not-just-its-about"),
        ("Stop thinking features. Start thinking jobs.", "stop-thinking-start-thinking"),
        ("Agile is dead. Flow is the future.", "is-dead-is-the-future"),
        ("The question isn't who. The question is when.", "the-question-isnt"),
        ("You don't need more tools. You need focus.", "you-dont-need-you-need"),
        ("This isn't merely a cup, it's a vase.", "isnt-merely-its"),
        ("This is where user story mapping comes in.", "this-is-where-comes-in"),
        ("The team shipped it, highlighting the importance of focus.", "participial-tail"),
        ("The library serves as a bridge between teams.", "copula-avoidance"),
        ("No meetings, no slides, just shipping.", "no-no-just"),
        ("Nicht nur schnell, sondern auch zuverlässig.", "nicht-nur-sondern-auch"),
        ("Es geht nicht um Tools. Es geht um Haltung.", "es-geht-nicht-um-es-geht-um"),
    ],
)
def test_shape(text, shape):
    assert any(shape in f["by_rule"] for f in clean(text)[1])


def test_ignored_and_custom_phrases():
    assert not found("we delve into it", ignore_phrases=["Delve into", "delve"])
    assert found("total foo bar", custom_banned_phrases=["foo bar"])["voice", "error"]["count"] == 1


def test_word_edges_are_unicode():
    assert ("voice", "warn") not in found("ümeistern")
    assert found("Meistern wir")["voice", "warn"]["count"] == 1


def test_normal_form_changes_without_finding():
    text, f = clean("é")
    assert text == "é" and not f


def test_bidi_is_kept_in_rtl():
    text, f = clean("שלום ‎abc")
    assert "‎" in text and f[0]["severity"] == "warn"


def test_aggressive():
    how = aggressive(defaults())
    assert how["replace_homoglyphs"] and how["strip_variation_selectors"] and how["strip_icc"]


def test_unknown_layers_are_skipped():
    assert clean(f"a{ZW}b", layers=["nothing"])[0] == f"a{ZW}b"


def test_hits_hide_in_fillers():
    hits = layers.phrase_hits("In conclusion, we delve into it. `delve`", defaults())
    assert [(h[0], h[1], h[2]) for h in hits] == [(0, 14, "filler"), (18, 28, "banned"), (18, 23, "lexicon")]


ALPHABET = st.text(alphabet="ab 1.,!`~-\n​ —“аא‎️❤&;#́", max_size=60)


@given(ALPHABET)
@hypothesis_settings(max_examples=300, deadline=None)
def test_decisions_rebuild_the_text(text):
    how = checked({"layers": ["characters"], "normalize_form": "none"})
    out = list(text)
    for i, action, _, _ in layers.characters_of(how, rulebook.load()).decisions(text):
        out[i] = {"keep": out[i], "remove": "", "space": " "}[action]
    assert "".join(out) == layers.clean_text(text, how)[0]


@given(ALPHABET)
@hypothesis_settings(max_examples=200, deadline=None)
def test_parts_join_to_the_text(text):
    parts = layers.segments(text)
    assert "".join(p for _, p, _ in parts) == text
    assert all(text[at : at + len(p)] == p for at, p, _ in parts)


@pytest.mark.parametrize("text", [c[0] for c in CASES if "utm_source=openai&" not in c[0]])
def test_twice_is_once(text):
    once = clean(text)[0]
    twice, f = clean(once)
    assert twice == once
    assert not [x for x in f if x["severity"] == "fixed"]


def test_phrases_are_found_as_by_their_patterns():
    import random

    some = random.Random(1)
    rules = rulebook.load()
    phrases = [(p, False) for p in [*rules.banned, *rules.fillers, "a b a", "  two", "x", "...", "é plus"]] + [(w, True) for w in rules.lexicon]
    for _ in range(3000):
        text = ""
        for _ in range(some.randrange(1, 6)):
            p = some.choice(phrases)[0]
            text += some.choice([p, p.upper(), p.replace(" ", "\n "), p.replace("'", "’"), p.replace("s", "ſ"), p.replace("i", "İ"), p.replace("k", "\u212a")]) + some.choice([" ", "  ", ", ", "", "_", "9", "ß", "İ", "."])
        for p, plain in some.sample(phrases, 12) + [x for x in phrases if x[0] in text][:6]:
            made = layers.Phrase(p, plain)
            assert made.spans(layers.Level(text)) == [m.span() for m in made.whole.finditer(text)], (p, text)


def test_words_of_many_texts_choose_no_phrase():
    words = layers.voice_of(checked({}), rulebook.load()).words
    assert not words.candidates("that is the end of it, being at rest as the others are")
    assert ("banned", "at the end of the day") in words.candidates("at the end of the day") and ("shape", "copula-avoidance") in words.candidates("it serves as a")
