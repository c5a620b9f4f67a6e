"""Settings of a run: defaults, a file that overlays them, and what makes a file invalid."""

from __future__ import annotations

import json
from pathlib import Path

LAYERS = ("entities", "characters", "homoglyphs", "typography", "voice", "artifacts")
FORMS = ("NFC", "NFD", "NFKC", "NFKD", "none")
FILE_NAMES = ("quillsieve.config.json", ".quillsieverc.json", ".quillsieverc")

#: On by default, then off by default.
ON = ("backup", "fix_dashes", "fix_punctuation", "fix_safe_delete_phrases", "keep_nbsp_in_numbers", "protect_code", "straight_quotes", "voice")
OFF = ("replace_homoglyphs", "strip_icc", "strip_variation_selectors")
LISTS = {
    "custom_banned_phrases": "",
    "document_extensions": ".docx .odp .ods .odt .pdf .pptx .xlsx",
    "exclude": ".git .next .venv __pycache__ build dist node_modules",
    "ignore_phrases": "",
    "image_extensions": ".avif .gif .heic .heif .jpeg .jpg .png .svg .tif .tiff .webp",
    "layers": " ".join(LAYERS),
    "text_extensions": ".htm .html .markdown .md .mdx .txt",
}


class SettingsError(ValueError):
    """A settings file that can't be used."""


def defaults() -> dict:
    return {**dict.fromkeys(ON, True), **dict.fromkeys(OFF, False), **{k: v.split() for k, v in LISTS.items()}, "normalize_form": "NFC"}


def checked(settings: dict, source: str = "settings") -> dict:
    """settings over the defaults; unknown names are let through."""
    out = defaults() | settings

    def wrong(name: str, what: str) -> None:
        raise SettingsError(f'config error in {source}: "{name}" must be {what}')

    for name in (*ON, *OFF):
        if not isinstance(out[name], bool):
            wrong(name, "true or false")
    for name in LISTS:
        if not (isinstance(out[name], list) and all(isinstance(x, str) for x in out[name])):
            wrong(name, "a list of strings")
    if out["normalize_form"] not in FORMS:
        wrong("normalize_form", f"one of {', '.join(FORMS)}")
    policy = out.get("dash_policy")
    if policy is not None and not (isinstance(policy, dict) and all(isinstance(x, str) for x in policy.values())):
        wrong("dash_policy", "an object with string values")
    most = out.get("max_file_bytes")
    if most is not None and (isinstance(most, bool) or not isinstance(most, int) or most <= 0):
        wrong("max_file_bytes", "a positive integer")
    return out


def find(start: str = ".") -> Path | None:
    """The nearest settings file from a folder upwards."""
    base = Path(start).resolve()
    return next((p for folder in (base, *base.parents) for name in FILE_NAMES if (p := folder / name).is_file()), None)


def load(path: str | None = None, start: str = ".") -> dict:
    if path and not Path(path).is_file():
        raise FileNotFoundError(f"config not found: {path}")
    at = Path(path) if path else find(start)
    if at is None:
        return defaults()
    try:
        user = json.loads(at.read_text("utf-8"))
    except json.JSONDecodeError as broken:
        raise SettingsError(f"config error in {at}: not valid json ({broken})") from broken
    if not isinstance(user, dict):
        raise SettingsError(f"config error in {at}: top level must be a json object")
    return checked(user, str(at))


def aggressive(settings: dict) -> dict:
    return settings | dict.fromkeys(OFF, True)
