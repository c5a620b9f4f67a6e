"""Rewriting a text by translating it to another language and back: off unless asked for, and sent to a service."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from urllib import error, parse, request

KEY_VARIABLE = "DEEPL_API_KEY"
#: (text, target language, source language or None) -> (translation, language found)
Client = Callable[[str, str, str | None], tuple[str, str | None]]


class TranslationError(RuntimeError):
    pass


def explained(status: int) -> str:
    known = {429: "deepl rate limit reached, wait a moment and retry", 456: "deepl quota exceeded for this billing period"}
    known |= dict.fromkeys((401, 403), f"deepl rejected the api key, check {KEY_VARIABLE}")
    return known.get(status, f"deepl responded with http {status}")


def deepl(key: str | None = None, timeout: float = 60.0) -> Client:
    """A client of the DeepL service; keys that end in :fx are for its free host."""
    key = key or os.environ.get(KEY_VARIABLE)
    if not key:
        raise TranslationError(f"set {KEY_VARIABLE} to use the rewrite command")
    host = "api-free" if key.strip().endswith(":fx") else "api"

    def translate(text: str, target: str, source: str | None) -> tuple[str, str | None]:
        form = {"text": text, "target_lang": target} | ({"source_lang": source} if source else {})
        ask = request.Request(f"https://{host}.deepl.com/v2/translate", parse.urlencode(form).encode(), {"Authorization": f"DeepL-Auth-Key {key}"})
        try:
            with request.urlopen(ask, timeout=timeout) as answer:
                first = json.load(answer)["translations"][0]
        except error.HTTPError as refused:
            raise TranslationError(explained(refused.code)) from refused
        except error.URLError as lost:
            raise TranslationError(f"could not reach deepl: {lost.reason}") from lost
        return first["text"], first.get("detected_source_language")

    return translate


def back_and_forth(text: str, client: Client, source: str | None = None, pivot: str = "EN") -> str:
    there, found = client(text, pivot, source)
    home = source or found
    if not home:
        raise TranslationError("could not detect the source language, pass --source-lang")
    if home.upper().startswith(pivot.upper()):
        raise TranslationError(f"text is already in the pivot language ({home}), pass a different --pivot-lang")
    return client(there, home, pivot)[0]
