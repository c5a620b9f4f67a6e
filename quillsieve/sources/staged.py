"""Files staged for a git commit."""

from __future__ import annotations

import os
import subprocess

from .files import kind_of


def _git(where: str, *words: str) -> list[str]:
    """The whole paths that git lists in a folder; none outside a work tree."""
    done = subprocess.run(["git", *words], cwd=where, capture_output=True, check=False)
    return [] if done.returncode else [os.path.abspath(os.path.join(where, os.fsdecode(x))) for x in done.stdout.split(b"\0") if x]


def files(settings: dict, where: str = ".") -> tuple[list[str], list[str]]:
    """Whole paths of staged files of a known kind (added, copied or modified): those staged whole, and those with later changes."""
    staged = [p for p in _git(where, "diff", "--cached", "--name-only", "--relative", "-z", "--diff-filter=ACM") if kind_of(p, settings)]
    changed = set(_git(where, "diff", "--name-only", "--relative", "-z"))
    return [p for p in staged if p not in changed], [p for p in staged if p in changed]


def add(paths: list[str], where: str = ".") -> None:
    for i in range(0, len(paths), 500):
        subprocess.run(["git", "add", "--", *paths[i : i + 500]], cwd=where, check=True)
