"""Words: longest runs of Unicode letters and digits of the text in lower case."""

from __future__ import annotations

import re

import regex

#: Python's \w without the underscore is L, N and a handful of numeric symbols; the slow pattern settles texts beyond ASCII.
_ASCII = re.compile(r"[a-z0-9]+")
_ANY = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    """Null and empty text have no words."""
    if not text:
        return []
    return (_ASCII if text.isascii() else _ANY).findall(text.lower())
