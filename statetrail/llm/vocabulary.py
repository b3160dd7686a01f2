"""Byte-level vocabularies in the tiktoken rank format, and the pieces that texts are cut into."""

from __future__ import annotations

import base64
import re

import regex

DEFAULT_FILE = "byte_bpe_multi_50k.tiktoken"

#: Characters of which the standard module's classes say the same as Unicode properties.
_COMMON = r"\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿ"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(DEFAULT_FILE)


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def load_tokens(path: str) -> list[bytes]:
    """Token bytes in the order of their ids; the ids must run from 0."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Pieces:
    """Cuts texts by the pattern; texts of common characters by an equal, faster pattern."""

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern)
        self.odd = re.compile(f"[^{_COMMON}]")
        plain = (pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s0-9{_LETTERS}]")
                 .replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", "[0-9]"))
        self.plain = None if r"\p" in plain else re.compile(plain)

    def cut(self, text: str) -> list[str]:
        """All matches in order. The pattern must have no groups."""
        if self.plain is None or self.odd.search(text):
            return self.full.findall(text)
        return self.plain.findall(text)
