"""Splits texts by the pattern of the byte-level vocabularies."""

from __future__ import annotations

import re

import public_tokenizers
import regex

_ANY = regex.compile(public_tokenizers.PATTERN)
# Up to U+024F the letters and numbers of the pattern are these, so that the faster engine serves.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = "\\t-\\r \u0085 "
_LATIN = re.compile(
    rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
    rf"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_BEYOND = re.compile("[^\x00-ɏ]")


def split(text: str) -> list[str]:
    """The matches of the pattern; together they are the text."""
    return (_ANY if _BEYOND.search(text) else _LATIN).findall(text)
