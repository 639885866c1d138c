"""Splitting a text into the words whose bytes are then merged.

The published pattern needs Unicode categories. Texts made of characters for which the standard library's classes agree with
them, Latin ones mostly, are split by an equal pattern over those classes, which is twice as fast.
"""

from __future__ import annotations

import re

import public_tokenizers
import regex

_any = regex.compile(public_tokenizers.PATTERN)
_latin = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
#: Characters that the standard library may class otherwise.
OTHER = "[^\x00-\x1b\x20-\x7f\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ſ‐-‧]"
_other = re.compile(OTHER)


def words(text: str) -> list[str]:
    return (_any if _other.search(text) else _latin).findall(text)
