"""Splitting of texts as the public tokenizers do it, with a fast path for the scripts that it is proven for.

The fast path serves texts of Latin letters up to U+017F and common punctuation, for which the standard library's classes
equal the tokenizers library's (tests compare every such code point). Any other text goes through the library itself.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_PLAIN = [c for c in map(chr, range(0x180)) if c not in "\x1c\x1d\x1e\x1fİ"] + [chr(c) for c in (*range(0x2010, 0x2028), 0x20AC)]


def _class(kind: str) -> str:
    """The members of a general category among the plain characters, for use within brackets."""
    return "".join(map(re.escape, (c for c in _PLAIN if unicodedata.category(c)[0] == kind)))


_L, _N, _S = _class("L"), _class("N"), "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
NOT_PLAIN = re.compile("[^" + "".join(map(re.escape, _PLAIN)) + "]")
#: The split patterns of the two vocabularies.
BYTE_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
WORD_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_pretokens(text: str, path: str) -> list[str]:
    """The pre-tokens of a text without special strings, for a byte-level vocabulary."""
    if NOT_PLAIN.search(text) is None:
        return BYTE_SPLIT.findall(text)
    return [text[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]
