"""Which texts may be split by plain character classes.

Tokenizer libraries split by Unicode classes and normalise first.  For texts
made of ASCII, Latin letters and common punctuation every Unicode version
agrees and NFC changes nothing, so ``re`` with explicit classes gives the same
pieces.  Any other character sends the whole text through the library's own
normaliser and splitter."""

from __future__ import annotations

import re
import unicodedata

_LATIN = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180), *range(0x2010, 0x2028))
          if chr(c) != "İ" and chr(c) != "­"]


def _cls(kind: str) -> str:
    return "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == kind)


LETTERS, DIGITS = _cls("L"), _cls("N")
#: finds the first character that plain classes may not handle
UNCOMMON = re.compile("[^ \t\n\r" + "".join(map(re.escape, _LATIN)) + "]")


def common(text: str) -> bool:
    return UNCOMMON.search(text) is None
