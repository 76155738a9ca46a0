"""Cutting texts into pre-tokens of the byte-level vocabularies, each distinct one once.

A text is first cut where a run of ASCII white space begins after another
character.  The pattern of the vocabularies never matches across such a place
and looks no further ahead, so the pre-tokens of a text are those of its
chunks, and work done for a chunk serves every text that holds it.  Texts with
other white space characters are one chunk.
"""

from __future__ import annotations

import re

SPACES = " \t\n\r\x0b\x0c"
_CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: White space other than ASCII, and characters that libraries take for white space or not.
_OTHER = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def chunks(text: str) -> list[str]:
    """Pieces of ``text`` that can be cut into pre-tokens one by one."""
    if _OTHER.search(text):
        return [text]
    return _CHUNK.findall(text)
