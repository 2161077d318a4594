"""Words of whole texts in slices of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Words of ASCII letters and digits and anything beyond ASCII, and words between ASCII white space, over lower-cased UTF-8.
PLAIN, PLAIN_GAP = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
SPACED, SPACED_GAP = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a slice.
SLICE = 1 << 20


def word_slices(text: bytes, word: re.Pattern, gap: re.Pattern, size: int = SLICE) -> Iterator[list[bytes]]:
    """All words of a text, A-Z lower-cased, in lists of about `size` bytes; a longer word is whole in its list.

    A list is cut where `gap`, one byte outside words (before lower-casing), matches.
    """
    at = 0
    while at < len(text):
        found = gap.search(text, at + size) if len(text) > at + size else None
        end = found.start() if found else len(text)
        yield word.findall(text[at:end].lower())  # bytes.lower() leaves all but A-Z
        at = end
