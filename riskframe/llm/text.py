"""Small text helpers shared by the operators of this subpackage.

All helpers treat NULL as the empty text and work on whole texts.
"""

from __future__ import annotations

import re

# fixed values: the ASCII letters that the contracts lower-case, and white space
UPPER_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
WORD = re.compile("[^\x20\x09-\x0d]+")
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def lower_ascii(text: str | None) -> str:
    """Lower-case A-Z only; every other character stays. NULL is empty."""
    if not text:
        return ""
    return text.lower() if text.isascii() else text.translate(UPPER_TO_LOWER)


def words(text: str | None) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased text."""
    low = lower_ascii(text)
    # str.split() without arguments also splits at \x1c-\x1f and at Unicode spaces, so it serves ASCII texts without those only
    if low.isascii() and not any(c in low for c in "\x1c\x1d\x1e\x1f"):
        return low.split()
    return WORD.findall(low)


def word_bytes(text: str | None) -> list[bytes]:
    """The same words as UTF-8 bytes. bytes.lower() and bytes.split() know ASCII
    only: they lower-case A-Z and split at exactly space and \\t-\\r, and no byte of a
    multi-byte character lies in those ranges."""
    return text.encode("utf-8", "replace").lower().split() if text else []
