"""Terms of a text: runs of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case."""

from __future__ import annotations

import re

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: On bytes of UTF-8 after lower-casing; all bytes of characters beyond ASCII are 0x80 or more.
_TERMS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def terms_of(text: str | None) -> list[bytes]:
    """All terms in order, as UTF-8; NULL has none."""
    return _TERMS(text.encode().translate(_LOWER)) if text else []
