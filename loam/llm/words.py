"""Words of ASCII letters, digits and everything beyond ASCII, with only A-Z lower-cased, as UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

#: Every byte of a word as it is compared, and a space for every byte that parts words.
TABLE = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
#: Bytes of a text that are cut into words at a time, about; a list of words takes ten times their size.
PIECE = 1 << 20


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text in order, in lists of bounded size; none for null."""
    if not text:
        return
    plain, start = text.encode().translate(TABLE), 0
    while start < len(plain):
        end = plain.find(b" ", start + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def words(text: str | None) -> list[bytes]:
    return [w for some in word_lists(text) for w in some]
