"""Token ids of whole texts, as little-endian bytes.

The tokenizers library spends most of its time on words it has met before. Its pre-tokenizers never look
across the border between white space and a word, so a text is cut there, each distinct piece is encoded by
the library once per worker, and the pieces' ids are joined. Before that a text is split at the vocabulary's added
tokens, which the library takes out of the text as they stand. The result equals the library's for the text.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: The white space of Unicode, which the vocabularies' patterns write as \\s.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters before white space, digits or ASCII signs but the apostrophe make a piece of their own; so do the rest
#: of a word, and white space. A space belongs to the word after it.
SPACED = re.compile(rf" ?[^\W\d_]++(?=[!-&(-@\[-`{{-~{WHITE}]|$)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: The same where white space is dropped. Such vocabularies normalise a text before they cut it, so only letters that stay
#: letters then may be cut off: Latin ones but the dotted capital I, which becomes two characters.
DROPPED = re.compile(r"[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]++(?=[!-&(-@\[-`{-~\t-\r ]|$)|[^\t-\r ]+")
#: Pieces kept per worker, and the longest one kept.
MOST_PIECES, LONGEST_PIECE = 400_000, 40


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Pieces(dict):
    """Piece of text -> its ids as unsigned 32-bit bytes; forgets everything when full."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        #: Added tokens that take in white space, ask for a border or meet normalised text are left to the library.
        self.whole = any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.added = {t.content: array("I", [k]).tobytes() for k, t in added.items()}
        literals = sorted(self.added, key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(map(re.escape, literals))})").split if literals else lambda text: [text]
        self.drops = not self.library.encode(" ", add_special_tokens=False).ids
        self.cut = (DROPPED if self.drops else SPACED).findall
        self.model, self.letters = self.library.model, byte_letters()

    def ids(self, piece: str) -> list[int]:
        """A single Latin word needs no pre-tokenizer: the library's model takes it as it is, which is three times as fast."""
        word = piece.lower() if self.drops else piece
        if (word if word[0] != " " else word[1:]).isalpha() and max(word) < "\u0250":
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            elif word[0] == " ":
                word = self.letters[32] + word[1:]
            return [t.id for t in self.model.tokenize(word)]
        return self.library.encode(piece, add_special_tokens=False).ids

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.ids(piece)).tobytes()
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; none for null."""
        if not text:
            return b""
        if self.whole:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        parts = self.split(text)  # every second one is an added token
        if len(parts) == 1:
            return b"".join(map(self.__getitem__, self.cut(text)))
        return b"".join(self.added[part] if k % 2 else b"".join(map(self.__getitem__, self.cut(part))) for k, part in enumerate(parts))


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """One table of pieces per worker and vocabulary."""
    return Pieces(path)


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
