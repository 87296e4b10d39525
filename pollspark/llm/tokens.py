"""Whole-text token ids by the ``tokenizers`` library, each distinct chunk encoded once.

In a byte-level vocabulary with the usual split pattern, a space or line feed
before a character that is not white space always starts a new pre-token, so the
ids of a text are the ids of its chunks in order. A worker remembers the ids of
chunks; only unseen chunks go through the library.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
from tokenizers import Tokenizer  # noqa: E402

VOCABULARY = "byte_bpe_50k.json"
#: Punctuation split off unseen words, so that a word is encoded once for all its endings.
ENDINGS = ".,!?;:*%$&#|"


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Memo(dict):
    """Remembered chunks; an unseen one is learnt when it is first asked for."""

    def __init__(self, learn: Callable[[str], bytes | None]):
        self.learn = learn

    def __missing__(self, part: str) -> bytes | None:
        return self.learn(part)


class ChunkEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    A chunk starts at a space or line feed before a character that is no white
    space. ``memo`` bounds the remembered chunks (it is emptied when full),
    ``longest`` the length of a chunk worth remembering. Both change speed only.
    """

    def __init__(self, path: str, memo: int = 500_000, longest: int = 32):
        self.tokenizer = Tokenizer.from_file(path)
        self.memo, self.limit, self.longest = Memo(self.learn), memo, longest
        self.endings: dict[str, bytes] = {"": b""}
        self.feed = len(self.ids("\n"))
        self.model, self.letters = self.tokenizer.model, byte_letters()
        probes = ["the", "Zebra", "été", "日本語", "ñandú", "x" * 40]
        self.plain = array("I").itemsize == 4 and sys.byteorder == "little"
        self.plain = self.plain and all(self._word(p) == self.ids(" " + p) for p in probes)
        self.plain = self.plain and not any(t.content.strip().isalpha() for t in self.tokenizer.get_added_tokens_decoder().values())

    def ids(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(found, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a space and letters: one pre-token, so the library's merge model alone decides."""
        piece = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(self.letters[32] + piece)]).tobytes()

    def learn(self, part: str) -> bytes | None:
        """Ids of an unseen chunk, remembered if it is short; None where no chunk begins."""
        if self.plain and part.isalpha():
            raw = self._word(part)
        elif part == "\n" or unicodedata.category(part[part[:1] == "\n"] if part else " ")[0] in "ZC":
            raw = None  # white space follows: no boundary here
        else:
            core = part.rstrip(ENDINGS)
            if core is not part and (core[1:] if core[:1] == "\n" else core).isalpha():
                tail = part[len(core) :]
                if tail not in self.endings:
                    if len(self.endings) > 10_000:
                        self.endings.clear()
                    self.endings[tail] = self.ids(tail)
                raw = self.memo[core] + self.endings[tail]
            else:
                raw = self.ids(part if part[:1] == "\n" else " " + part)
        if len(part) <= self.longest:
            self.memo[part] = raw
        return raw

    def encode(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        out = []
        for text in texts:
            parts = ("\n" + text).replace("\n", " \n").split(" ")
            try:  # the first part is empty, the second has the line feed put in front
                out.append(b"".join(map(memo.__getitem__, parts[1:]))[self.feed :])
            except TypeError:
                out.append(self._glued(text, parts))
        return out

    def _glued(self, text: str, parts: list[str]) -> bytes:
        """A text in which some space or line feed is no boundary: such parts join the one before."""
        memo, chunks = self.memo, []
        for part in parts[1:]:
            led = part if part[:1] == "\n" else " " + part
            if memo[part] is None and chunks:
                chunks[-1] = (chunks[-1][0] + led, None)
            else:
                chunks.append((led, memo[part]))
        first = self.ids(chunks[0][0][1:]) if chunks[0][1] is None else chunks[0][1][self.feed :]
        return first + b"".join(self.ids(led) if known is None else known for led, known in chunks[1:])


@lru_cache(maxsize=2)
def encoder(path: str, memo: int = 500_000) -> ChunkEncoder:
    """One encoder per Python worker, vocabulary and number of remembered chunks."""
    return ChunkEncoder(path, memo)
