"""Whole-text token ids by a public tokenizer, with a bounded memory of encoded chunks.

The tokenizers used here never let a token cross a space or a line feed, nor the border between letters and a run of the
punctuation in ``TAIL`` after them, and they fold case first. So the ids of a text are those of its chunks between
spaces, and the ids of such a chunk are those of its lower-case letters and of its tail. A lower-case word of Latin
letters goes to the library's model itself, as the byte characters that its pre-tokenizer makes of it; whatever else
there is goes through the whole tokenizer. All ways are compared on probes when a worker starts, and a tokenizer that does
not agree is given its texts whole. Words repeat, so each
worker remembers the ids of what it has met. The memory has two generations of bounded size: what is used again moves
to the younger, and the older is forgotten when the younger is full.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Iterable, Iterator

from riskloom.llm._common import sole

#: Chunks in a generation of a worker's memory, and characters above which a chunk is encoded without being remembered.
GENERATION, LONGEST = 260_000, 64
#: Punctuation that the tokenizer splits from ASCII letters before it (an apostrophe may join what follows it).
TAIL = ".,;:!?*$%&#"

#: Words on which the short way must agree with the whole tokenizer, and texts on which the ids of chunks must.
PROBES = ("the", "word", "thouan", "été", "größe", "señales", "ænima", "zzyzx")
TEXTS = ("Two words. One  line,\nthen another;\n\n and (this) \"here\" is 3.14 % of 2,718 it's", " a \n b\t c\r\n", "été, größe! señales? 数据 是 文本 🙂 ok", "http://a.b/c?d=e&f #g $5 x*y")


def _byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]



def encoder(path: str) -> "ChunkEncoder":
    """One encoder for each worker process and vocabulary file."""
    return sole(("tokens", path), lambda: ChunkEncoder(path))


class _Generation(dict):
    """Maps chunks to their ids; what it lacks it asks the encoder for."""

    def __init__(self, encoder: "ChunkEncoder"):
        super().__init__({"": b""})
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        return self.encoder.find(chunk)


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.young, self.older = _Generation(self), {}
        self.model, self.letters = self.tokenizer.model, _byte_characters()
        self.short = True
        self.short = all(self._word(w) == self._ids(w) for w in PROBES)
        # A tokenizer whose tokens cross blanks gets its texts whole.
        self.whole = not all(self._by_chunks(t) == self._ids(t) for t in TEXTS)
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are not little-endian 32-bit here")

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case word of Latin letters in composed form."""
        if not self.short:
            return self._ids(word)
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def find(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            if len(chunk) > LONGEST:
                return self._ids(chunk)
            core = chunk.rstrip(TAIL)
            if core.isalpha() and max(core) < "\u0130":
                low = core.lower()
                if low == chunk:
                    found = self._word(low)
                else:
                    found = self.young[low] + (self.young[chunk[len(core) :]] if len(core) < len(chunk) else b"")
            else:
                found = self._ids(chunk)
        self.young[chunk] = found
        return found

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text (None: empty) its ids."""
        for text in texts:
            if len(self.young) > GENERATION:
                self.young, self.older = _Generation(self), self.young
            yield self._ids(text or "") if self.whole else self._by_chunks(text or "")

    def _by_chunks(self, text: str) -> bytes:
        return b"".join(map(self.young.__getitem__, text.replace("\n", " ").split(" ")))
