"""Token ids of whole texts by a public tokenizer of the ``tokenizers`` library.

In the pattern that byte-level BPE splits text with, a space or line end before a
character that is no white space always begins a new piece. So the chunks that begin there
are encoded on their own, and the short ones are kept in a bounded memo. A chunk that it
lacks is cut into the pattern's pieces, and each piece goes to the library's merges; letters
before other ASCII characters are a piece without asking the pattern. A string that the
file adds as a token (an end marker, say) has that token's id wherever it stands, as the
library does by default, and splits the text around it. Ids are the same as those of the
whole text.
"""

from __future__ import annotations

import re
import string
from array import array
from itertools import islice

import numpy as np

END = 0
MODEL = "byte_bpe_50k.json"
#: Chunks in the memo. When it has so many, those stay that came up since it had RECENT of them.
MEMO = 150_000
RECENT = 0.8
#: Code points of the longest chunk that is kept: a text without spaces is one chunk.
LONGEST = 64
#: Short pieces and ends of chunks that are kept.
SHORT = 20_000
#: Chunks between two looks at the memo's size.
STRETCH = 20_000
#: Before a chunk; a space goes, a line end stays in front of its chunk.
_SPLIT = re.compile(r" (?=\S)|(?=\n\S)")
#: White space after a space or line end, or the text's end: only then do other splits than _SPLIT differ.
_ODD = re.compile(r"[ \n](?:\s|\Z)")
_made: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encoder(path: str) -> "Encoder":
    """One encoder for each worker process and file."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


class _Memo(dict):
    """Ids of chunks by chunk; asks for what it lacks."""

    def __init__(self, learn, held: dict):
        super().__init__(held)
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes:
        ids = self.learn(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = {t.content: (i, t) for i, t in self.model.get_added_tokens_decoder().items()}
        self.added = {content: i for content, (i, _) in added.items()}
        #: Tokens that also take or ask for something of what stands beside them.
        self.fussy = [c for c, (_, t) in added.items() if t.lstrip or t.rstrip or t.single_word]
        longest = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.marks = re.compile(f"({'|'.join(longest)})") if longest else None
        #: Ids as narrow as the vocabulary allows.
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        # Byte-level BPE shows bytes as characters: printable ones as themselves, others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        self.merge = self.model.model.tokenize
        self.space = chr(self.shown[32])
        self.short: dict[str, bytes] = {}
        self.memo = _Memo(self._learn, {})
        self.recent: set[str] = set()

    def _merged(self, shown: str) -> bytes:
        return array(self.code, [t.id for t in self.merge(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._merged(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown))

    def _pieces(self, text: str) -> bytes:
        out = []
        for p in self.cut(text):
            if len(p) > 2:
                out.append(self._piece(p))
            else:
                out.append(self.short.get(p) or self._kept(p, self._piece(p)))
        return b"".join(out)

    def _kept(self, piece: str, ids: bytes) -> bytes:
        if len(self.short) >= SHORT:
            self.short.clear()
        self.short[piece] = ids
        return ids

    def _learn(self, chunk: str) -> bytes:
        """The ids of a chunk after its space, or with its line end."""
        if chunk.isalpha():
            return self._merged(self.space + chunk) if chunk.isascii() else self._piece(" " + chunk)
        head = chunk.rstrip(string.punctuation)
        if len(head) < len(chunk) <= LONGEST and (head.isalpha() or head[:1] == "\n" and head[1:].isalpha()):
            tail = chunk[len(head) :]
            return self.memo[head] + (self.short.get(tail) or self._kept(tail, self._pieces(tail)))
        if chunk[0] != "\n":
            return self._pieces(" " + chunk)
        return self._pieces("\n") + self._piece(chunk[1:]) if chunk[1:].isalpha() else self._pieces(chunk)

    def _plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        parts = _SPLIT.split(text) if _ODD.search(text) else text.replace("\n", " \n").split(" ")
        out = [self._pieces(parts[0])]
        for at in range(1, len(parts), STRETCH):
            part = parts[at : at + STRETCH]
            out.append(b"".join(map(self.memo.__getitem__, part)))
            if len(self.memo) > MEMO * RECENT:
                self.recent.update(part)
                if len(self.memo) > MEMO:
                    self._forget()
        return b"".join(out)

    def _forget(self) -> None:
        """Keep what came up lately, at most half of the memo."""
        memo = self.memo
        self.memo = _Memo(self._learn, {c: memo[c] for c in islice(self.recent, MEMO // 2) if c in memo})
        self.recent = set()

    def _marked(self, text: str) -> bytes:
        """The ids of a text with added tokens in it."""
        if any(c in text for c in self.fussy):
            return array(self.code, self.model.encode(text, add_special_tokens=False).ids).tobytes()
        out = []
        for i, part in enumerate(self.marks.split(text)):
            if i % 2:
                out.append(array(self.code, [self.added[part]]).tobytes())
            elif part:
                out.append(self._plain(part))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without END."""
        out = []
        for t in texts:
            ids = self._marked(t) if any(c in t for c in self.added) else self._plain(t)
            out.append(np.frombuffer(ids, dtype=self.dtype))
        return out
