"""Token ids of whole texts by the tokenizers library, through a cache of space-delimited chunks.

Both supported kinds split a text into pre-tokens before merging, and a single space between two
other characters always starts a new pre-token.  So a text is the sequence of its chunks, and a
chunk's ids do not depend on its neighbours; each distinct chunk is encoded once per worker.  A
text in which a space has white space on both sides, or which may hold a special token, is encoded
whole instead.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import compress, takewhile

import numpy as np

#: Chunks kept per worker before the cache starts anew.
CACHE_CHUNKS = 1_500_000
#: Longer texts are taken in segments of about so many characters, cut where a chunk starts.
SEGMENT_CHARS = 1 << 20

_UNSAFE = re.compile(r"\s \s")
#: White space to Python but not to the library.
_SEPARATORS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f")
_LATIN_LOWER = bytes(ord(chr(c).lower()) for c in range(256))
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A first chunk has no space before it; this mark, which no chunk can start with, tells it apart.
_HEAD = " "


def _plain(letters: str) -> bool:
    """Whether letters stay letters in lower case (that of U+0130 ends in a combining mark, which a
    stop joins) and are old enough for all tables of letters to agree."""
    return letters.isascii() or max(letters) < "\u0250" and "\u0130" not in letters


class ChunkEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes, as the library
    does with ``add_special_tokens=False``: none is added, those written in a text are found."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        self.cache_chunks = cache_chunks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # what any added token starts with, up to its first letter, which a normalizer might change
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = {"".join(takewhile(lambda c: c.lower() == c.upper(), t)) for t in added}
        self.drops_space = self.tokenizer.normalizer is not None
        vocabulary = sorted(self.tokenizer.get_vocab().items(), key=lambda item: item[1])
        # what a token adds to its chunk: a finished pre-token, or its bytes
        self.adds = np.zeros(vocabulary[-1][1] + 1, np.int64)
        for token, i in vocabulary:
            self.adds[i] = token.endswith("</w>") if self.drops_space else len(token)
        self.stops = dict(zip(".,", self.whole([".", ","])))
        self.line_end = self.whole(["\n"])[0]
        self.cache: dict[str, bytes] = {}
        self.odd = False

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts encoded as they are."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _weights(self, chunks: list[str]) -> list[int]:
        """What each chunk's tokens add up to; 0 if it has to be encoded by itself."""
        if not self.drops_space:  # the space before it, and its bytes
            return [len(b) + 1 if b and not c[0].isspace() else 0 for c, b in zip(chunks, map(str.encode, chunks))]
        return [1 if c.isalpha() and _plain(c) else 0 for c in chunks]

    def _joined(self, chunks: list[str], weights: list[int]) -> list[bytes]:
        """Ids of chunks from one encoding of many, told apart by their weights."""
        if not chunks:
            return []
        raw = b"".join(self.whole([" " + " ".join(chunks[i : i + 2048]) for i in range(0, len(chunks), 2048)]))
        sums = np.cumsum(self.adds[np.frombuffer(raw, np.uint32)])
        cuts = np.searchsorted(sums, np.cumsum(weights)) + 1
        if cuts[-1] != len(sums):
            raise ValueError("the vocabulary does not keep chunks apart")
        cuts = [0, *(4 * cuts).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Encode new chunks; one that ends in a stop after a plain letter takes the ids of its word.
        Chunks over a line end hardly ever come again: they are returned and not kept."""
        cache, stops = self.cache, self.stops
        lines = {} if self.drops_space else self._lines(missing)
        missing.difference_update(lines)
        missing.update([part for pair in lines.values() for part in pair if part not in cache])
        stopped = [c for c in missing if c[-1:] in stops and c[-2:-1].isalpha() and _plain(c[-2]) and c[0] != _HEAD]
        missing.difference_update(stopped)
        missing.update([c for c in [c[:-1] for c in stopped] if c not in cache])
        heads = [] if self.drops_space else [c for c in missing if c[:1] == _HEAD]
        plain = list(missing.difference(heads))
        weights = self._weights(plain)
        alone = [c for c, w in zip(plain, weights) if not w]
        joined = list(compress(plain, weights)) if alone else plain
        if alone and not self.drops_space:
            self.odd = True
        cache.update(zip(heads, self.whole([c[1:] for c in heads])))
        cache.update(zip(alone, self.whole([c if self.drops_space else " " + c for c in alone])))
        cache.update(zip(joined, self._joined(joined, [w for w in weights if w])))
        cache.update([(c, cache[c[:-1]] + stops[c[-1]]) for c in stopped])
        return {c: cache[a] + self.line_end + cache[b] for c, (a, b) in lines.items()}

    @staticmethod
    def _lines(chunks: set[str]) -> dict[str, tuple[str, str]]:
        """Chunks with one line end between other characters, which is a pre-token by itself: the
        part before it, and the part after it, which has no space before."""
        found = {}
        for c in chunks:
            if "\n" in c and c[0] != _HEAD:
                a, _, b = c.partition("\n")
                if a and b and "\n" not in b and not a[-1].isspace() and not b[0].isspace() and not a[0].isspace():
                    found[c] = a, _HEAD + b
        return found

    def _split(self, text: str) -> list[str]:
        """Chunks of a text.  Where white space is dropped any of it parts chunks, and where case
        is too, texts of Latin characters (whose lower case needs no context) are lowered first."""
        if not self.drops_space:
            chunks = text.split(" ")
            chunks[0] = _HEAD + chunks[0]
            return chunks
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split(" ")
        if any(x in raw for x in _SEPARATORS):
            return text.split(" ")
        return raw.translate(_LATIN_LOWER).decode("latin-1").split()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.cache_chunks:
            self.cache.clear()
        flat: list[str] = []
        ends = [0]
        for text in texts:
            flat += self._split(text)
            ends.append(len(flat))
        ids = list(map(self.cache.get, flat))
        new = [i for i, v in enumerate(ids) if v is None]
        if new:
            passing = self._learn({flat[i] for i in new})
            for i in new:
                chunk = flat[i]
                ids[i] = passing[chunk] if chunk in passing else self.cache[chunk]
        out = [b"".join(ids[a:b]) for a, b in zip(ends, ends[1:])]
        if self.odd:
            unsafe = [i for i, t in enumerate(texts) if _UNSAFE.search(t)]
            for i, whole in zip(unsafe, self.whole([texts[i] for i in unsafe])):
                out[i] = whole
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if odd:
            out = self._chunked([t for t in texts if not any(s in t for s in self.special)])
            for i, whole in zip(odd, self.whole([texts[i] for i in odd])):
                out.insert(i, whole)
            return out
        return self._chunked(texts)

    def _chunked(self, texts: list[str]) -> list[bytes]:
        if all(len(t) <= SEGMENT_CHARS for t in texts):
            return self._encode(texts)
        out = []
        for text in texts:
            parts, start = [], 0
            while len(text) - start > SEGMENT_CHARS and (m := _CUT.search(text, start + SEGMENT_CHARS)):
                parts.append(self._segment(text[start : m.start()], start > 0))
                start = m.start() + 1
            parts.append(self._segment(text[start:], start > 0))
            out.append(b"".join(parts))
        return out

    def _segment(self, segment: str, inner: bool) -> bytes:
        return self._encode([" " + segment if inner and not self.drops_space else segment])[0]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str, cache_chunks: int = CACHE_CHUNKS) -> ChunkEncoder:
    """The worker's encoder of a vocabulary file, which keeps about ``cache_chunks`` chunks from now on."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    _encoders[path].cache_chunks = cache_chunks
    return _encoders[path]


def default_path(name: str) -> str:
    """Place of a public vocabulary file; nothing is copied into the repository."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
