"""Token ids of a vocabulary that lower-cases words, drops white space and ends each word with a marked token.

Such a vocabulary never looks past a blank or a line break, so a text's ids are those of its words one after another,
and equal words are encoded once per worker. A run of letters goes to the merges alone, lower-cased here; words that
could be changed in another way by the normaliser go through all of the tokenizer, and so do whole texts that hold the
text of an added token.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np

CACHE_ENTRIES = 800_000  # words kept by a Python worker
CHUNK_CHARS = 1 << 20  # text handled between two looks at the cache
MARKS = ",.!?;:#$%&*|"  # marks that are a word of their own after letters
SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that spell themselves
BYTE_LETTERS = {b: b for b in SHOWN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}


class LowerWordEncoder:
    """encode_all(texts) gives the ids of each text as bytes of `dtype`."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.code = "H" if size <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.merge = self.tok.model.tokenize
        self.cache: dict[str, bytes] = {"": b""}

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text in order; a null text counts as empty."""
        part, size = [], 0
        for text in texts:
            part.append(text or "")
            size += len(part[-1])
            if size > CHUNK_CHARS:
                yield from self._chunk(part)
                part, size = [], 0
        yield from self._chunk(part)

    def _chunk(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache = {"": b""}
        gc.disable()  # nothing here refers to itself
        try:
            get, cut, new = self.cache.get, [], set()
            for text in texts:
                if self.added and "<|" in text and self.added.search(text):
                    cut.append(None)
                    continue
                words = text.replace("\n", " ").split(" ")
                found = list(map(get, words))
                gaps = [i for i, v in enumerate(found) if v is None]
                lost = [words[i] for i in gaps]
                new.update(lost)
                cut.append((found, gaps, lost))
            self._learn(new)
            out = []
            for text, parts in zip(texts, cut):
                if parts is None:
                    out += self.whole([text])
                    continue
                found, gaps, lost = parts
                for i, w in zip(gaps, lost):
                    found[i] = self.cache[w]
                out.append(b"".join(found))
            return out
        finally:
            gc.enable()

    def _learn(self, new: set[str]) -> None:
        """Encode new words: a run of letters by the merges alone, closing marks after it apart, others as texts."""
        cache, others, made = self.cache, {}, []
        for w in new:
            core = w.rstrip(MARKS)
            low = self._lowered(core)
            if low is None:
                others[w] = None
                continue
            if low not in cache:
                spelt = low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_LETTERS)
                cache[low] = array(self.code, [t.id for t in self.merge(spelt)]).tobytes()
            tail = w[len(core):]
            if tail and tail not in cache:
                others[tail] = None
            if w is not low:
                made.append((w, low, tail))
        cache.update(zip(others, self.whole(list(others))))
        for w, low, tail in made:
            cache[w] = cache[low] + cache[tail]

    @staticmethod
    def _lowered(core: str) -> str | None:
        """What the normaliser makes of a run of letters; None where that may not be one run, or hangs on neighbours."""
        if not core.isalpha():
            return None
        if core.isascii():
            return core.lower()
        low = core.lower()
        plain = "Σ" not in core and is_normalized("NFC", core) and low.isalpha() and len(low) == len(core)
        return low if plain else None


@lru_cache(maxsize=2)
def lower_encoder(path: str) -> LowerWordEncoder:
    """One encoder per worker and vocabulary file."""
    return LowerWordEncoder(path)
