"""Token ids of whole texts with the `tokenizers` library, equal words encoded once per worker.

In a byte-level vocabulary a token lies inside one pre-token, and white space always starts a new pre-token after a
visible character. A text may therefore be cut before each blank and line break that has visible characters on both
sides, and the parts encoded apart. Texts with other white space around such a cut, or with the text of an added token,
are encoded whole, so the ids always equal those of one call on the whole text.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from wattmill.llm.lower_bpe import BYTE_LETTERS

CACHE_ENTRIES = 600_000  # words kept by a Python worker
CHUNK_CHARS = 1 << 20  # text handled between two looks at the cache
ROWS = 512  # documents of a batch that are Python objects at once
JOIN_CHARS = 1 << 16  # new words given to the tokenizer at once
MARKS = ",.!?;:#$%&*|"  # marks that always start a pre-token after a letter
UNCUT = 0  # cache value of a word with white space at an end: its text is encoded whole


class WordEncoder:
    """encode_all(texts) gives the ids of each text as little-endian bytes of `dtype`."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.vocab_size = max(vocab.values()) + 1
        self.code = "H" if self.vocab_size <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.merge = self.tok.model.tokenize
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.blank_first = np.zeros(self.vocab_size, bool)
        self.blank_first[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.cache: dict[str, bytes | int] = {}
        self.any_uncut = False

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text in order; a null text counts as empty."""
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text or "")
            if size > CHUNK_CHARS:
                yield from self._chunk(part)
                part, size = [], 0
        yield from self._chunk(part)

    def _chunk(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        gc.disable()  # nothing here refers to itself; walking all cached words again and again is what would cost
        try:
            return self._cached(texts)
        finally:
            gc.enable()

    def _cached(self, texts: list[str | None]) -> list[bytes]:
        get, cut, new = self.cache.get, [], set()
        for text in texts:
            if not text or "\0" in text or self.added and self.added.search(text):
                cut.append(None)
                continue
            words = ("\0" + text).replace("\n", " \n").split(" ")
            found = list(map(get, words))
            gaps = [i for i, v in enumerate(found) if v is None]
            lost = [words[i] for i in gaps]
            new.update(lost)
            cut.append((found, gaps, lost))
        self._learn(new)
        out = []
        for text, parts in zip(texts, cut):
            if parts is None:
                out.append(self.whole(text) if text else b"")
                continue
            found, gaps, lost = parts
            for i, w in zip(gaps, lost):
                found[i] = self.cache[w]
            out.append(self.whole(text) if self.any_uncut and UNCUT in found else b"".join(found))
        return out

    def _learn(self, words: Iterable[str]) -> None:
        """Encode new words from their parts: letters after a blank or at a line's start, then closing marks."""
        cache, made, parts = self.cache, [], set()
        for w in words:
            head = w[:1]
            text = w[1:] if head == "\n" or head == "\0" else w
            core = text.rstrip(MARKS)
            if core.isalpha():
                first = core if text is w else "\0" + core
                tail = "\0" + text[len(core):] if len(core) < len(text) else ""
                if tail and tail not in cache:
                    parts.add(tail)
            elif not text or text[0].isspace() or text[-1].isspace():
                cache[w] = UNCUT
                self.any_uncut = True
                continue
            else:
                first, tail = text if text is w else "\0" + text, ""
            if first not in cache:
                parts.add(first)
            if first is not w:
                made += (w, first, tail)
        start, size = 0, 0
        for k in [k for k in parts if k[k[0] == "\0":].isalpha()]:  # one run of letters: the merges alone give its ids
            parts.remove(k)
            core = k[1:] if k[0] == "\0" else k
            spelt = core if core.isascii() else core.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = [t.id for t in self.merge(spelt if core is not k else "Ġ" + spelt)]
            cache[k] = array(self.code, ids).tobytes()
        after_blank = [k for k in parts if k[0] != "\0"]
        for i, w in enumerate(after_blank):
            size += len(w) + 1
            if size > JOIN_CHARS or i == len(after_blank) - 1:
                self._learn_joined(after_blank[start:i + 1])
                start, size = i + 1, 0
        alone = [k for k in parts if k[0] == "\0"]
        for k, e in zip(alone, self.encode([k[1:] for k in alone], add_special_tokens=False)):
            self.cache[k] = np.array(e.ids, self.dtype).tobytes()
        newline = self.whole("\n")
        for w, first, tail in zip(made[::3], made[1::3], made[2::3]):
            ids = cache[first] + cache[tail] if tail else cache[first]
            cache[w] = newline + ids if w[0] == "\n" else ids

    def _learn_joined(self, words: list[str]) -> None:
        [e] = self.encode([" " + " ".join(words)], add_special_tokens=False)
        ids = np.array(e.ids, self.dtype)
        at = np.flatnonzero(self.blank_first[ids]) * self.dtype.itemsize
        raw = ids.tobytes()
        if len(at) != len(words):  # a word with blanks that the tokenizer reads in its own way
            self.cache.update((w, self.whole(" " + w)) for w in words)
            return
        cuts = [*at.tolist(), len(raw)]
        self.cache.update((w, raw[a:b]) for w, a, b in zip(words, cuts, cuts[1:]))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary file."""
    return WordEncoder(path)
