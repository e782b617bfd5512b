"""Two tokenizers over the same texts: their ids, common cuts and overlapping pairs, equal words worked out once.

Side A is a byte-level vocabulary of the `tokenizers` library over a blank and the text, side B a `sentencepiece`
vocabulary over the text, which adds the blank itself. No piece of either side reaches over the place before a blank or
line break that has visible characters on both sides, so a text may be cut there and its parts aligned apart. Parts with
other white space around such places are cut at fewer of them. Strings of special tokens are plain text on both sides.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

from wattmill.llm.lower_bpe import BYTE_LETTERS, MARKS

CACHE_ENTRIES = 400_000  # words kept by a Python worker
CHUNK_CHARS = 1 << 20  # text handled between two looks at the cache
UNCUT, UNEQUAL = "uncut", "unequal"  # a word with white space at an end; one whose two spellings differ
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


class WordAligner:
    """aligned(texts) gives per text (groups, codes of all links, number of A ids), or None without tokens.

    groups reads `a1,a2|b1;a3|b2,b3`; a link's code is its A id shifted left by `shift`, plus its B id.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.merge = self.a.model.tokenize
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.length_a = [0] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.length_a[i] = len(token)  # a letter stands for a byte
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        self.length_b = [len(x) for x in self.bytes_b]
        self.shown_a, self.shown_b = (  # an id inside a group's side, and at its end
            [np.array([f"{i}{mark}" for i in range(len(lengths))], object) for mark in marks]
            for lengths, marks in ((self.length_a, ",|"), (self.length_b, ",;")))
        self.shift = (len(self.bytes_b) - 1).bit_length()
        self.code = "I" if len(self.length_a) << self.shift <= 1 << 32 else "Q"
        self.dtype = np.dtype(self.code)
        self.tails: dict[str, list[int]] = {"": []}
        self.cache: dict = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def aligned(self, texts: Iterable[str | None]) -> Iterator[tuple[str, np.ndarray, int] | None]:
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text or "")
            if size > CHUNK_CHARS:
                yield from self._chunk(part)
                part, size = [], 0
        yield from self._chunk(part)

    def _chunk(self, texts: list[str | None]) -> list[tuple[str, np.ndarray, int] | None]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache = {}
        gc.disable()  # nothing here refers to itself
        try:
            cut = [(" " + t).replace("\n", " \n").split(" ")[1:] if t else [] for t in texts]
            self._learn({w for words in cut for w in words if w not in self.cache})
            get, odd = self.cache.__getitem__, []
            found = [list(map(get, words)) for words in cut]
            for i, parts in enumerate(found):
                if UNCUT in parts:
                    cut[i] = [self._key(s) for s in CUT.split(" " + texts[i])]
                    odd.append(i)
            if odd:
                self._learn({w for i in odd for w in cut[i] if w not in self.cache})
                for i in odd:
                    found[i] = list(map(get, cut[i]))
            return [self._joined(parts) for parts in found]
        finally:
            gc.enable()

    @staticmethod
    def _plain(word: str) -> bool:
        body = word[1:] if word[:1] == "\n" else word
        return bool(body) and not body[0].isspace() and not body[-1].isspace()

    def _key(self, part: str) -> str | tuple[str]:
        """The cache's name of a part: as the words of plain texts have it, else the part itself in a tuple."""
        word = part if part[0] == "\n" else part[1:]
        return word if (word[:1] == "\n") == (part[0] == "\n") and self._plain(word) else (part,)

    def _joined(self, parts: list) -> tuple[str, np.ndarray, int] | None:
        if not parts or UNEQUAL in parts:
            return None
        groups, links, counts = zip(*parts)
        return "".join(groups)[:-1], np.frombuffer(b"".join(links), self.dtype), sum(counts)

    def _learn(self, new: set) -> None:
        """Align new words. A run of letters after a blank goes to the merges of A alone, closing marks after it apart."""
        cache, words, fulls, short, others = self.cache, [], [], {}, []
        for w in new:
            if type(w) is tuple:
                full = w[0]
            elif self._plain(w):
                full = w if w[0] == "\n" else " " + w
                core = w.rstrip(MARKS)
                if core.isalpha():
                    tail = w[len(core):]
                    if tail not in self.tails:
                        self.tails[tail] = self.a.encode(tail, add_special_tokens=False).ids
                    spelt = core if core.isascii() else core.encode().decode("latin-1").translate(BYTE_LETTERS)
                    short[len(words)] = [t.id for t in self.merge("Ġ" + spelt)] + self.tails[tail]
            else:
                cache[w] = UNCUT
                continue
            if len(words) not in short:
                others.append(len(words))
            words.append(w)
            fulls.append(full)
        for i, e in zip(others, self.a.encode_batch_fast([fulls[i] for i in others], add_special_tokens=False)):
            short[i] = e.ids
        ids_b = [b if f[0] == " " else b[1:] for f, b in zip(
            fulls, self.b.encode([f[1:] if f[0] == " " else f for f in fulls], num_threads=1))]
        for i, (w, full, b) in enumerate(zip(words, fulls, ids_b)):
            if sum(map(self.length_b.__getitem__, b)) != len(full.encode()):
                cache[w] = UNEQUAL
        kept = [i for i, w in enumerate(words) if w not in cache]
        if kept:
            self._align([words[i] for i in kept], [fulls[i] for i in kept], [short[i] for i in kept],
                        [ids_b[i] for i in kept])

    def _align(self, words: list, fulls: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> None:
        """Align words whose two spellings have equal lengths, all at once: their ends in bytes run on from word to word."""
        flat_b = list(chain.from_iterable(ids_b))
        if b"".join(map(self.bytes_b.__getitem__, flat_b)) != "".join(fulls).encode():
            unequal = {w for w, full, b in zip(words, fulls, ids_b)
                       if b"".join(map(self.bytes_b.__getitem__, b)) != full.encode()}
            self.cache.update(dict.fromkeys(unequal, UNEQUAL))
            rest = [row for row in zip(words, fulls, ids_a, ids_b) if row[0] not in unequal]
            return self._align(*map(list, zip(*rest))) if rest else None
        count_a = np.fromiter(map(len, ids_a), np.int64, len(words))
        count_b = np.fromiter(map(len, ids_b), np.int64, len(words))
        a = np.fromiter(chain.from_iterable(ids_a), np.int64, int(count_a.sum()))
        b = np.array(flat_b, np.int64)
        ends_a, ends_b = np.cumsum(np.array(self.length_a)[a]), np.cumsum(np.array(self.length_b)[b])
        last_a = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a
        last_b = ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
        ends = np.sort(np.concatenate([ends_a, ends_b[~last_b]]))  # between two of these, one A and one B token overlap
        links = (a[np.searchsorted(ends_a, ends)] << self.shift) + b[np.searchsorted(ends_b, ends)]
        cuts = np.searchsorted(ends, ends_a[np.cumsum(count_a) - 1], side="right") * self.dtype.itemsize
        raw, cuts = links.astype(self.dtype).tobytes(), [0, *cuts.tolist()]
        group = np.concatenate([2 * (np.cumsum(last_a) - last_a), 2 * (np.cumsum(last_b) - last_b) + 1])
        shown = np.concatenate([np.where(last_a, self.shown_a[1][a], self.shown_a[0][a]),
                                np.where(last_b, self.shown_b[1][b], self.shown_b[0][b])])
        shown = shown[np.argsort(group, kind="stable")].tolist()
        stops = [0, *np.cumsum(count_a + count_b).tolist()]
        for w, n, s, e, p, q in zip(words, count_a.tolist(), stops, stops[1:], cuts, cuts[1:]):
            self.cache[w] = "".join(shown[s:e]), raw[p:q], n


@lru_cache(maxsize=1)
def word_aligner(path_a: str, path_b: str) -> WordAligner:
    """One aligner per worker and pair of vocabulary files."""
    return WordAligner(path_a, path_b)
