"""Token ids of whole texts with a public tokenizer, with a bounded memory of words already seen."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Latin letters (those of Latin-1 that are letters, all of them in composed form).
LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_path(name_or_path: str) -> str:
    """A path as it is; a bare file name is looked up among the public tokenizers installed on this machine."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all items of the runs, one run after the other, and where each run begins there (one more than runs)."""
    edge = np.concatenate([[0], np.cumsum(lengths)])
    return np.repeat(starts - edge[:-1], lengths) + np.arange(edge[-1]), edge


class WordTokenizer:
    """Encodes texts word by word, for tokenizers that drop white space and never join across it.

    ``word_bpe_49k.json`` is such a tokenizer: its pre-tokenizer drops white space and its pieces end with words, so
    the ids of a text are those of its words, one after the other. Words (runs without ASCII white space) are encoded
    once and kept under a 64-bit hash in flat arrays; at ``most`` words the memory starts afresh, which bounds it
    whatever the corpus holds.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        self.most = most
        vocabulary = self.tokenizer.get_vocab()
        #: Which ids end a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << 18, dtype=np.uint64)
        self.entry = np.zeros(1 << 18, dtype=np.int32)
        self.pool = np.zeros(1 << 20, dtype=np.uint32)
        self.starts = np.zeros(1 << 17, dtype=np.int64)
        self.lengths = np.zeros(1 << 17, dtype=np.int32)
        self.words = self.used = 0

    # A hash table with open places: a key stands at its low bits or in the first free place after them.

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 for those that aren't known."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(h), -1, dtype=np.int64)
        left, at = None, (h & mask).astype(np.int64)
        while len(at):
            key, want = self.keys[at], h if left is None else h[left]
            hit = key == want
            spots = np.flatnonzero(hit)
            out[spots if left is None else left[spots]] = self.entry[at[spots]]
            on = np.flatnonzero(~hit & (key != 0))
            left, at = on if left is None else left[on], (at[on] + 1) & int(mask)
        return out

    def _place(self, h: np.ndarray, entries: np.ndarray) -> None:
        """Put distinct, unknown hashes into the table."""
        at = (h & np.uint64(len(self.keys) - 1)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = h[free]  # of several at one place the last stays
            won = free[self.keys[at[free]] == h[free]]
            self.entry[at[won]] = entries[won]
            rest = np.ones(len(h), dtype=bool)
            rest[won] = False
            h, entries, at = h[rest], entries[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _keep(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        first, last = self.words, self.words + len(h)
        while last > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[first:last] = self.used + np.cumsum(n) - n
        self.lengths[first:last] = n
        self.used, self.words = self.used + len(ids), last
        if 2 * last > len(self.keys):
            old, entries = self.keys, self.entry
            size = len(old)
            while 2 * last > size:
                size *= 2
            self.keys, self.entry = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int32)
            full = np.flatnonzero(old)
            self._place(old[full], entries[full])
        self._place(h, np.arange(first, last, dtype=np.int32))

    def _runs(self, words: list[bytes]) -> None:
        """Learn words that are one pre-token each; every one ends with an id that ends a word, so they are encoded together."""
        for a in range(0, len(words), 1024):
            part = words[a : a + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
            self._keep(_hashes(part), ids, np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0))

    def _alone(self, words: list[bytes]) -> None:
        for a in range(0, len(words), 1024):
            part = words[a : a + 1024]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)]
            self._keep(_hashes(part), np.array([i for x in found for i in x], dtype=np.uint32), np.fromiter(map(len, found), dtype=np.int64, count=len(found)))

    def _unknown(self, words: list[bytes]) -> list[bytes]:
        words = list(dict.fromkeys(words))
        return [words[i] for i in np.flatnonzero(self._find(_hashes(words)) < 0).tolist()]

    def _learn(self, words: list[bytes]) -> None:
        # A run of Latin letters is one pre-token, and so is a run of marks behind it, which ends with the word: such
        # a word has the ids of its letters, then those of its marks. Any other word is encoded as it is.
        runs, heads, tails, split, others = [], [], [], [], []
        for w in words:
            if w.isalpha():
                runs.append(w)
            elif (head := w.rstrip(MARKS)) and (head.isalpha() or LATIN(head)):
                if len(head) == len(w):
                    runs.append(w)
                else:
                    heads.append(head), tails.append(w[len(head) :]), split.append(w)
            else:
                others.append(w)
        self._runs(runs)
        self._alone(others)
        if split:
            self._runs(self._unknown(heads))
            self._alone(self._unknown(tails))
            both = np.stack([self._find(_hashes(heads)), self._find(_hashes(tails))], axis=1).ravel()
            n = self.lengths[both].astype(np.int64)
            places, _ = _spread(self.starts[both], n)
            self._keep(_hashes(split), self.pool[places], n.reshape(-1, 2).sum(axis=1))

    def encode(self, docs: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``docs`` in one array, each followed by ``end``, and the place where each document begins (one more than documents)."""
        # The tokenizer lower-cases. Doing so first finds more words among those seen; only plain ASCII texts without
        # special tokens are sure to give the same ids.
        split = [(d.lower() if d.isascii() and b"<|" not in d else d).split() for d in docs]
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        words = [w for s in split for w in s]
        if self.words > self.most:
            self._clear()
        h = _hashes(words)
        at = self._find(h)
        if len(missing := np.flatnonzero(at < 0)):
            _, first = np.unique(h[missing], return_index=True)
            self._learn([words[i] for i in missing[first].tolist()])
            at[missing] = self._find(h[missing])
        places, edge = _spread(self.starts[at], self.lengths[at].astype(np.int64))
        ids = self.pool[places]
        offsets = edge[np.concatenate([[0], np.cumsum(counts)])]
        if end is not None:
            ids = np.insert(ids, offsets[1:], np.uint32(end))
            offsets = offsets + np.arange(len(offsets))
        return ids, offsets


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.maximum(np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)), np.uint64(1))


_kept: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker; its memory of words lives as long as the worker."""
    if path not in _kept:
        _kept[path] = WordTokenizer(path)
    return _kept[path]
