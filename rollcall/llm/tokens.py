"""Token ids by the ``tokenizers`` library, each distinct slice of text encoded once per worker.

A text is cut only where the vocabulary's own splitting always cuts, so the
ids are those the library gives for the whole text:

* ``byte`` files (byte-level, the usual pattern): at single spaces and line
  ends between characters that are not white space; a slice not in the cache is
  cut again by the pattern itself.  Texts with other white space, or with runs
  of it, are cut by the pattern as a whole.
* ``word`` files (white space dropped): at spaces and line ends, and
  before a final comma or full stop after letters.

Strings of the file's added tokens become those tokens, as in the library;
texts are cut around them first, and each part is split on its own.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
RUNS = ("  ", "\n\n", " \n", "\n ", " \0")  # the last is no run, but a slice must not begin with a mark
SPACE = "\u0120"  # how byte-level files write a space
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def letters(word: str) -> bool:
    """Whether a word is letters only, also after the normalisation of ``word`` files (which can split off accents)."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class Numbers(dict):
    """Numbers of slices in the order they are first asked for; ``fresh`` lists those met since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.next = 0

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        n = self[key] = self.next
        self.next += 1
        return n


class SliceEncoder:
    """Encodes whole texts with the tokenizer file at ``path``; at most ``cache`` slices are remembered.

    A slice has a number; the ids of all slices lie in one array, so the ids of
    texts are gathered by numpy.  In ``byte`` files a slice stands for its text
    after a space, or for the text behind a mark: ``\\0`` for nothing, a line end
    for itself.
    """

    LONG = 64  # slices with more characters are forgotten after each call
    JOINED = 128  # plain words that are given to the library as one text

    def __init__(self, path: str, cache: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec["added_tokens"]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError(f"{path}: added tokens must match plainly")
        self.added = sorted((a["content"] for a in added), key=len, reverse=True)
        self.cut_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split
        self.by_word = spec["normalizer"] is not None
        self.split = regex.compile(PATTERN).findall
        self.most = cache
        # ids that end a word (``word`` files with a suffix for it) or begin with its space (``byte`` files)
        suffix = spec["model"].get("end_of_word_suffix")
        vocab = self.lib.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for t, i in vocab.items() if (suffix and t.endswith(suffix) if self.by_word else t.startswith(SPACE))]] = True
        self._forget()

    def _forget(self) -> None:
        self.numbers = Numbers()
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _store(self, keys: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        """Keep the ids of numbered slices."""
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(self.used + 2 * len(flat), "<u4")])
        if self.numbers.next > len(self.start):
            more = 2 * self.numbers.next - len(self.start)
            self.start, self.size = (np.append(x, np.zeros(more, x.dtype)) for x in (self.start, self.size))
        at = np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))
        self.ids[self.used:self.used + len(flat)] = flat
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.size[at] = sizes
        self.used += len(flat)

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of slices one after the other, and the number of ids of each."""
        size = self.size[rows].astype(np.int64)
        ends = np.cumsum(size)
        at = np.repeat(self.start[rows] - (ends - size), size)
        at += np.arange(len(at))
        return self.ids[at], size

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        run = getattr(self.lib, "encode_batch_fast", self.lib.encode_batch)
        ids = [e.ids for e in run(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), "<u4", int(sizes.sum())), sizes

    def _atoms(self, keys: list[str]) -> None:
        """Slices that the library gets as they are; plain words many at a time, cut again at the ids that mark their edges."""
        plain, rest = [], []
        for k in keys:
            (plain if k.isascii() and k.isalpha() else rest).append(k)
        if plain:
            words = plain if self.by_word else [" " + k for k in plain]
            glue = " " if self.by_word else ""
            flat, _ = self._library([glue.join(words[i:i + self.JOINED]) for i in range(0, len(words), self.JOINED)])
            edges = np.flatnonzero(self.edge[flat])
            if len(edges) == len(words):
                sizes = np.diff(edges, prepend=-1) if self.by_word else np.diff(edges, append=len(flat))
            else:
                flat, sizes = self._library(words)
            self._store(plain, sizes, flat)
        if rest:
            flat, sizes = self._library([k if self.by_word or k in self.added else k[1:] if k[:1] == "\0" else " " + k for k in rest])
            self._store(rest, sizes, flat)

    def _parts(self, key: str) -> list[str] | tuple[str, ...]:
        """Slices that the library is asked for: words and final stops apart, the rest by the pattern."""
        if key in self.added:
            return (key,)
        if self.by_word:
            return (key[:-1], key[-1]) if len(key) > 1 and key[-1] in ",." and letters(key[:-1]) else (key,)
        if key.isalpha():
            return (key,)
        mark, word = key[:1], key[1:]
        if mark == "\n":
            before: list[str] = ["\0\n"]
        elif mark == "\0":
            before = []
        else:
            before, word = [], " " + key
        body = word[:-1] if word[-1:] in (",", ".") else word
        if body.lstrip(" ").isalpha():
            found = [body] if body is word else [body, word[-1]]
        else:
            found = self.split(word)
        return before + [w[1:] if w[:1] == " " and w[1:2] not in ("", " ", "\0", "\n") and w not in self.added else "\0" + w for w in found]

    def _learn(self) -> None:
        """Store the ids of all slices that got a number but no ids yet; long ones last, so that they can be forgotten."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        atoms: list[str] = []
        made: tuple[list, list] = [], []
        for k in fresh:
            parts = self._parts(k)
            if len(parts) == 1 and parts[0] == k:
                atoms.append(k)
            else:
                made[len(k) > self.LONG].append((k, parts))
        lengths = [np.fromiter((len(p) for _, p in m), np.int64, len(m)) for m in made]
        rows = [np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(p for _, p in m)), np.int64, int(n.sum()))
                for m, n in zip(made, lengths)]
        atoms += self.numbers.fresh
        self.numbers.fresh = []
        for long in (False, True):
            if long:
                self.kept = self.used
            self._atoms([k for k in atoms if (len(k) > self.LONG) == long])
            if made[long]:
                flat, sizes = self._gather(rows[long])
                cuts = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths[long])])]
                self._store([k for k, _ in made[long]], np.diff(cuts), flat)
        self.long = [k for k in chain(fresh, atoms) if len(k) > self.LONG]

    def _slices(self, text: str) -> list[str]:
        """Slices of a text: a word after a space as it is, after a line end or at the start with a mark before it.

        No other slice holds the text of an added token, so that text is its own key.
        """
        if any(a in text for a in self.added):
            parts = self.cut_added(text)
            return [s for i, part in enumerate(parts) for s in ([part] if i % 2 else self._slices(part))]
        if not text:
            return []
        if self.by_word:
            return text.replace("\n", " ").split(" ")
        if any(r in text for r in RUNS) or text[:1].isspace() or text[-1:].isspace() or OTHER_SPACE.search(text):
            return ["\0" + text]
        out = text.replace("\n", " \n").split(" ")
        out[0] = "\0" + out[0]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        slices = [self._slices(t) for t in texts]
        if self.numbers.next > self.most or self.used > 8 * self.most:
            self._forget()
        of = list(map(len, slices))
        rows = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(slices)), np.int64, sum(of))
        fresh = bool(self.numbers.fresh)
        if fresh:
            self._learn()
        flat, sizes = self._gather(rows)
        if fresh:
            for k in self.long:
                self.numbers.pop(k, None)
            self.used = self.kept
        at = np.concatenate([[0], np.cumsum(sizes)])
        return flat, np.diff(at[np.cumsum(of, dtype=np.int64)], prepend=0)


@lru_cache(maxsize=2)
def load(path: str) -> SliceEncoder:
    return SliceEncoder(path)


def text_groups(texts: list, most: int = 2_000_000):
    """Runs of texts (null as empty) of about ``most`` characters; a longer text stands alone."""
    group, held = [], 0
    for t in texts:
        t = t or ""
        if group and held + len(t) > most:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group
