"""Suffix and common-prefix arrays by external induced sorting, as far as ``depth`` characters.

The suffixes that start a rising run after a falling one (*LMS*) are sorted
first: one induction with them in any order sorts the pieces between them, the
pieces are named, and the string of names is sorted in turn.  From their order
two scans induce all others.  A scan keeps one queue per first character; a
suffix enters the queue of the character before it when it is scanned, so every
queue is in order of arrival and together they are a priority queue by
(character, rank of the rest).  Common prefixes of neighbours are compared
afterwards, seven characters at a time.

Queues hold arrays; above ``memory`` bytes the longest queues go to an
anonymous temporary file and are read back when their character is scanned.
"""

from __future__ import annotations

import tempfile

import numpy as np

U = np.uint64


class Queues:
    """First-in-first-out arrays of positions per character, spilling to disk."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.parts: dict[int, list] = {}
        self.file = None

    def push(self, char: int, pos: np.ndarray) -> None:
        self.parts.setdefault(char, []).append(pos)
        self.held += 8 * len(pos)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for parts in self.parts.values():
            for i, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(part.astype("<i8").tobytes())
                    parts[i] = (at, len(part))
        self.held = 0

    def take(self, char: int) -> np.ndarray | None:
        parts = self.parts.pop(char, None)
        if not parts:
            return None
        out = []
        for part in parts:
            if isinstance(part, np.ndarray):
                self.held -= 8 * len(part)
            else:
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(8 * part[1]), "<i8")
            out.append(part)
        return out[0] if len(out) == 1 else np.concatenate(out)


def kinds(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S type); the last character is."""
    step = np.sign(np.diff(text.astype(np.int32)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    rising = np.append(step, 1)[nxt] > 0
    return np.append(rising, True)


class Inducer:
    """Both scans over one text (values from 0; the last one a unique least)."""

    def __init__(self, text: np.ndarray, memory: int):
        self.text, self.memory = text, memory
        self.rising = kinds(text)
        self.chars = np.flatnonzero(np.bincount(text)).tolist()
        self.none = self.chars[-1] + 1

    def _scan(self, chars, want_rising: bool, seeds: dict) -> dict:
        """One scan: per character the induced suffixes in scan order."""
        queues = Queues(self.memory)
        # the queue that the suffix before enters, or ``none``
        target = np.full(len(self.text), self.none, np.uint16)
        np.copyto(target[1:], self.text[:-1], where=self.rising[:-1] == want_rising, casting="unsafe")

        def scanned(pos: np.ndarray) -> None:
            to = target[pos]
            use = np.flatnonzero(to != self.none)
            if not len(use):
                return
            to = to[use]
            order = np.argsort(to, kind="stable")
            to = to[order]
            moved = pos[use[order]] - 1
            cuts = np.flatnonzero(to[1:] != to[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for char, a, b in zip(to[starts].tolist(), starts, [*starts[1:], len(to)]):
                queues.push(char, moved[a:b])

        done: dict[int, np.ndarray] = {}
        for char in chars:
            own: list = []
            while (got := queues.take(char)) is not None:
                own.append(got)
                scanned(got)
            if own:
                done[char] = np.concatenate(own)
            if char in seeds:
                scanned(seeds[char])
        return done

    def sort(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes in order, from the sorted ``lms`` suffixes."""
        cuts = np.searchsorted(self.text[lms], self.chars + [self.none])
        falling = self._scan(self.chars, False, {c: lms[a:b] for c, a, b in zip(self.chars, cuts, cuts[1:]) if b > a})
        rising = self._scan(self.chars[::-1], True, {c: pos[::-1] for c, pos in falling.items()})
        rising[self.chars[0]] = np.array([len(self.text) - 1])
        return np.concatenate([part for c in self.chars for part in (falling.get(c), rising[c][::-1] if c in rising else None) if part is not None])


WORD, BITS = 7, U(9)  # characters in a word


def _words(text: np.ndarray) -> np.ndarray:
    """The characters from every position on, ``WORD`` to a number; behind the end there are zeros."""
    one = np.zeros(len(text) + WORD, U)
    one[:len(text)] = text
    two = one[:-1] << BITS | one[1:]
    four = two[:-2] << U(2) * BITS | two[2:]
    n = len(text)
    return four[:n] << U(3) * BITS | two[4:n + 4] << BITS | one[6:n + 6]


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of many pairs of different suffixes, up to ``depth``; the text ends with its only 0."""
    out = np.full(len(a), depth, np.uint8)
    alive = np.arange(len(a))
    for k in range(0, depth, WORD):
        differ = words[a] ^ words[b]
        here = differ != 0
        # the first character that differs, by the highest bit (a number rounded up to the next power counts as the first)
        high = np.frexp((differ[here] >> BITS).astype(np.float64))[1]
        out[alive[here]] = np.minimum(k + np.maximum(9 * (WORD - 1) - high, 0) // 9, depth)
        # the last character is unique, so pairs differ before either ends
        alive, a, b = (x[~here] for x in (alive, a, b))
        if not len(alive):
            break
        a += WORD
        b += WORD
    return out


def _names_in_order(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes of a string of names, by as many names as ``depth`` characters may hold: twice as many in each round."""
    span, found = 1, int(names.max()) + 1
    while span * 2 < depth + 2 and found < len(names):  # a name stands for two characters at least
        pair = names * (len(names) + 2)
        pair[:-span] += names[span:] + 1
        order = np.argsort(pair)
        pair = pair[order]
        names = np.empty(len(order), np.int64)
        names[order] = np.concatenate([[0], np.cumsum(pair[1:] != pair[:-1])])
        before, found = found, int(names.max()) + 1
        if found == before:  # names that twice as many do not part are never parted
            break
        span *= 2
    return names


def suffix_array(text: np.ndarray, depth: int, memory: int = 128 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in order of their first ``depth`` values, and common prefixes with the one before (at most ``depth``).

    ``text`` holds integers from 0 to 511; its last value is the only 0.
    """
    inducer = Inducer(text, memory)
    rising = inducer.rising
    words = _words(text)
    lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    if len(lms) < 2:
        order = lms
    else:
        # pieces between LMS positions, sorted by an induction from any order within a first character
        every = inducer.sort(lms[np.argsort(text[lms], kind="stable")])
        mark = np.zeros(len(text), bool)
        mark[lms] = True
        order = every[mark[every]]
        number = np.zeros(len(text), np.int64)
        number[lms] = np.arange(len(lms))
        stop = np.append(lms[1:], len(text) - 1)
        length = np.minimum(stop - lms + 1, depth)
        n = number[order]
        same = length[n[1:]] == length[n[:-1]]
        near = np.flatnonzero(same)
        same[near] = _common(words, order[near], order[near + 1], depth) >= length[n[near]]
        names = np.zeros(len(lms), np.int64)
        names[n[1:]] = np.cumsum(~same)
        order = lms[np.argsort(_names_in_order(names, depth), kind="stable")]
    order = inducer.sort(order)
    common = np.zeros(len(order), np.uint8)
    common[1:] = _common(words, order[:-1], order[1:], depth)
    return order, common
