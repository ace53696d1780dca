"""A run-length index: the run-compressed Burrows-Wheeler transform of many short strings.

Suffixes end at their own string's end, equal ones in the order of the strings. A run is a
stretch of rows whose suffixes follow the same character; each keeps that character, where
its rows go when they are one character longer, and as samples the text positions of its
first and its last suffix. In repetitive input there are far fewer runs than bytes.

Strings, held or not, are streamed through the index from their ends. At each character
the longest match of what begins there is known by a row, a text position and a length: if
the row follows that character, row and position move on; if not, the matching statistics
go on from the nearest runs that do, at their sampled ends, with as much of the match as
the text there shares. Beside the runs stands, run-length coded over the rows, the least
owner of all suffixes that share their first K bytes, which is what a match of K bytes or
more asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Symbols in a first key (9 bits each), which doubles until whole strings are covered.
PACK = 7
#: Stands for no owner: larger than any.
NO_OWNER = np.iinfo(np.int64).max


def _text(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (byte + 1, 0 behind each string), where strings start, their lengths."""
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    text = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8).astype(np.int16) + np.int16(1)
    starts = np.cumsum(lengths + 1) - lengths - 1
    text[starts + lengths] = 0
    return text, starts, lengths


class RunIndex:
    def __init__(self, strings: list[bytes], owners: np.ndarray, k: int):
        self.k = k
        self.text, _, lengths = _text(strings)
        text, n = self.text, len(self.text)
        left = np.repeat(np.cumsum(lengths + 1) - 1, lengths + 1) - np.arange(n)  # bytes up to the string's end
        key = np.zeros(n, np.int64)
        for j in range(PACK):
            shifted = np.zeros(n, np.int64)
            shifted[: n - j] = text[j:]
            key = key << 9 | np.where(left >= j, shifted, 0)
        rank, depth, longest = _ranks(key), PACK, int(lengths.max(initial=0)) + 1
        near = depth, rank.astype(np.int32)
        while depth < longest:
            if depth <= k:
                near = depth, rank.astype(np.int32)
            after = key
            after[n - depth :] = 0
            after[: n - depth] = rank[depth:] + 1
            rank = _ranks(rank * (n + 2) + np.where(left >= depth, after, 0))
            depth *= 2
        suffixes = np.argsort(rank * n + np.arange(n))  # equal ones by place; no two keys are equal
        before = text[suffixes - 1]  # the first string's first suffix wraps to the last end
        first = np.concatenate(([True], before[1:] != before[:-1]))
        self.starts = np.flatnonzero(first)
        self.ends = np.append(self.starts[1:], n) - 1
        self.chars = before[self.starts].astype(np.int64)
        self.head, self.tail = suffixes[self.starts], suffixes[self.ends]
        # Where a run's suffixes stand once they are one character longer.
        sizes = self.ends - self.starts + 1
        order = np.argsort(self.chars, kind="stable")
        self.longer = np.empty(len(order), np.int64)
        self.longer[order] = np.cumsum(sizes[order]) - sizes[order]
        self.by_char = np.sort(self.chars * len(self.chars) + np.arange(len(self.chars)))
        del key, rank, before, first
        self._own(suffixes, left, near, np.repeat(owners, lengths + 1))

    def _own(self, suffixes, left, near, owner_of) -> None:
        """Least owners by row, in stretches: suffixes of k bytes and more meet by their first k."""
        n, k = len(suffixes), self.k
        half, near = near
        spans = [0]
        while spans[-1] + half < k:
            spans.append(min(spans[-1] + half, k - half))
        long = left[suffixes] >= k
        same = long[1:] & long[:-1]
        for s in spans:
            of = near[np.minimum(suffixes + s, n - 1)]
            same &= of[1:] == of[:-1]
        groups = np.flatnonzero(np.concatenate(([True], ~same)))
        least = np.minimum.reduceat(np.where(long, owner_of[suffixes], NO_OWNER), groups)
        change = np.concatenate(([True], least[1:] != least[:-1]))
        self.own_rows, self.own = groups[change], least[change]

    def stream(self, strings: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(t, strings of t characters and more, their rows, text positions, match lengths) for t = 1, 2, ...

        The length is how much of what starts t characters before a string's end the
        index has; row and position are of a suffix that begins with that much.
        """
        symbols, starts, lengths = _text(strings)
        runs, wide = len(self.starts), np.arange(int(lengths.max(initial=0)) + 1)
        active = np.flatnonzero(lengths)
        row = np.zeros(len(active), np.int64)
        at, size = np.full(len(active), self.head[0] if runs else 0), np.zeros(len(active), np.int64)
        for t in range(1, int(lengths.max(initial=0)) + 1):
            keep = lengths[active] >= t
            if not keep.all():
                active, row, at, size = active[keep], row[keep], at[keep], size[keep]
            place = starts[active] + lengths[active] - t
            char = symbols[place].astype(np.int64)
            run = np.searchsorted(self.starts, row, side="right") - 1
            lost = np.flatnonzero(self.chars[run] != char)
            if len(lost):
                after = np.searchsorted(self.by_char, char[lost] * runs + run[lost])
                below, above = self.by_char[np.minimum(after, runs - 1)], self.by_char[after - 1]
                best = np.full(len(lost), -1, np.int64)
                for found, ok, end in ((above, after > 0, False), (below, after < runs, True)):
                    r = found % runs
                    ok = ok & (found // runs == char[lost])
                    q = (self.head if end else self.tail)[r]
                    shared = np.where(ok, self._common(q, symbols, place[lost] + 1, size[lost], wide), -1)
                    better = lost[shared > best]
                    take = r[shared > best]
                    run[better] = take
                    row[better] = (self.starts if end else self.ends)[take]
                    at[better] = q[shared > best]
                    best = np.maximum(best, shared)
                size[lost] = best
            on = self.chars[run] == char
            row = np.where(on, self.longer[run] + row - self.starts[run], 0)
            at, size = np.where(on, at - 1, self.head[0]), np.where(on, size + 1, 0)
            yield t, active, row, at, size

    def _common(self, q: np.ndarray, symbols: np.ndarray, place: np.ndarray, most: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """How many of at most ``most`` symbols agree from the text's position q and the strings' place on."""
        out = np.zeros(len(q), np.int64)
        for i in range(0, len(q), 4096):
            s = slice(i, i + 4096)
            w = wide[: int(most[s].max(initial=0)) + 1]
            a = self.text[np.minimum(q[s, None] + w, len(self.text) - 1)]
            b = symbols[np.minimum(place[s, None] + w, len(symbols) - 1)]
            differ = (a != b) | (w >= most[s, None])
            out[s] = differ.argmax(axis=1)
        return out

    def matching_statistics(self, strings: list[bytes]) -> list[list[tuple[int, int]]]:
        """For each place of each string: the longest match that starts there, and a position of it in the text."""
        out = [[(0, 0)] * len(s) for s in strings]
        for t, active, _, at, size in self.stream(strings):
            for i, q, n in zip(active.tolist(), at.tolist(), size.tolist(), strict=True):
                out[i][len(strings[i]) - t] = (n, q)
        return out

    def least_owners(self, strings: list[bytes], windows: int) -> np.ndarray:
        """For each string and each of its first ``windows`` k-byte windows the least owner that has it, or NO_OWNER."""
        out = np.full((len(strings), windows), NO_OWNER, np.int64)
        lengths = np.array([len(s) for s in strings], np.int64)
        for t, active, row, _, size in self.stream(strings):
            hit = np.flatnonzero((size >= self.k) & (lengths[active] - t < windows))
            if len(hit):
                i = active[hit]
                out[i, lengths[i] - t] = self.own[np.searchsorted(self.own_rows, row[hit], side="right") - 1]
        return out


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    s = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])))
    return rank
