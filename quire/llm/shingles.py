"""Word shingles of whole texts as sorted 64-bit hashes, computed in numpy over joined texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text that are hashed in one go.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class Shingler:
    """Distinct ``k``-word shingles; words are runs without ASCII white space, with A-Z lower-cased."""

    def __init__(self, k: int):
        self.k = k
        self.factor = mix(np.arange(11, 11 + k, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
        self.power = self.inverse = np.ones(0, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, CHUNK + (CHUNK >> 1))
            for name, base in (("power", _BASE), ("inverse", _INVERSE)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of every word; a word's hash doesn't depend on where it stands."""
        b = _LOWER[np.frombuffer(data, dtype=np.uint8)]
        word = ~_SPACE[b]
        edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self._grow(len(b))
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[b] * self.power[: len(b)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64)), starts

    def _long_words(self, text: bytes) -> np.ndarray:
        """Words of one long text, in pieces that end at white space."""
        out, at = [], 0
        while at < len(text):
            end = at + CHUNK
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            out.append(self.words(text[at:end])[0])
            at = end
        return np.concatenate(out)

    def _sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        k = self.k
        if len(texts) == 1:
            w = self._long_words(texts[0]) if len(texts[0]) > CHUNK else self.words(texts[0])[0]
            doc = np.zeros(len(w), dtype=np.int64)
        else:
            begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
            w, starts = self.words(b"\n".join(texts))
            doc = np.searchsorted(begin, starts, side="right") - 1
        n = np.bincount(doc, minlength=len(texts))
        if len(w) >= k:
            s = w[: len(w) - k + 1] * self.factor[0]
            for j in range(1, k):
                s = s + w[j : len(w) - k + 1 + j] * self.factor[j]
            whole = doc[: len(s)] == doc[k - 1 :]
            s, of = mix(s[whole]), doc[: len(s)][whole]
        else:
            s, of = w[:0], doc[:0]
        cut = np.searchsorted(of, np.arange(len(texts) + 1))
        first = np.cumsum(n) - n
        for i in range(len(texts)):
            if 0 < n[i] < k:
                part = w[first[i] : first[i] + n[i]]
                yield mix((part * self.factor[: len(part)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D) * np.uint64(n[i]))
            else:
                yield np.unique(s[cut[i] : cut[i + 1]])

    def sets(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """The sorted distinct shingles of each text, in order; texts are joined up to ``CHUNK`` bytes."""
        with np.errstate(over="ignore"):
            held: list[bytes] = []
            size = 0
            for t in texts:
                t = t or b""
                if held and size + len(t) > CHUNK:
                    yield from self._sets(held)
                    held, size = [], 0
                held.append(t)
                size += len(t) + 1
            if held:
                yield from self._sets(held)
