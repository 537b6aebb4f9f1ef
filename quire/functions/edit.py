"""Edit distances."""

from __future__ import annotations

import numpy as np


def distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance; any number above `most` if it is above `most`."""
    if a == b:
        return 0
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if most is not None and min(row) > most:
            return most + 1
    return row[-1]


def swapped(a: str, b: str) -> bool:
    """Whether they differ by two neighbouring characters in the other order."""
    if len(a) != len(b):
        return False
    d = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
    return len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of code points, padded with 0, and their lengths."""
    n = np.array([len(w) for w in words], dtype=np.int64)
    m = np.zeros((len(words), int(n.max(initial=0))), dtype=np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(words)), n)
    m[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return m, n


def distances(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Levenshtein distances of many pairs at once: rows of a with rows of b (see codes)."""
    n, w, v = len(a), a.shape[1], b.shape[1]
    row = np.broadcast_to(np.arange(v + 1, dtype=np.int16), (n, v + 1)).copy()
    out = np.where(na == 0, nb, 0).astype(np.int16)
    at = np.arange(n)
    for i in range(w):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        sub = row[:, :-1] + (a[:, i : i + 1] != b)
        up = row[:, 1:] + 1
        best = np.minimum(sub, up)
        for j in range(v):
            new[:, j + 1] = np.minimum(best[:, j], new[:, j] + 1)
        row = new
        done = na == i + 1
        out[done] = row[at[done], nb[done]]
    return out
