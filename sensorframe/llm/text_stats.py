"""Counts over whole texts that the quality operators share; each is one pass of C code over the bytes."""

from __future__ import annotations

import numpy as np

from .common import ASCII_SPACE

SYMBOLS = b"#*$%&|<>"
_DIGITS, _UPPER = b"0123456789", bytes(range(65, 91))
#: Words of a window that must not repeat.
WINDOW = 8


def count_of(text: bytes, characters: bytes) -> int:
    return len(text) - len(text.translate(None, characters))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words (a power of two) that are found twice or more, first ones included.

    Windows get exact numbers by doubling: equal pairs of equal halves.
    """
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    step = 1
    while step < window:
        _, ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)
        if int(ids.max()) + 1 == len(ids):
            return 0
        step *= 2
    begins = np.flatnonzero(np.bincount(ids)[ids] >= 2)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines with a word)."""
    lines = [line for line in text.split(b"\n") if line.strip(ASCII_SPACE)]
    return len(lines) - len(set(lines)), len(lines)


def code_points(text: bytes) -> int:
    return len(text.decode("utf-8", "replace"))


def base_counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    """(words, word characters, symbols, duplicate lines, repeated words, lines with a word)."""
    words = text.split()
    dup, lines = duplicate_lines(text)
    return (
        len(words),
        code_points(text) - count_of(text, ASCII_SPACE),
        count_of(text, SYMBOLS),
        dup,
        repeated_words(words),
        lines,
    )


def more_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(digits, capitals A-Z, marks of emphasis, other punctuation, distinct words)."""
    return (
        count_of(text, _DIGITS),
        count_of(text, _UPPER),
        count_of(text, b"!?"),
        count_of(text, b".,;:"),
        len(set(text.split())),
    )
