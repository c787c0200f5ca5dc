"""Statistics of whole texts, a block of rows at a time: the ground of the weak labellers and of the rule statistics.

Words are runs of anything but the six ASCII spaces; lines end at line feeds. A null text has no words and one
empty line. Equal lines and equal runs of words are found by 64-bit hashes together with the row.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm import textbytes as tb

NAMES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_distinct_words", "n_letters", "n_upper", "n_digits", "n_shouts", "n_stops", "n_pipes", "n_long_words",
)
REPEAT_WINDOW = 5
LONG_WORD = 40

_VALUES = np.arange(256)
SYMBOLS = np.isin(_VALUES, list(b"#*$%&|<>"))
UPPER = (_VALUES >= 65) & (_VALUES <= 90)
LETTER = UPPER | ((_VALUES >= 97) & (_VALUES <= 122)) | (_VALUES >= 0xC3)
DIGIT = (_VALUES >= 48) & (_VALUES <= 57)
SHOUT = np.isin(_VALUES, list(b"!"))
STOP = np.isin(_VALUES, list(b".?"))
PIPE = np.isin(_VALUES, list(b"|"))
WORD_CHAR = tb.NOT_SPACE & tb.HEAD
BYTE_CLASSES = {
    "word_chars": WORD_CHAR, "n_symbols": SYMBOLS, "n_letters": LETTER, "n_upper": UPPER, "n_digits": DIGIT,
    "n_shouts": SHOUT, "n_stops": STOP, "n_pipes": PIPE, "n_lines": _VALUES == 10,
}


def repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys of rows in order: which keys stand in their row more than once, and all but one of each such set."""
    salted = tb.mix(keys + rows.astype(np.uint64) * np.uint64(tb.PRIME))
    order = np.argsort(salted)
    same = salted[order][1:] == salted[order][:-1]
    later, several = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    several[order[1:]] |= same
    several[order[:-1]] |= same
    return several, later


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The statistics of NAMES, one row for each text; and the words' starts, ends, pointers and hashes."""
    n = len(offsets) - 1
    starts, ends = tb.spans(data, tb.NOT_SPACE)
    ptr = tb.pointers(starts, offsets)
    words = tb.hashes(data, starts, ends)
    row = np.repeat(np.arange(n), np.diff(ptr))
    out = np.zeros((n, len(NAMES)), np.int64)
    put = lambda name, values: out.__setitem__((slice(None), NAMES.index(name)), values)

    put("n_words", np.diff(ptr))
    for name, counts in zip(BYTE_CLASSES, tb.per_row(data, offsets, *BYTE_CLASSES.values()), strict=True):
        put(name, counts)
    _, later = repeats(words, row)
    put("n_distinct_words", np.bincount(row[~later], minlength=n))
    put("n_long_words", np.bincount(row[ends - starts > LONG_WORD], minlength=n))

    breaks = np.flatnonzero(data == 10)
    line_starts = np.concatenate([[0], breaks[:-1] + 1])
    has_word = np.searchsorted(starts, breaks, "left") > np.searchsorted(starts, line_starts, "left")
    line_starts, line_ends = line_starts[has_word], breaks[has_word]
    line_row = np.searchsorted(offsets, line_starts, "right") - 1
    _, later = repeats(tb.hashes(data, line_starts, line_ends), line_row)
    put("n_dup_lines", np.bincount(line_row[later], minlength=n))

    grams = tb.rolling(words, REPEAT_WINDOW)
    if len(grams):
        inside = tb.within_rows(ptr, REPEAT_WINDOW)
        at = np.flatnonzero(inside)
        several, _ = repeats(grams[at], row[at])
        covered = np.zeros(len(words), bool)
        for i in range(REPEAT_WINDOW):
            covered[at[several] + i] = True
        put("n_repeat_words", np.bincount(row[covered], minlength=n))
    return out, {"starts": starts, "ends": ends, "ptr": ptr, "hashes": words}
