"""Content-chosen places of long texts: equal strings of a fixed length have an equal place chosen in them."""

from __future__ import annotations

import numpy as np

#: Bytes of a string that counts as repeated, of a place's own string, and places to choose from in one string.
LENGTH, GRAM = 100, 32
CHOICE = LENGTH - GRAM + 1

_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every place on, by doubling."""
    value = (raw.astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[0]
    for step, multiplier in zip((1, 2, 4, 8, 16), _MULTIPLIERS):
        value = (value[:-step] ^ (value[:-step] >> np.uint64(31))) * multiplier + value[step:]
    return value ^ (value >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    done = 1
    least = values
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - done:][: len(values) - width + 1])


#: Low bits of a ranked hash that hold the place; the same for every text, so that equal strings rank their places alike.
PLACE_BITS = 31


def chosen_places(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first start, last start) of the runs of starts whose LENGTH bytes have the same place chosen.

    ``raw`` holds texts one after another, ``ends`` their bounds; starts are places in ``raw``. The chosen place has the
    least hash, the first such place if several are equal. Every start of a whole string is in one run.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < LENGTH:
        return none, none.astype(np.uint64), none, none
    value = gram_hashes(raw)
    n = len(raw) - LENGTH + 1
    bits = np.uint64(PLACE_BITS)
    ranked = (value >> bits << bits) | np.arange(len(value), dtype=np.uint64)
    place = (sliding_least(ranked, CHOICE)[:n] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:n]
    whole = np.arange(n) + LENGTH <= ends[text + 1]
    new = np.ones(n, dtype=bool)
    new[1:] = (np.diff(place) != 0) | (np.diff(text) != 0)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [n]]) - 1
    # A run at the end of a text goes on where its strings would reach into the next text; it stops before that.
    last = np.minimum(last, ends[text[first] + 1] - LENGTH)
    real = whole[first]
    first, last = first[real], last[real]
    return text[first], value[place[first]], first, last
