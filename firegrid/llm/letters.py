"""Letter sequences of text buffers, for the language and toxicity models."""

from __future__ import annotations

import numpy as np

_TABLE: list[np.ndarray] = []


#: Letters beyond FFFF share the code points of the Basic Multilingual Plane's private use area, which holds no letter, in turn.
_FROM, _PLACES = 0xE000, 6400


def letter_table() -> np.ndarray:
    """For each code point its lower-case letter's event, or 0 if it is no letter. Letters beyond FFFF have one of 6400 events of their own."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint16)
        for cp in (*range(0xD800), *range(0xE000, 0x110000)):
            ch = chr(cp)
            if ch.isalpha():
                low = ord(ch.lower()[0])
                table[cp] = low if low <= 0xFFFF else _FROM + low % _PLACES
        _TABLE.append(table)
    return _TABLE[0]


def letter_events(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of each text, one 0 after each run of letters that something else follows; and where each text's events begin."""
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    begin = lead[offsets]
    c = letter_table()[cps]
    keep = c != 0
    after = np.zeros(len(c), bool)
    after[1:] = keep[:-1]
    after[begin[:-1][begin[:-1] < begin[1:]]] = False
    keep |= after
    kept = np.concatenate(([0], np.cumsum(keep)))
    return c[keep], kept[begin]
