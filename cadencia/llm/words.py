"""Words of a batch of texts, scored once for each different word."""

from __future__ import annotations

import numpy as np
import pandas as pd

from .common import process_cache

SPACE = 32


def coded(texts: list[list[str]]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of all words, the different words, and where each text's words begin."""
    flat = [w for t in texts for w in t]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    if not flat:
        return np.zeros(0, np.int64), [], at
    codes, known = pd.factorize(np.array(flat, dtype=object))
    return codes.astype(np.int64), list(known), at


def letters(words: list[str]) -> np.ndarray:
    """Code points of the words, each after a space and with one space at the end."""
    text = " " + " ".join(words) + " "
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def alphabetic() -> np.ndarray:
    """For every code point, whether it is a letter."""
    kept = process_cache()
    if "alphabetic" not in kept:
        kept["alphabetic"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return kept["alphabetic"]


def shapes() -> np.ndarray:
    """A code point's class: cases of letters and digits are alike, all others stay apart."""
    kept = process_cache()
    if "shapes" not in kept:
        classes = np.arange(0x110000, dtype=np.uint64)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                classes[i] = 1 if c.islower() else 2 if c.isupper() else 3
            elif c.isdigit():
                classes[i] = 4
        kept["shapes"] = classes
    return kept["shapes"]
