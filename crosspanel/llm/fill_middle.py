"""Fill-in-the-middle: texts cut at two unit ends into prefix, middle and suffix, and put in another order.

The UTF-8 of many texts is one array of 64-bit words. Unit-ending bytes are marked in each word by arithmetic on its
eight bytes at once, marks are counted by popcount, and the running count is searched for the word that holds the mark
wanted; which bit of that word it is comes from clearing its lowest marks. Texts are not looked at byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm import words as W
from crosspanel.llm.common import tidied

# The sentinels, and the seed that stands before the id in what is hashed.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
UNITS = ("line", "character")
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_LOW, _TOP = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
_BREAK = np.uint64(0x0A0A0A0A0A0A0A0A)
_ONE = np.uint64(1)


class Marks:
    """Marked bytes of a byte array: how many lie before a byte, and where the n-th is."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def before(self, at: np.ndarray) -> np.ndarray:
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        part = self.marks[np.minimum(word, len(self.marks) - 1)] & ((_ONE << (inside * np.uint64(8))) - _ONE)
        return self.upto[word] + np.bitwise_count(part)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Byte of the mark that nth marks precede (nth is below their number)."""
        word = np.searchsorted(self.upto, nth, "right") - 1
        left, part = nth - self.upto[word], self.marks[word]
        for i in range(int(left.max(initial=0))):
            part = np.where(left > i, part & (part - _ONE), part)
        return 8 * word + (np.bitwise_count((part & (~part + _ONE)) - _ONE) >> 3)


def _words(raw: np.ndarray) -> np.ndarray:
    """raw as 64-bit words; the last is filled up with zeros, and one word of zeros follows."""
    out = np.zeros(8 * (len(raw) // 8 + 2), dtype=np.uint8)
    out[: len(raw)] = raw
    return out.view("<u8")


def line_ends(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that is a line feed: exact, as no carry leaves a byte."""
    x = words ^ _BREAK
    return ~(((x & _LOW) + _LOW) | x) & _TOP


def continuations(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that goes on a character (10xxxxxx)."""
    return words & ~(words << _ONE) & _TOP


def character_ends(words: np.ndarray, size: int) -> np.ndarray:
    """The top bit of each of the first size bytes that ends a character: the next byte does not go on."""
    goes_on = continuations(words)
    after = goes_on >> np.uint64(8)
    after[:-1] |= goes_on[1:] << np.uint64(56)
    ends = ~after & _TOP
    ends[size // 8] &= (_ONE << np.uint64(8 * (size % 8))) - _ONE
    ends[size // 8 + 1 :] = 0
    return ends


def _hashes(ids: list[int | None], seed: int) -> np.ndarray:
    """First four 8-digit groups of the SHA-256 of seed:id for each id (nothing after the colon for a null id)."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, dtype=">u4").reshape(-1, 4).astype(np.int64)


def _with_sentinel(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text contains a sentinel."""
    found = np.zeros(len(at) - 1, dtype=bool)
    if len(raw) >= 3:
        middle = raw[1:-1]
        where = np.flatnonzero((raw[:-2] == ord("<")) & (raw[2:] == ord(">")) & ((middle == ord("P")) | (middle == ord("S")) | (middle == ord("M"))))
        row = np.searchsorted(at, where, "right") - 1
        found[row[where + 3 <= at[row + 1]]] = True
    return found


def _cut(raw: np.ndarray, at: np.ndarray, pick: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Units of each text, the two cuts as byte offsets, and the characters of prefix and middle."""
    words, start, end = _words(raw), at[:-1], at[1:]
    marks = Marks(line_ends(words) if unit == "line" else character_ends(words, len(raw)))
    first, last = marks.before(start), marks.before(end)
    open_end = np.zeros(len(start), dtype=bool)
    full = end > start
    open_end[full] = marks.before(end[full] - 1) == last[full]
    n = last - first + open_end
    cuts = []
    for units in (pick[:, :2] % (n + 1)[:, None]).T:
        cut = np.where(units > 0, end, start)
        inside = (units > 0) & (units <= last - first)
        cut[inside] = marks.select((first + units - 1)[inside]) + 1
        cuts.append(cut)
    a, b = np.minimum(*cuts), np.maximum(*cuts)
    goes_on = Marks(continuations(words))
    at_start, at_a, at_b = map(goes_on.before, (start, a, b))
    return n, a, b, a - start - (at_a - at_start), b - a - (at_b - at_a)


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, unit: str = "line", seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, n, form, prefix_chars, middle_chars, output.

    n units (lines with their line feed, or characters) are cut at two places that a hash of seed and doc_id picks.
    rate percent of the texts are put as psm (prefix, suffix, middle) or, spm percent of those, as spm (suffix, prefix,
    middle), each part after its sentinel; the others, empty and null texts, and texts that contain a sentinel stay
    plain: output is the text, and prefix_chars and middle_chars are null. A null id is hashed as nothing; rows that
    repeat an id get the same draw. No rows give no rows; columns other than doc_id and text are ignored. Long texts
    are cut whole; a task holds one block of texts (some MB, or one text).
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    signs = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_all, at_all = W.text_bytes(batch.column("text"))
            for i, j in W.blocks(at_all):
                raw, at = raw_all[at_all[i] : at_all[j]], at_all[i : j + 1] - at_all[i]
                ids = batch.column("doc_id").slice(i, j - i)
                pick = _hashes(ids.to_pylist(), seed)
                n, a, b, prefix, middle = _cut(raw, at, pick, unit)
                plain = (at[1:] == at[:-1]) | _with_sentinel(raw, at) | (pick[:, 2] % 100 >= rate)
                first = pick[:, 3] % 100 < spm
                data, out = raw.tobytes(), []
                for s, x, y, e, keep, swap in zip(at[:-1].tolist(), a.tolist(), b.tolist(), at[1:].tolist(), plain.tolist(), first.tolist(), strict=True):
                    head, mid, tail = data[s:x], data[x:y], data[y:e]
                    if keep:
                        out.append(data[s:e])
                    elif swap:
                        out.append(b"".join((signs[1], tail, signs[0], head, signs[2], mid)))
                    else:
                        out.append(b"".join((signs[0], head, signs[1], tail, signs[2], mid)))
                form = np.where(plain, "plain", np.where(first, "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n), pa.array(form, pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that output was made from."""
    parts = F.split(F.col(output), "<[PSM]>", -1)
    return (
        F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(F.col(output))
    )
