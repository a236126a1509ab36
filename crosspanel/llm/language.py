"""Language identification by language-bitmask n-gram filters.

A Bloom filter whose slots hold bitmasks, one bit for each language (bit-sliced filters, one for each language, laid
side by side): adding an n-gram sets its languages' bits in a few slots, and the AND of those slots gives at once all
languages that contain it (with a share of their n-grams and a number of times below which it is taken as stray). A
text's n-grams are looked up, each language's bits are counted and corrected for the false positives its slice gives,
and the largest count decides. The filter grows with the n-grams; their counts cover all learned rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import checkpoint
from crosspanel.llm.words import BLOCK, blocks, mix, text_bytes

#: Bytes of an n-gram, hash functions, languages in a slice of masks, slots (8 bytes each) for an n-gram and hash.
N, HASHES, SLICE, ROOM = 4, 3, 63, 3
#: Times and share of a language's n-grams from which a language contains an n-gram: at most a million a language.
LEAST, LEAST_SHARE = 2, 1e-6

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_fold[[i for i in range(128) if not chr(i).isalpha()]] = 32
UNDETERMINED = "und"


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of each row as numbers, and each row's offsets: bytes lower-cased, other ASCII than letters a space.

    Each row is taken with a space before and after it; n-grams within runs of spaces are left out.
    """
    n = len(at) - 1
    wide = np.full(len(raw) + 2 * n, 32, dtype=np.uint8)
    shift = np.repeat(2 * np.arange(n) + 1, np.diff(at))
    wide[np.arange(len(raw)) + shift] = _fold[raw]
    to = at + 2 * np.arange(n + 1)
    if len(wide) < N:
        return np.zeros(0, dtype=np.uint32), np.zeros(n + 1, dtype=np.int64)
    key = np.zeros(len(wide) - N + 1, dtype=np.uint32)
    for i in range(N):
        key = (key << np.uint32(8)) | wide[i : len(wide) - N + 1 + i]
    good = np.ones(len(key), dtype=bool)
    for i in range(N - 1):
        good &= (wide[i : len(key) + i] != 32) | (wide[i + 1 : len(key) + i + 1] != 32)
    for i in range(1, N):
        edge = to[1:-1] - i
        good[edge[(edge >= 0) & (edge < len(good))]] = False
    kept = np.concatenate([[0], np.cumsum(good)])
    return key[good], kept[np.minimum(to, len(good))]


def slots(key: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = mix(h) | np.uint64(1)
    return [((h + np.uint64(i) * step) >> np.uint64(64 - bits)).astype(np.int64) for i in range(HASHES)]


class LanguageFilter:
    """The masks and what is needed to read counts off them."""

    def __init__(self, languages: list[str], usual: str, masks: list[np.ndarray]):
        self.languages, self.usual, self.masks = languages, usual, masks
        self.bits = len(masks[0]).bit_length() - 1 if masks else 0
        fill = [np.count_nonzero(masks[i // SLICE] & np.int64(1 << (i % SLICE))) / len(masks[0]) for i in range(len(languages))]
        self.wrong = np.minimum(np.array(fill) ** HASHES, 0.99)

    def predict(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each row and its score; -1 where no language has any of a row's n-grams."""
        key, to = grams(raw, at)
        size = np.diff(to)
        counts = np.zeros((len(size), len(self.languages)))
        full = np.flatnonzero(size)
        if len(full):
            places = slots(key, self.bits)
            for s, mask in enumerate(self.masks):
                found = mask[places[0]]
                for p in places[1:]:
                    found &= mask[p]
                for i in range(min(SLICE, len(self.languages) - s * SLICE)):
                    bit = ((found >> i) & 1).astype(np.uint8)
                    counts[full, s * SLICE + i] = np.add.reduceat(bit, to[full], dtype=np.int64)
        true = np.maximum(0, counts - size[:, None] * self.wrong) / (1 - self.wrong)
        best, total = true.argmax(axis=1), true.sum(axis=1)
        score = np.where(total > 0, true.max(axis=1) / np.maximum(total, 1e-300), 0.0)
        return np.where(total > 0, best, -1), score


def held_out(ident: str, folds: int, fold: int):
    """Is crc32 of the id as text (null: empty) modulo folds equal to fold?"""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")) % folds == fold


def learn_filter(rows: DataFrame, bits: int | None = None) -> LanguageFilter:
    """rows (text, lang) -> a filter of 2**bits slots (by default as many as its n-grams need). Rows of null text or
    lang are left out; of a language with fewer than LEAST rows of an n-gram nothing of it is learned."""
    spark = rows.sparkSession
    rows = rows.filter("text is not null and lang is not null").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column("lang").dictionary_encode()
            codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
            code, names = np.asarray(codes.indices).astype(np.uint64), codes.dictionary.to_pylist()
            raw, at = text_bytes(b.column("text"))
            keys, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            for i, j in blocks(at, 8 * BLOCK):
                key, to = grams(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                some, many = np.unique((np.repeat(code[i:j], np.diff(to)) << np.uint64(32)) | key, return_counts=True)
                keys, back = np.unique(np.concatenate([keys, some]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([n, many]), minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in (keys >> np.uint64(32)).tolist()], pa.string()), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").collect()  # a row for each language
    languages = [r["lang"] for r in totals]
    if not languages:
        counts.unpersist()
        return LanguageFilter([], UNDETERMINED, [])
    named = spark.createDataFrame([(r["lang"], i // SLICE, 1 << (i % SLICE), r["total"]) for i, r in enumerate(totals)], "lang string, slice int, mask long, total long")
    own = checkpoint(counts.join(F.broadcast(named), "lang").filter(f"n >= {LEAST} and n >= total * {LEAST_SHARE}").select("gram", "slice", "mask"))
    counts.unpersist()
    size = bits or max(16, (own.select("gram").distinct().count() * HASHES * ROOM).bit_length())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in slots(np.asarray(b.column("gram")), size):
                yield pa.RecordBatch.from_arrays([b.column("slice"), pa.array(at), b.column("mask")], names=["slice", "slot", "mask"])

    table = own.mapInArrow(place, "slice int, slot long, mask long").groupBy("slice", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most a row for each slot and slice
    masks = [np.zeros(1 << size, dtype=np.int64) for _ in range((len(languages) + SLICE - 1) // SLICE)]
    which = np.asarray(table.column("slice"))
    for s, mask in enumerate(masks):
        mask[np.asarray(table.column("slot"))[which == s]] = np.asarray(table.column("mask"))[which == s]
    return LanguageFilter(languages, max(totals, key=lambda r: (r["total"], r["lang"]))["lang"], masks)


def identify(docs: DataFrame, learned: LanguageFilter) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score.

    `und`, with score zero, where the text is null or has no letter (or nothing was learned). A text with letters but
    no known n-gram gets the most usual language and score zero; ties go to the first language by name. Texts of any
    length are read whole; rows that repeat an id are judged each; null ids stay; other columns are ignored, whatever
    their names. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    names = ["doc_id", "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        known = np.array([*f.languages, f.usual], dtype=object)
        for b in batches:
            raw, at = text_bytes(b.column("text"))
            lang, score = [], []
            for i, j in blocks(at):
                best, sure = f.predict(raw[at[i] : at[j]], at[i : j + 1] - at[i]) if f.languages else (np.full(j - i, -1), np.zeros(j - i))
                lang.append(known[best])
                score.append(sure)
            letters = b.column("letters").to_numpy(zero_copy_only=False)
            lang = np.where(letters, np.concatenate(lang) if lang else np.zeros(0, dtype=object), UNDETERMINED)
            score = np.where(letters, np.concatenate(score) if score else np.zeros(0), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.rlike(F.col("text").cast("string"), F.lit(r"\p{L}")), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
