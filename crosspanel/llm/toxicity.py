"""Toxicity by class-conditional Kneser-Ney models of words and their beginnings.

A word is read in steps: its first four characters, then its first six, then all of it; each step has the one before
as its context. Two models, of toxic and of ordinary texts, discount the number of their own documents that show a
step and back off to continuation counts (after how many words it was seen) that both classes share. So an expression
that neither class has shown says nothing, one that is rare is smoothed alike in both, and a new word is judged by its
beginning. The evidence of a text is the logarithm of its words' mean likelihood ratio: how much likelier it is under
the toxic model for one word, whichever it is, than under the ordinary one. That is normalised by length, and one
expression is not drowned by a thousand ordinary words. A logistic curve, fitted on texts whose own fold the models
have not seen, makes it a probability.

Fitted on a bounded sample (`per_class` labelled documents of either class at most, in order of a hash of their id);
every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import checkpoint, tidied
from crosspanel.llm.words import blocks, mix, spans, text_bytes, word_hashes

#: Characters of the steps before the whole word, and what is taken off each count.
STEPS, DISCOUNT = (4, 6), 0.9
#: Labelled documents of each class that the models and the curve are fitted on, and the folds for the curve.
PER_CLASS, FOLDS = 4096, 3
_TABLE_BITS, _BYTES = 17, 1 << 18
_NAMES = ["step0", "step1", "step2"]


def word_steps(raw: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """A hash of each step of each word, A-Z lower-cased, and for each row the number of its first word.

    Words are runs of letters, digits and non-ASCII bytes.
    """
    starts, ends, first = spans(raw, at, "mark")
    letters = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    nth = np.searchsorted(letters, starts)
    cuts = [np.minimum(letters[np.minimum(nth + n, len(letters) - 1)], ends) for n in STEPS] + [ends]
    return [mix(word_hashes(raw, starts, cut) + np.uint64(i)) for i, cut in enumerate(cuts)], first


def _sums(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each entry the sum of x over its group; groups are numbers from zero."""
    return np.bincount(group, weights=x)[group]


class ToxicityModel:
    """For each step seen the sum of its log-likelihood ratios from the first step on, and that of what may follow it
    unseen; and the curve."""

    def __init__(self, steps: list[np.ndarray], toxic: np.ndarray, ordinary: np.ndarray, after: np.ndarray):
        """For each distinct word its steps, the documents of each class that have it, and the words it came after."""
        self.slope, self.middle, self.unknown = 0.0, 0.0, 0.0
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        if not len(after):
            return
        above, summed = np.zeros(1, dtype=np.int64), np.zeros(1)  # of each context: its number, its ratio so far
        context_of_word = np.zeros(len(after), dtype=np.int64)
        for step in steps:
            key, at, back = np.unique(step, return_index=True, return_inverse=True)
            context = context_of_word[at]
            count = [np.bincount(back, weights=x, minlength=len(key)) for x in (toxic, ordinary, after)]
            shared = count[2] / np.maximum(_sums(context, count[2]), 1e-300)
            logs, rests = [], []
            for c in count[:2]:
                total, kinds = _sums(context, c), _sums(context, (c > 0).astype(float))
                rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
                logs.append(np.log(np.maximum(np.where(total > 0, np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1), 0.0) + rest * shared, 1e-300)))
                rests.append(np.log(rest))
            unseen = np.zeros(len(above))
            unseen[context] = rests[0] - rests[1]
            if self.tables:
                self.tables[-1] = self._table(above_key, summed, summed + unseen)
            else:
                self.unknown = float(unseen[0])
            summed = summed[context] + logs[0] - logs[1]
            above, above_key, context_of_word = np.arange(len(key)), key, back
            self.tables.append(self._table(key, summed, summed))

    @staticmethod
    def _table(key: np.ndarray, value: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys, whose leading bits narrow each search to a few entries, and their values."""
        start = np.searchsorted(key >> np.uint64(64 - _TABLE_BITS), np.arange((1 << _TABLE_BITS) + 1, dtype=np.uint64)).astype(np.int32)
        return key, value.astype(np.float32), then.astype(np.float32), start

    @staticmethod
    def _find(table: tuple, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is in the table, and its place."""
        key, start = table[0], table[3]
        lead = (want >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        at, stop = start[lead].copy(), start[lead + 1]
        found = np.zeros(len(want), dtype=bool)
        todo = np.flatnonzero(at < stop)
        while len(todo):
            same = key[at[todo]] == want[todo]
            found[todo[same]] = True
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < stop[todo]]
        return found, np.minimum(at, len(key) - 1)

    def ratios(self, steps: list[np.ndarray]) -> np.ndarray:
        """The log-likelihood ratio of each word: of its longest known step, and of what follows it."""
        out = np.full(len(steps[0]), self.unknown, dtype=np.float32)
        todo = np.arange(len(out))
        for i in range(len(self.tables) - 1, -1, -1):
            found, at = self._find(self.tables[i], steps[i][todo])
            out[todo[found]] = self.tables[i][1 if i == len(self.tables) - 1 else 2][at[found]]
            todo = todo[~found]
        return out

    def evidence(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logarithm of the mean likelihood ratio over the words of each row; zero for rows without words."""
        steps, first = word_steps(raw, at)
        size = np.diff(first)
        if not self.tables or not len(steps[0]):
            return np.zeros(len(size))
        sums = np.concatenate([[0.0], np.cumsum(np.exp(self.ratios(steps).astype(np.float64)))])
        return np.where(size > 0, np.log(np.maximum(sums[first[1:]] - sums[first[:-1]], 1e-12) / np.maximum(size, 1)), 0.0)

    def fit_curve(self, evidence: np.ndarray, toxic: np.ndarray, rate: float) -> None:
        """Logistic curve by Newton steps, classes weighted to their true rate, with a slight pull of the slope to zero."""
        y = toxic.astype(float)
        if not len(y) or not 0 < y.mean() < 1:
            self.slope, self.middle = 0.0, -5.0
            return
        w = np.where(toxic, rate / y.mean(), (1 - rate) / (1 - y.mean()))
        unit = evidence.std() or 1.0
        x = np.stack([evidence / unit, np.ones(len(y))], axis=1)
        beta = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            hessian = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([0.001, 1e-6])
            beta = beta + np.linalg.solve(hessian, x.T @ (w * (y - p)) - np.array([0.001, 0.0]) * beta)
        self.slope, self.middle = beta[0] / unit, beta[1]

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(raw, at) + self.middle, -700, 700)))


def _evidence_of(column: pa.Array, model: ToxicityModel, scores: bool = True) -> np.ndarray:
    raw, at = text_bytes(column)
    of = model.scores if scores else model.evidence
    parts = [of(raw[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in blocks(at, _BYTES)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(step0..step2, fold, toxic, ordinary) of the words of each row, each once."""
    for b in batches:
        raw, at = text_bytes(b.column("text"))
        toxic, fold = (np.asarray(b.column(n).to_numpy(zero_copy_only=False), dtype=np.int64) for n in ("toxic", "fold"))
        for i, j in blocks(at, _BYTES):
            steps, first = word_steps(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            row = np.repeat(np.arange(j - i), np.diff(first))
            order = np.lexsort((steps[-1], row))
            word, row = steps[-1][order], row[order]
            new = np.ones(len(word), dtype=bool)
            new[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
            once, row = order[new], row[new] + i
            columns = [pa.array(s[once].view(np.int64)) for s in steps] + [pa.array(x) for x in (fold[row], toxic[row], 1 - toxic[row])]
            yield pa.RecordBatch.from_arrays(columns, names=[*_NAMES, "fold", "toxic", "ordinary"])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, before) of the distinct pairs of neighbours in each batch; a row's first word comes after zero."""
    for b in batches:
        raw, at = text_bytes(b.column("text"))
        for i, j in blocks(at, _BYTES):
            steps, first = word_steps(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            word = steps[-1]
            before = np.concatenate([np.zeros(1, dtype=np.uint64), word[:-1]]) if len(word) else word.copy()
            before[first[:-1][np.diff(first) > 0]] = 0
            pairs = np.unique(np.stack([word, before], axis=1).view(np.int64), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["word", "before"])


def learn_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """docs (doc_id, text), labels (doc_id, toxic 0/1; several of a document: the highest) -> a model.

    Of texts that share an id the least is learned from. What reaches the driver are the distinct words of the sample,
    which per_class (32,767 at most) bounds.
    """
    spark = docs.sparkSession
    one = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    one = checkpoint(one.withColumn("hash", F.xxhash64("doc_id")))
    rates = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    picked = [one.filter(F.col("toxic") == t).orderBy("hash", "doc_id").limit(per_class) for t in (True, False)]
    sample = picked[0].unionByName(picked[1])  # at most 2 * per_class rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("hash").alias("hash"))
    rows = checkpoint(rows.select("text", F.col("toxic").cast("long").alias("toxic"), F.pmod(F.xxhash64("hash"), F.lit(FOLDS)).alias("fold")))

    kinds = ", ".join(f"{n} long" for n in [*_NAMES, "fold", "toxic", "ordinary"])
    counts = rows.mapInArrow(tidied(_count_words), kinds).groupBy(*_NAMES, "fold").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    follow = rows.select("text").mapInArrow(tidied(_follow), "word long, before long").distinct().groupBy("word").agg(F.count("*").alias("after"))
    # Counts of one fold in a whole number each, so that as little as can be reaches the driver.
    packed = counts.join(follow.withColumnRenamed("word", "step2"), "step2").groupBy(*_NAMES, "after").agg(*(F.sum(F.when(F.col("fold") == f, F.col("toxic") + F.shiftleft("ordinary", 16)).otherwise(0)).alias(f"n{f}") for f in range(FOLDS)))
    met = packed.select(*_NAMES, F.col("after").cast("int"), *(F.col(f"n{f}").cast("int") for f in range(FOLDS))).toArrow()
    steps, after = [np.asarray(met.column(n)).view(np.uint64) for n in _NAMES], np.asarray(met.column("after"))
    folds = [np.asarray(met.column(f"n{f}")) for f in range(FOLDS)]
    del met
    both = sum(f & 0xFFFF for f in folds), sum(f >> 16 for f in folds)
    model = ToxicityModel(steps, *both, after)
    shared = spark.sparkContext.broadcast([ToxicityModel(steps, both[0] - (f & 0xFFFF), both[1] - (f >> 16), after) for f in folds])
    del steps, after, folds, both

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = np.asarray(b.column("fold"))
            for f in np.unique(fold).tolist():
                part = b.filter(pa.array(fold == f))
                yield pa.RecordBatch.from_arrays([pa.array(_evidence_of(part.column("text"), shared.value[f], scores=False)), part.column("toxic")], names=["evidence", "toxic"])

    curve = rows.mapInArrow(tidied(weigh), "evidence double, toxic long").toArrow()  # at most 2 * per_class rows
    known = sum(rates.values())
    model.fit_curve(np.asarray(curve.column("evidence")), np.asarray(curve.column("toxic")).astype(bool), rates.get(True, 0) / known if known else 0.0)
    shared.destroy()
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score (0 to 1), predicted (1 if score is 0.5 or more).

    Null and empty texts, and those without a letter or digit, get the score of no evidence. Texts of any length are
    read whole; rows that repeat an id are scored each, equal texts alike; null ids stay. Other columns are ignored,
    whatever their names, and no rows give no rows. A model that saw one class only calls nothing toxic: every score
    is near zero.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = _evidence_of(b.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """docs without the rows predicted toxic by a model learned from docs and labels; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(learn_toxicity(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_evidence_of(b.column("text"), shared.value) < 0.5))

    return docs.mapInArrow(tidied(run), docs.schema)
