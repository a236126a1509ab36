"""Cross-entropy difference: how much better a target model predicts a document than a background model.

Both are token bigram models over the one vocabulary of a public tokenizer, with equal smoothing: bigram counts
interpolated with unigram shares, those with the uniform one. The background is every document, the target the
documents named. The models are matched: the background's counts are scaled to as many tokens as the target's, so that
smoothing weighs alike in both, and no model that scores a text has counted that text (its own counts are taken off).
Counts are exact and cover the whole corpus, so the table of bigrams grows with it. Texts are
tokenised once, in runs of some million tokens. A run sends each of its distinct bigrams to the counts and gets the
corpus counts back, both by a shuffle, so that the rows moved are those of the runs' bigrams however many partitions
there are; each text is then scored where its run is. Only the vocabulary's own counts are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import BROADCAST_IDS, checkpoint, release, stored, tidied
from crosspanel.llm.tokens import byte_tokenizer

VOCABULARY = 50_257
#: The id before a text's first token.
START = 50_256
#: Strength of the unigram share in a bigram probability, and of the uniform one in a unigram probability.
BACKOFF, UNIFORM = 20.0, 0.1
#: Texts encoded at once, and the tokens and texts that a run has at most; a longer text is a run of its own.
_TEXTS, _TOKENS, _ROWS = 512, 1 << 21, 1 << 16
#: Tokens from which texts of a run are scored together.
_PART = 1 << 18
_RUNS = "run long, pair long, background long, target long, doc_ids array<long>, targets array<boolean>, lengths array<long>, ids binary"


def _tokens(b: pa.RecordBatch, encode) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, ids (16 bits) and number of ids of each row, some hundred texts at a time."""
    for i in range(0, b.num_rows, _TEXTS):
        ids = [encode(t or "") for t in b.column("text").slice(i, _TEXTS).to_pylist()]
        lengths = np.array([len(part) for part in ids], dtype=np.int64)
        yield i, np.fromiter((x for part in ids for x in part), dtype="<u2", count=lengths.sum()), lengths


def _bigrams(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after another: each token's row, the id before it, and itself."""
    ids, at = ids.astype(np.int64), np.cumsum(lengths) - lengths
    context = np.empty_like(ids)
    context[1:] = ids[:-1]
    context[at[lengths > 0]] = START
    return np.repeat(np.arange(len(lengths)), lengths), context, ids


def flag_ids(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """docs (doc_id, text) and a boolean: is doc_id among ids? A short list is broadcast."""
    ids = checkpoint(ids.select("doc_id").filter("doc_id is not null").distinct())
    marked = ids.withColumn(name, F.lit(True))
    return docs.join(F.broadcast(marked) if ids.count() <= BROADCAST_IDS else marked, "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _run_rows(run: int, doc_ids: list[pa.Array], targets: list[pa.Array], ids: list[np.ndarray], lengths: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row with the texts of a run, and one for each of its distinct bigrams."""
    flat, size, schema = np.concatenate(ids), np.concatenate(lengths), pa.schema(_FIELDS)
    flag = pa.concat_arrays(targets)
    row, context, token = _bigrams(flat, size)
    pair, at, n = np.unique(context * VOCABULARY + token, return_inverse=True, return_counts=True)
    inside = np.asarray(flag.to_numpy(zero_copy_only=False), dtype=float)
    target = np.bincount(at, inside[row], minlength=len(pair)).astype(np.int64)
    yield pa.RecordBatch.from_pylist([{"run": run, "doc_ids": pa.concat_arrays(doc_ids).to_pylist(), "targets": flag.to_pylist(), "lengths": size.tolist(), "ids": flat.tobytes()}], schema)
    for i in range(0, len(pair), 50_000):
        part = [x[i : i + 50_000] for x in (np.full(len(pair), run), pair, n, target)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, part), *(pa.nulls(len(part[0]), f.type) for f in _FIELDS[4:])], schema=schema)


_FIELDS = [
    *(pa.field(n, pa.int64()) for n in ("run", "pair", "background", "target")),
    pa.field("doc_ids", pa.list_(pa.int64())), pa.field("targets", pa.list_(pa.bool_())), pa.field("lengths", pa.list_(pa.int64())), pa.field("ids", pa.binary()),
]


def count_tokens(flagged: DataFrame, tokenizer: str) -> DataFrame:
    """flagged (doc_id, text, target) -> rows of two kinds, stored: (run, doc_ids, targets, lengths, ids) of each run of
    texts, and (run, pair, background, target) of each distinct bigram of a run.
    """

    @tidied
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, run = byte_tokenizer(tokenizer).encode_ordinary, TaskContext.get().partitionId() << 32
        held, rows, size = [], 0, 0
        for b in batches:
            for i, ids, lengths in _tokens(b, encode):
                n = len(lengths)
                if held and (size + len(ids) > _TOKENS or rows + n > _ROWS):
                    yield from _run_rows(run, *zip(*held, strict=True))
                    run, held, rows, size = run + 1, [], 0, 0
                held.append((b.column("doc_id").slice(i, n), b.column("target").slice(i, n), ids, lengths))
                rows, size = rows + n, size + len(ids)
        if held:
            yield from _run_rows(run, *zip(*held, strict=True))

    return stored(flagged.select("doc_id", "text", "target").mapInArrow(runs, _RUNS))


def _own(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each token's key occurs in the token's own text."""
    _, at, n = np.unique(row * VOCABULARY**2 + key, return_inverse=True, return_counts=True)
    return n[at]


class Models:
    """Background and target: counts of contexts and tokens; as long as the vocabulary."""

    def __init__(self, counts: DataFrame):
        both = []
        for number in (F.expr(f"pair div {VOCABULARY}"), F.expr(f"pair % {VOCABULARY}")):
            single = counts.groupBy(number.alias("id")).agg(F.sum("background").alias("background"), F.sum("target").alias("target")).toArrow()
            full = np.zeros((2, VOCABULARY))
            for model, name in enumerate(("background", "target")):
                full[model, np.asarray(single.column("id"))] = np.asarray(single.column(name))
            both.append(full)
        self.before, self.single = both
        self.total = self.single.sum(axis=1)
        self.match = np.array([self.total[1] / max(1.0, self.total[0]), 1.0])

    def losses(self, row: np.ndarray, context: np.ndarray, ids: np.ndarray, lengths: np.ndarray, counts: list[np.ndarray], inside: list[np.ndarray]) -> list[np.ndarray]:
        """Background's and target's of each token; counts: of its bigram; inside: whether a text is in the model."""
        pair, before, single = _own(row, context * VOCABULARY + ids), _own(row, context), _own(row, ids)
        found = []
        for k, n, belongs, times in zip(range(2), counts, inside, self.match, strict=True):
            own = belongs[row]
            share = ((self.single[k][ids] - single * own) * times + UNIFORM) / ((self.total[k] - lengths[row] * own) * times + UNIFORM * VOCABULARY)
            found.append(-np.log(((n - pair * own) * times + BACKOFF * share) / ((self.before[k][context] - before * own) * times + BACKOFF)))
        return found


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, tokenizer: str, bits: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, target_loss, background_loss, score.

    Losses are nats per token; score is background_loss - target_loss, higher for documents more like the target
    (target_ids: doc_id). Texts without tokens, null ones too, have losses and score zero. Rows that repeat an id are
    scored each; rows without an id are background. Without a target both models are the uniform one. Counts are
    exact; bits, once the size of a hashed model, has no effect. A task holds one run: a text's tokens are held whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = count_tokens(flag_ids(rows, target_ids.select(F.col("doc_id").cast("long").alias("doc_id")), "target"), tokenizer)
    pairs = met.filter("pair is not null")
    counts = stored(pairs.groupBy("pair").agg(F.sum("background").alias("background"), F.sum("target").alias("target")))
    models = rows.sparkSession.sparkContext.broadcast(Models(counts))

    def score(run: pa.Table, found: pa.Table) -> pa.Table:
        lengths, doc_ids = np.asarray(run.column("lengths")[0].values, dtype=np.int64), run.column("doc_ids")[0].values
        flat, end = np.frombuffer(run.column("ids")[0].as_buffer(), dtype="<u2"), np.cumsum(lengths)
        target = np.asarray(run.column("targets")[0].values.to_numpy(zero_copy_only=False), dtype=bool)
        pair = np.asarray(found.column("pair"))
        order = np.argsort(pair)
        counts, sums = [np.asarray(found.column(n)) for n in ("background", "target")], []
        first = np.flatnonzero(np.diff((end - lengths) // _PART, prepend=-1))
        for i, j in zip(first, [*first[1:], len(lengths)], strict=True):
            row, context, ids = _bigrams(flat[end[i] - lengths[i] : end[j - 1]], lengths[i:j])
            at = order[np.searchsorted(pair, context * VOCABULARY + ids, sorter=order)] if len(pair) else row
            inside = [np.ones(j - i, dtype=bool), target[i:j]]
            losses = models.value.losses(row, context, ids, lengths[i:j], [n[at] for n in counts], inside)
            sums.append([np.bincount(row, x, minlength=j - i) / np.maximum(lengths[i:j], 1) for x in losses])
        background_loss, target_loss = (np.concatenate(x) for x in zip(*sums, strict=True))
        release()
        return pa.table({"doc_id": doc_ids, "n_tokens": lengths, "target_loss": target_loss, "background_loss": background_loss})

    texts = met.filter("pair is null").select("run", "doc_ids", "targets", "lengths", "ids")
    known = pairs.select(F.col("run").alias("of"), "pair").join(counts, "pair")
    scored = texts.groupBy("run").cogroup(known.groupBy("of")).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("background_loss") - F.col("target_loss"))
