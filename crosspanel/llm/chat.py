"""Chat formatting by token-level assembly.

Role and text of each turn are encoded on their own, reserved ids that no text can encode to are spliced between them,
and the loss mask is the running sum of +1 where an assistant text begins and -1 where it ends. Rendered, a
conversation reads `<turn>role`, a line break, the text, `</turn>`, a line break. Control strings that occur in a role
or text, and the backslash, get a backslash before them, so that rendering and ids can both be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.tokens import byte_tokenizer

# Reserved ids (the vocabulary ends at 50255) and what they render as.
TURN, BODY, END = 50257, 50258, 50259
RENDERED = {TURN: "<turn>", BODY: "\n", END: "</turn>\n"}
CONTROL = ["\\", "<turn>", "</turn>", "### System:", "### User:", "### Assistant:", "<|endoftext|>", "<|im_start|>", "<|im_end|>"]

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_CONTROL_ROLE = re.compile("|".join(map(re.escape, [*CONTROL, "\n"])))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return (_CONTROL_ROLE if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _assemble(turns: list[dict], encode) -> tuple[np.ndarray, np.ndarray]:
    parts, size, steps = [], 0, []
    for turn in turns:
        role, text = turn["role"] or "", turn["text"] or ""
        head, body = encode(escape(role, role=True)), encode(escape(text))
        parts += [[TURN], head, [BODY], body, [END]]
        if role == "assistant":
            steps.append((size + len(head) + 2, size + len(head) + 2 + len(body)))
        size += len(head) + len(body) + 3
    edge = np.zeros(size + 1, dtype=np.int8)
    for a, b in steps:
        edge[a] += 1
        edge[b] -= 1
    ids = np.fromiter((i for part in parts for i in part), dtype=np.int32, count=size)
    return ids, np.cumsum(edge[:size], dtype=np.int8)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


def format_conversations(rows: DataFrame, tokenizer: str) -> DataFrame:
    """rows (conv_id, turn, role, text) -> one row per conversation: conv_id, input_ids, loss_mask (1 on assistant texts).

    Turns go by turn, then role and text; rows that repeat a turn are turns of their own. Null text or role: empty;
    null turn first; null conv_id is a conversation. No rows give no conversations; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_tokenizer(tokenizer).encode_ordinary
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                made = [_assemble(turns, encode) for turns in part.column("turns").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), _lists([x[0] for x in made], pa.int32()), _lists([x[1] for x in made], pa.int8())], names=["conv_id", "input_ids", "loss_mask"])

    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(run, "conv_id long, input_ids array<int>, loss_mask array<tinyint>")


def _decode(ids: np.ndarray, tokenizer) -> str:
    return tokenizer.decode_bytes(ids.tolist()).decode("utf-8")


def parse(ids: np.ndarray, tokenizer) -> tuple[list[tuple[str, str]], str]:
    """The turns (role, text) and the rendering that ids stand for."""
    turns, shown = [], []
    opens, bodies, ends = (np.flatnonzero(ids == x) for x in (TURN, BODY, END))
    for a, b, c in zip(opens.tolist(), bodies.tolist(), ends.tolist(), strict=True):
        role, text = _decode(ids[a + 1 : b], tokenizer), _decode(ids[b + 1 : c], tokenizer)
        turns.append((unescape(role), unescape(text)))
        shown += [RENDERED[TURN], role, RENDERED[BODY], text, RENDERED[END]]
    return turns, "".join(shown)


def digests(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """What format_conversations made, read back from its ids and mask."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_tokenizer(tokenizer)
        for b in batches:
            out = []
            for conv, ids, mask in zip(b.column("conv_id").to_pylist(), b.column("input_ids"), b.column("loss_mask"), strict=True):
                ids, mask = np.asarray(ids.values), np.asarray(mask.values)
                turns, shown = parse(ids, bpe)
                loss = unescape(_decode(ids[mask == 1], bpe))
                told = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(shown)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
