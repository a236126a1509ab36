"""Cross-tokenizer alignment against a token-by-token walk, and its postings against what they were made from."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from crosspanel.llm import alignment
from crosspanel.llm.queries import BYTES, PIECES, QUERIES
from crosspanel.llm.tokens import byte_tokenizer

SF = "/root/testdata/sf0.001"
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
ODD = [(1, "a  b\tc\n\nd"), (None, "the the the"), (2, None), (3, ""), (3, ""), (4, "the the"), (5, "▁ of"), (6, "<|endoftext|> <s> <0x0A> </s>"), (7, "ünïcode Straße \U0001f600\x00 \r\n x"), (8, "the " * 3000), (9, "   ")]


def brute(rows):
    """Walks both token lists byte by byte."""
    bpe, pieces = byte_tokenizer(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs, holding = [], Counter()
    for i, text in rows:
        a, b, links, groups = [], [], [], []
        if text:
            raw = f" {text}".encode()
            a, b = bpe.encode_ordinary(f" {text}"), pieces.encode(text)
            bytes_b = [bytes([int(pieces.id_to_piece(x)[3:5], 16)]) if pieces.is_byte(x) else pieces.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(bytes_b) != raw:
                a, b = [], []
        if a:
            of_a = [k for k, x in enumerate(a) for _ in bpe.decode_single_token_bytes(x)]
            of_b = [k for k, x in enumerate(bytes_b) for _ in x]
            seen = list(dict.fromkeys(zip(of_a, of_b, strict=True)))
            links = [(a[x], b[y]) for x, y in seen]
            group = ([], [])
            for at, (x, y) in enumerate(zip(of_a, of_b, strict=True)):
                for side, k in zip(group, (x, y), strict=True):
                    if not side or side[-1] != k:
                        side.append(k)
                last = at + 1 == len(of_a)
                if last or (of_a[at + 1] != x and of_b[at + 1] != y):
                    groups.append(",".join(str(a[k]) for k in group[0]) + "|" + ",".join(str(b[k]) for k in group[1]))
                    group = ([], [])
        holding.update(set(links))
        docs.append((i, a, b, links, groups))
    best = defaultdict(int)
    for (x, _), n in holding.items():
        best[x] = max(best[x], n)
    return [(i, len(a), len(b), len(groups), len(links), sum(holding[p] == best[p[0]] for p in links), sum(holding[p] for p in links), ";".join(groups)) for i, a, b, links, groups in docs]


def test_alignment(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"groups": F.lit(1), "pair": F.lit("x"), "block": F.lit("y")})
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for frame in (odd, odd.repartition(5), docs):
        data = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        got = [tuple(r) for r in alignment.align(frame, BYTES, PIECES).select(NAMES).collect()]
        assert sorted(got, key=repr) == sorted(brute(data), key=repr)
    assert alignment.align(odd.limit(0), BYTES, PIECES).collect() == []


def test_blocks_and_common_pairs_do_not_change_the_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    whole = sorted(map(tuple, alignment.align(docs, BYTES, PIECES, digest=True).collect()))
    monkeypatch.setattr(alignment, "COMMON", 0)  # none common
    rare = sorted(map(tuple, alignment.align(docs, BYTES, PIECES, digest=True).collect()))
    monkeypatch.setattr(alignment, "COMMON", 1 << 40)  # all common
    common = sorted(map(tuple, alignment.align(docs, BYTES, PIECES, digest=True).collect()))
    assert whole == rare == common


def test_query_gives_digests(spark):
    got = QUERIES["op11_align"](spark, SF)
    want = {r[0]: hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "" for r in brute([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])}
    assert {r["doc_id"]: r["groups_sha256"] for r in got.collect()} == want


@pytest.mark.parametrize("pairs", [1, 40])
def test_postings_give_back_what_went_in(pairs):
    import pyarrow as pa

    rng = np.random.default_rng(pairs)
    key = np.unique(rng.integers(0, pairs, 30_000) * alignment.PLACES + (rng.integers(0, alignment.PLACES, 30_000) ** 2 // alignment.PLACES))
    pair, place = key // alignment.PLACES * 7, key % alignment.PLACES
    times = np.where(rng.random(len(key)) < 0.9, rng.integers(1, 4, len(key)), rng.integers(1, 100_000, len(key)))
    order = rng.permutation(len(key))
    made = alignment.containers(pair[order], place[order], times[order])
    n = np.asarray(made["n_docs"])
    row, where, found = alignment.postings_of(n, pa.chunked_array([made["places"]]), pa.chunked_array([made["planes"]]))
    back = sorted(zip(np.asarray(made["pair"])[row].tolist(), where.tolist(), found.tolist(), strict=True))
    assert back == sorted(zip(pair.tolist(), place.tolist(), times.tolist(), strict=True))
    assert np.asarray(made["n_links"]).sum() == times.sum()
    empty = np.zeros(0, dtype=np.int64)
    assert len(alignment.containers(empty, empty, empty)["pair"]) == 0
