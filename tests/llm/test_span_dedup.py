"""Removal of repeated passages against all windows in a dictionary."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import span_dedup

SF = "/root/testdata/sf0.001"
_rng = np.random.default_rng(3)
_word = [f"w{i}" for i in range(400)]
_long = [" ".join(_rng.choice(_word, 80)) for _ in range(6)]
#: Passages shared whole and in part, shifted, inside one text and over itself; periods; nulls, blanks and repeated rows.
ODD = [
    (1, _long[0]), (2, f"x {_long[0]} y"), (3, " ".join(_long[0].split()[10:60])), (4, f"{_long[1]} {_long[1]}"), (5, _long[2]), (5, _long[2]), (None, _long[3]), (None, f"{_long[3]} z"),
    (6, "a " * 3000), (7, "a b " * 20), (8, None), (9, ""), (9, ""), (10, " \t\r\n"), (11, " ".join(_long[4].split()[:40]) + " " + " ".join(_long[5].split()[:40])),
    (12, _long[4]), (13, _long[5].replace(" ", "\x0b\n", 30)), (14, " ".join(_long[0].split()[:34])), (15, "Größe ist \U0001f600 " * 30),
]


def brute(data, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in data]
    times = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(data, words, strict=True):
        gone = {j for k in range(len(w) - window + 1) if times[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        spans = [k for k in range(len(w)) if k in gone and k - 1 not in gone]
        ends = [k + 1 for k in range(len(w)) if k in gone and k + 1 not in gone]
        out.append((i, len(w), len(gone), list(zip(spans, ends, strict=True)), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], [tuple(s) for s in r["spans"]], r["text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("window", [1, 4, 35, 70])
def test_against_all_windows(spark, window, monkeypatch):
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"run": F.lit(1), "spans": F.lit("s"), "path": F.lit(2), "n_words": F.lit("n")})
    data = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert found(span_dedup.remove_repeats(odd, window)) == brute(data, window)
    monkeypatch.setattr(span_dedup, "RUN_ROWS", 1)  # a block of texts each run
    assert found(span_dedup.remove_repeats(odd.repartition(7), window)) == brute(data, window)
    assert span_dedup.remove_repeats(odd.limit(0), window).collect() == []


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = found(span_dedup.remove_repeats(docs))
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 35)
    assert any(r[2] for r in got)


def test_branching_paths_are_expanded_once_and_others_never(spark):
    """Two contexts of one passage branch at its edges only; copies do not branch."""
    copies = spark.createDataFrame([(i, _long[0]) for i in range(50)], "doc_id long, text string")
    cut = span_dedup.cut_runs(copies, 35)
    repeated = span_dedup.repeated_paths(cut)
    assert repeated.filter("branches").count() == 0 and repeated.count() > 0
    mixed = copies.unionByName(spark.createDataFrame([(99, f"{_long[1]} {_long[0]} {_long[2]}")], copies.schema))
    cut = span_dedup.cut_runs(mixed, 35)
    repeated = span_dedup.repeated_paths(cut)
    assert repeated.filter("branches").count() > 0 and repeated.filter("not branches").count() > 0
    with pytest.raises(ValueError, match="window"):
        span_dedup.remove_repeats(copies, 0)
