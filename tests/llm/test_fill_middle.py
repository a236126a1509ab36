"""Fill-in-the-middle against plain Python, and the word arithmetic against a byte loop."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import fill_middle

SF = "/root/testdata/sf0.001"
ODD = [(1, "a\nb\nc"), (None, "x\ny"), (2, None), (3, ""), (3, "a\n"), (4, "\n\n\n"), (5, "one <P> two\nthree"), (6, "<S\n>x\n<M"), (7, "ünï\n\U0001f600\nß" * 50), (8, "line\n" * 40_000), (9, "no break at all"), (-5, "<M>"), (10, "a\r\nb\x00\nc\x0b")]


def brute(i, text, unit="line", rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return i, n, "plain", None, None, text
    if h4 % 100 < spm:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "rate"), [("line", 100), ("character", 100), ("line", 60)])
def test_fill_in_middle(spark, unit, rate):
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"form": F.lit("z"), "n": F.lit(0), "output": F.lit("q")})
    for frame in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        data = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        made = fill_middle.fill_in_middle(frame, rate=rate, unit=unit)
        assert sorted(map(tuple, made.collect()), key=repr) == sorted((brute(i, t, unit, rate) for i, t in data), key=repr)
        back = made.select("doc_id", fill_middle.restored().alias("text")).collect()
        assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in data), key=repr)
    assert fill_middle.fill_in_middle(odd.limit(0)).collect() == []
    with pytest.raises(ValueError, match="unit"):
        fill_middle.fill_in_middle(odd, unit="word")


def test_marks_of_all_byte_neighbours():
    rng = np.random.default_rng(5)
    for size in (0, 1, 7, 8, 9, 64, 5000):
        raw = rng.choice(np.array([0x0A, 0x0B, 0x8A, 0x0A ^ 0x80, 0, 0xFF, 0x09, 0x41], dtype=np.uint8), size)
        marks, at = fill_middle.Marks(fill_middle.line_ends(fill_middle._words(raw))), np.arange(size + 1)
        plain = np.concatenate([[0], np.cumsum(raw == 0x0A)])
        assert (marks.before(at) == plain).all()
        assert (marks.select(np.arange(plain[-1])) == np.flatnonzero(raw == 0x0A)).all()
