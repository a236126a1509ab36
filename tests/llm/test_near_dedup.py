"""Large groups of texts that are apart, but too near to the similarity for a sketch to tell."""

from __future__ import annotations

import random

import numpy as np
import pytest

near_dedup = pytest.importorskip("crosspanel.llm.near_dedup")

SCHEMA = "doc_id long, text string"


def family(n):
    """n texts of 600 words, nine of them replaced in each: nearly all pairs have a similarity of about 0.75."""
    rng, base, out = random.Random(3), [f"w{i}" for i in range(600)], []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(5, 595, 5), 9):
            words[at] = f"x{rng.randrange(10**9)}"
        out.append((i, " ".join(words)))
    return out + [(n + i, out[i * 7][1] + " tail") for i in range(n // 20)]


def grouped(texts, together=lambda a, b: True, similarity=0.8):
    """Smallest id reachable over pairs of that similarity, by comparing all pairs."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := text.split()) else set() for d, text in texts}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for b in sets:
        for a in (a for a in sets if a < b and together(a, b)):
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in sets}


def test_a_group_near_the_similarity_costs_rows_by_its_texts(spark, monkeypatch):
    texts, made, listed = family(400), [], near_dedup.candidate_pairs

    def counted(points, kind="leaders", *others, **named):
        found = near_dedup.checkpoint(listed(points, kind, *others, **named))
        made.append((kind, found.count()))
        return found

    monkeypatch.setattr(near_dedup, "candidate_pairs", counted)
    got = dict(near_dedup.near_duplicate_groups(spark.createDataFrame(texts, SCHEMA)).collect())
    want = grouped(texts)
    assert got == want and 300 < len(set(want.values())) < 400
    assert 0 < sum(n for kind, n in made if kind != "leaders") < 30 * len(texts), made


@pytest.mark.parametrize("tree", [1 << 24, 1 << 16])
def test_trees_are_compared_whole_and_by_blocks(spark, monkeypatch, tree):
    """Two trees; of the second the texts of a component hold together without being compared."""
    monkeypatch.setattr(near_dedup, "TREE", tree)
    texts = [*family(120), (1000, ""), (1001, "w1 w2"), (1002, "w1 w2"), (1003, "w1 w2 w3")]
    component = {d: 1 if d % 2 and d < 60 else d for d, _ in texts}
    members = spark.createDataFrame([(d, component[d], d % 2) for d, _ in texts], "node long, component long, tree long")
    edges = near_dedup.tree_links(members, spark.createDataFrame(texts, "node long, text string"), 5, 0.8).collect()
    apart = {d: c for d, c in grouped(texts, lambda a, b: a % 2 == b % 2).items()}
    up = {c: c for c in component.values()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in [(r["a"], r["b"]) for r in edges]:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {d: root(component[d]) for d, _ in texts}
    for d, c in apart.items():
        assert got[d] == got[c]
    assert len(set(got.values())) == len({min(component[x] for x in apart if apart[x] == c) for c in apart.values()})
    assert len(edges) < len(texts) * (1 if tree == 1 << 24 else 60)


def test_shared_counts_what_sets_have_in_common(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n, dtype=np.uint64)) for n in (0, 40, 1, 250, 0, 90, 17)]
    hashes, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for many in (1, 64, 1 << 16):
        monkeypatch.setattr(near_dedup, "_HASHES", many)
        assert near_dedup.shared(hashes, at, np.arange(7), np.arange(7)).tolist() == want
    assert near_dedup.shared(hashes, at, np.array([0, 4]), np.arange(7)).tolist() == [[0] * 7] * 2
