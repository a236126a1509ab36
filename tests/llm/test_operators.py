"""The numbered operators against brute force, and on null, empty, long, tied, repeated and clashing rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from crosspanel.llm import chat, decontaminate, exact_dedup, language, lm_score, near_dedup, packing, simhash, token_counts, toxicity, url_filter
from crosspanel.llm.components import components
from crosspanel.llm.queries import BYTES, END_OF_DOCUMENT, QUERIES, RULES, WORDS
from crosspanel.llm.tokens import byte_tokenizer, word_tokenizer

SF = "/root/testdata/sf0.001"
#: Nulls, empty, repeated and long texts, ties, and columns that clash with those of results.
ODD = [(3, "a  b\tc d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, None), (6, ""), (6, ""), (7, "   "), (8, "x"), (9, "word " * 30_000), (10, "ünïcode Straße \U0001f600"), (11, "<|endoftext|> </turn> \\")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"score": F.lit("x"), "length": F.lit(1), "keep_id": F.lit(0), "component_id": F.lit(2), "sha": F.lit("s")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_groups(data):
    groups = {}
    for i, t in data:
        groups.setdefault(norm(t), []).append(i)
    return groups


@pytest.mark.parametrize("limit", [1 << 20, 8])
def test_exact_dedup(spark, odd, docs, none, limit):
    for frame in (odd, docs):
        data = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        groups = brute_groups(data)
        got = exact_dedup.exact_duplicates(frame, limit).collect()
        assert len(got) == len(data)
        smallest = {hashlib.sha256(t.encode()).hexdigest(): (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
        assert all((r["keep_id"], r["group_size"]) == smallest[r["text_sha256"]] for r in got)
        assert sum(r["kept"] for r in got) == len(groups)
        kept = exact_dedup.drop_exact_duplicates(frame)
        assert kept.columns == frame.columns
    assert exact_dedup.exact_duplicates(none).collect() == []


def test_trie_spills_to_the_same_groups():
    words = [f"{i % 37:03d}{'ab' * (i % 5)}".encode() for i in range(500)]
    plain, small = exact_dedup.Trie(), exact_dedup.Trie(limit=16)
    for i, w in enumerate(words):
        plain.add(w, i, 1, b"t")
        small.add(w, i, 1, b"t")
    assert small.spilled and sorted(map(repr, plain.groups())) == sorted(map(repr, small.groups()))


def test_chat(spark):
    said = r"\### Assistant: </turn> ok"
    data = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 2, "assistant", "end\\"), (1, 1, None, None), (1, 2, "assistant", "end\\"), (None, 0, "a\nb<turn>", "x")]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("input_ids", F.lit(1))
    formatted = chat.format_conversations(frame, BYTES)
    for r in formatted.collect():
        mine = sorted([(t, role or "", text or "") for c, t, role, text in data if c == r["conv_id"]])
        turns, _ = chat.parse(np.array(r["input_ids"]), byte_tokenizer(BYTES))
        assert turns == [(role, text) for _, role, text in mine]
        loss = chat.unescape(byte_tokenizer(BYTES).decode_bytes([i for i, m in zip(r["input_ids"], r["loss_mask"], strict=True) if m]).decode())
        assert loss == "".join(text for _, role, text in mine if role == "assistant")
    assert chat.digests(chat.format_conversations(frame.limit(0), BYTES), BYTES).collect() == []


def test_urls(spark):
    urls = [None, "no scheme", "HTTP://WWW.Example.ORG/en/12?x#y", "http://example.org/es/", "http://a.org", "http://b.com/de/1", "http://b.com/fr/1", "http://notexample.net/es/1#", "x://h/" + "a/" * 3000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    bad = spark.createDataFrame([(7, 1)], "page_id long, bad int")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, bad, RULES).collect()}
    assert (got[0]["host"], got[0]["path"]) == ("", "") == (got[1]["host"], got[1]["path"])
    assert [got[i]["rule"] for i in range(2, 8)] == ["example.org/en/1", "example.org/es/", None, "com/de/", "com/fr/", None]
    assert [got[i]["verdict"] for i in (2, 3, 5, 6)] == ["block", "block", "block", "allow"] and len(got) == len(urls)
    many = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://spam.net/"), F.when(F.col("id") % 2 == 0, "ads").otherwise("news"), F.lit("/"), F.col("id")).alias("url"))
    labels = many.select("page_id", (F.col("page_id") % 2 == 0).cast("int").alias("bad"))
    verdicts = {(r["page_id"] % 2, r["verdict"]) for r in url_filter.judge_urls(many, labels, RULES).collect()}
    assert verdicts == {(0, "block"), (1, "allow")}
    assert url_filter.judge_urls(pages.limit(0), bad, RULES).collect() == []


def test_rare_bad_section_among_many_is_blocked(spark):
    section = F.col("id") % 25
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://news.net/"), F.translate(section.cast("string"), "0123456789", "ghijklmnop"), F.lit("/x")).alias("url"), (section == 7).cast("int").alias("bad"))
    verdicts = {(r["page_id"] % 25 == 7, r["verdict"]) for r in url_filter.judge_urls(pages, pages.select("page_id", "bad"), RULES).collect()}
    assert verdicts == {(True, "block"), (False, "allow")}
    few = pages.select("page_id", "bad").filter("page_id % 25 < 3")  # sections without labels are one branch still
    assert len({r["template"] for r in url_filter.judge_urls(pages, few, RULES).collect()}) == 1


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_token_counts(odd, docs, none, block):
    bpe = byte_tokenizer(BYTES)
    for frame in (odd, docs):
        want = sorted(((r[0], len(bpe.encode_ordinary(r[1] or ""))) for r in frame.select("doc_id", "text").collect()), key=repr)
        assert rows(token_counts.document_token_counts(frame, BYTES, END_OF_DOCUMENT, block).select("doc_id", "n_tokens")) == want
    assert token_counts.document_token_counts(none, BYTES, END_OF_DOCUMENT).collect() == []


def test_token_files(spark, tmp_path):
    np.array([1, 2, 9, 9, 3, 4, 5], dtype="<u2").tofile(tmp_path / "a.bin")
    blocks = token_counts.read_token_files(spark, str(tmp_path), block_tokens=2)
    got = token_counts.stitch(token_counts.scan_blocks(blocks, 9)).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["n_tokens"], r["closed"]) for r in got] == [(0, 2, True), (1, 0, True), (2, 3, False)]


def test_decontaminate(spark, odd, docs, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [(r["item_id"], words(r["text"])) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, x in items if f" {x} " in f" {words(r['text'])} "}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert want <= got
    item = bench.filter("item_id = 0").collect()[0]["text"].split()
    changed = " ".join(["start", *item[:-1], "changed", "end"])
    planted = spark.createDataFrame([(1, changed), (2, "nothing of it"), (None, " ".join(item).upper())], SCHEMA)
    assert {r["doc_id"] for r in decontaminate.contaminated(planted, bench).collect()} == {1, None}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(planted, bench).collect()] == [2]
    odd_items = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "x"), (3, "x")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, odd_items).collect()} == {(8, 3)}
    assert decontaminate.contaminated(none, bench).collect() == [] == decontaminate.contaminated(odd, bench.limit(0)).collect()


def test_decontaminate_weighs_the_whole_benchmark(spark, monkeypatch):
    """Similarities by the stated formula, the same however the items are cut into blocks."""
    common = "one two three four five six seven"
    texts = [f"{common} " + " ".join(f"q{i}x{j}" for j in range(40)) for i in range(30)] + ["only three words", "no"]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    grams = lambda t: Counter(tuple(w[a : a + 5]) for w in [t.split()] for a in range(max(1, len(w) - 4)))
    having = Counter(g for t in texts for g in set(grams(t)))
    weigh = lambda c: sum(np.log1p(len(texts) / max(1, having[g])) * n for g, n in c.items())
    changed = texts[5].replace("q5x38", "other")
    want = {(1, 5): weigh(grams(changed) & grams(texts[5])) / weigh(grams(changed) | grams(texts[5])), (2, 7): 1.0, (3, 30): 1.0}
    planted = spark.createDataFrame([(1, changed), (2, texts[7]), (3, texts[30]), (4, "nothing of it at all")], SCHEMA)
    for size in (1 << 22, 1 << 10):
        monkeypatch.setattr(decontaminate, "BLOCK", size)
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(planted, bench, similarity=0.7).collect()}
        assert got == pytest.approx(want)
        assert [r["doc_id"] for r in decontaminate.drop_contaminated(planted, bench, similarity=0.7).collect()] == [4]


def test_pack(odd, docs, none):
    tokenizer = word_tokenizer(WORDS)[0]
    for frame in (odd, docs):
        want = []
        for i, t in frame.select("doc_id", "text").collect():
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
            want += [(i, n, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for n, a in enumerate(range(0, len(ids), 4096))]
        got = packing.pack(frame, WORDS).collect()
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
        full = {}
        for r in got:
            full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in full.values():
            places.sort()
            assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()] and sum(n for _, n in places) <= 4096
        assert len(full) <= -(-sum(w[3] for w in want) // 4096) + 1
    assert packing.pack(none, WORDS).collect() == []


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(0)
    lengths, counts = np.unique(rng.integers(1, 101, 5000), return_counts=True)
    patterns = packing.pack_lengths(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), 100)
    used = {}
    for p in patterns:
        assert sum(p.lengths) <= 100
        for n in p.lengths:
            used[n] = used.get(n, 0) + p.bins
    assert used == dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    assert sum(p.bins for p in patterns) <= 1.01 * (lengths * counts).sum() / 100


def test_dominance_goes_on_past_a_length_that_no_rule_fixes():
    count = [0] * 101
    count[90], count[60], count[40], count[3], count[2] = 1, 5, 5, 2, 2  # beside 90 two small pieces fit: no rule
    fixed = packing.reduce_by_dominance(count, 100)
    assert any(p.lengths == [60, 40] and p.bins == 5 for p in fixed) and not count[60] and not count[40] and count[90] == 1


def test_lm_score(spark, odd, none):
    train = [(i, "the cat sat on the mat and the dog ran " * 3) for i in range(30)] + [(100 + i, "zq xv qqz vxx zzq jjk " * 5) for i in range(30)]
    frame = spark.createDataFrame(train, SCHEMA)
    got = lm_score.cross_entropy_difference(frame, frame.filter("doc_id < 30").select("doc_id"), BYTES, bits=16).collect()
    assert min(r["score"] for r in got if r["doc_id"] < 30) > max(r["score"] for r in got if r["doc_id"] >= 100)
    odd_scores = lm_score.cross_entropy_difference(odd, odd.select("doc_id"), BYTES, bits=16).collect()
    assert len(odd_scores) == len(ODD) and all(r["score"] == 0 for r in odd_scores if r["doc_id"] in (5, 6))
    assert lm_score.cross_entropy_difference(none, none.select("doc_id"), BYTES, bits=16).collect() == []


def test_lm_score_counts_are_exact(spark, odd):
    """Losses of exact counts of both models, matched in tokens, without the text's own, against the formula."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{a:x}" for a in rng.integers(0, 1 << 16, 60)) for _ in range(200)] + ["a b " * 70_000, "a b", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA).unionByName(odd.select("doc_id", "text"))
    data = [(r["doc_id"], byte_tokenizer(BYTES).encode_ordinary(r["text"] or "")) for r in frame.collect()]
    target = {i for i, _ in data if i is not None and i < 100}
    tokens = sum(len(ids) for _, ids in data)
    times = sum(len(ids) for i, ids in data if i in target) / tokens

    def counted(ids):
        before = [lm_score.START, *ids[:-1]] if ids else []
        return Counter(zip(before, ids, strict=True)), Counter(before), Counter(ids)

    losses = []
    for chosen, scale in ((lambda i: i in target, 1), (lambda i: True, times)):
        whole = [Counter(), Counter(), Counter()]
        for i, ids in data:
            for all_of, own in zip(whole, counted(ids), strict=True):
                all_of.update(own if chosen(i) else {})
        found = []
        for i, ids in data:
            without = counted(ids) if chosen(i) else (Counter(), Counter(), Counter())
            n = [lambda k, a=a, b=b: (a[k] - b[k]) * scale for a, b in zip(whole, without, strict=True)]
            total = (sum(whole[2].values()) - sum(without[2].values())) * scale + lm_score.UNIFORM * lm_score.VOCABULARY
            loss = sum(-k * np.log((n[0]((c, x)) + 20 * (n[2](x) + lm_score.UNIFORM) / total) / (n[1](c) + 20)) for (c, x), k in counted(ids)[0].items())
            found.append(loss / max(1, len(ids)))
        losses.append(found)
    want = sorted((repr(i), len(ids), round(t, 6), round(b, 6)) for (i, ids), t, b in zip(data, *losses, strict=True))
    got = lm_score.cross_entropy_difference(frame, frame.filter("doc_id < 100").select("doc_id"), BYTES, bits=8).collect()
    got = sorted((repr(r["doc_id"]), r["n_tokens"], r["target_loss"], r["background_loss"]) for r in got)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2:] for x in sorted(got)], [x[2:] for x in want], atol=2e-6)


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, odd, docs, none):
    data = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    fps = {i: brute_fingerprint(t) for i, t in data}
    ids = sorted(fps)
    up = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and up[b] < up[a]:
                    up[a], changed = up[b], True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs, depth=3).collect()}
    assert got == {i: (f"{fps[i]:016x}", up[i]) for i in ids}
    strange = simhash.simhash_components(odd).collect()
    assert len(strange) == len(ODD) and {r["component_id"] for r in strange if r["doc_id"] in (5, 6, 7)} == {5}
    assert simhash.simhash_components(none).collect() == []


def test_vantage_points_lose_no_pair():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    x = np.concatenate([x, x[:300] ^ (np.uint64(1) << rng.integers(0, 63, 300, dtype=np.uint64))])
    want = set(zip(*(a.tolist() for a in np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2)), strict=True))
    assert {(p, q) for a, b in simhash.near(x, x, 2) for p, q in zip(a.tolist(), b.tolist(), strict=True)} == want


def test_repeated_lines_are_near_duplicates(spark):
    """Sets of shingles are compared, so a text and itself with a sentence many times over are near duplicates."""
    words = [f"w{i * 7919 % 1009}" for i in range(200)]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + words[40:60] * 20)), (3, " ".join(f"v{i}" for i in range(200)))], SCHEMA)
    assert dict(near_dedup.near_duplicate_groups(frame).collect()) == {1: 1, 2: 1, 3: 3}


def test_near_duplicates(spark, odd, none):
    base = " ".join(f"w{i * 7919 % 1009}" for i in range(200))
    words = base.split()
    near = " ".join([*words[:50], "new", *words[51:]])
    far = " ".join(w if i % 4 else "other" for i, w in enumerate(words))
    frame = spark.createDataFrame([(5, base), (2, near), (9, far), (4, base + " tail"), (7, "short text"), (8, "short  text")], SCHEMA).withColumn("node", F.lit(1))
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(frame).collect()) == [2, 7, 9]
    got = dict(near_dedup.near_duplicate_groups(odd).filter("doc_id is not null").distinct().collect())
    assert got[3] == 1 and got[6] == 5 and got[7] == 5 and got[9] == 9
    assert near_dedup.drop_near_duplicates(none).collect() == []


def test_near_duplicates_against_all_pairs(spark):
    """Whole sf0.01 table: all pairs by sets of five-word shingles, linked by union-find."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shingles, at = {}, {}
    for r in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in r["text"] or ""))
        shingles[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}
        for s in shingles[r["doc_id"]]:
            at.setdefault(s, []).append(r["doc_id"])
    up = {d: d for d in shingles}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, mine in shingles.items():
        shared = Counter(x for s in mine for x in at[s] if x < d)
        for x, n in shared.items():
            if n >= 0.8 * (len(mine) + len(shingles[x]) - n) - 1e-9:
                a, b = sorted((root(d), root(x)))
                up[b] = a
    got = dict(near_dedup.near_duplicate_groups(docs).select("doc_id", "component_id").collect())
    assert got == {d: root(d) for d in shingles}


def test_near_duplicate_rounds_find_every_pair():
    """One word shared by many texts of three families: the first round reports each text with a partner, the last
    every pair of different groups, the second the likeliest of each text and group."""
    rng = np.random.default_rng(5)
    family = rng.integers(0, 3, 700)
    base = rng.integers(0, 2**63, (3, 2), dtype=np.uint64)
    check = base[family] ^ (np.uint64(1) << rng.integers(0, 64, (700, 2), dtype=np.uint64))
    sets = [np.concatenate([rng.integers(0, 2**64, 6, dtype=np.uint64), np.random.default_rng(f).integers(0, 2**64, 100, dtype=np.uint64)]) for f in family]
    size, sketch = near_dedup.set_sketch(np.concatenate(sets), np.arange(701) * 106)
    frame = pd.DataFrame({"node": np.arange(700), "word": np.where(np.arange(700) % 7 == 0, rng.integers(0, 1 << 24, 700), 9), "home": True, "check0": check[:, 0].view(np.int64), "check1": check[:, 1].view(np.int64), "size": size})
    word = frame["word"].to_numpy().astype(np.uint64)
    want = {
        (i, j)
        for j in range(700)
        for i in range(j)
        if simhash.distance(word[i], word[j]) <= near_dedup.RADIUS and sum(simhash.distance(check[i], check[j]).tolist()) <= near_dedup.CHECK_BITS
    }
    first = near_dedup._pairs_of_shard("leaders", 0.8)(frame)
    some = set(zip(first["a"].tolist(), first["b"].tolist(), strict=True))
    assert {p for p in some if p[0] < p[1]} <= want and {x for p in want for x in p} <= {x for p in some for x in p}
    group = np.minimum(np.arange(700), 350)
    frame = frame.assign(component=group, sketch=[x.tobytes() for x in sketch])
    last = near_dedup._pairs_of_shard("all", 0.8)(frame)
    across = {(i, j) for i, j in want if group[i] != group[j]}
    assert sorted(zip(last["a"].tolist(), last["b"].tolist(), strict=True)) == sorted(across)
    second = near_dedup._pairs_of_shard("likeliest", 0.8)(frame)
    assert sorted(zip(second["text"], second["other"], strict=True)) == sorted({(i, group[j]) for i, j in across} | {(j, group[i]) for i, j in across})


def test_set_sketch_rejects_only_what_is_below():
    """Pairs of known similarity: those at 0.8 are never rejected, those at 0.6 nearly always, small or large."""
    rng = np.random.default_rng(7)
    for shared, own in ((32, 4), (320, 40), (3200, 400)):
        for similar, part in ((True, own), (False, int(shared / 3))):
            sets, n = [], 200
            for _ in range(n):
                common = rng.integers(0, 2**64, shared, dtype=np.uint64)
                sets += [np.concatenate([common, rng.integers(0, 2**64, part, dtype=np.uint64)]) for _ in range(2)]
            size, sketch = near_dedup.set_sketch(np.concatenate(sets), np.arange(2 * n + 1) * (shared + part))
            pairs = np.arange(n) * 2
            estimate, may = near_dedup.likeness(sketch.view(np.uint64), size, pairs, pairs + 1, 0.8)
            assert size.tolist() == [shared + part] * (2 * n)
            assert abs(estimate.mean() - shared / (shared + 2 * part)) < 0.02 and (may.all() if similar else may.mean() < 0.1)


def test_repeated_ids_lose_no_text(spark):
    """Rows are told apart by id and text, whatever columns there are besides."""
    same, other = "the same text of some ten words or more in all", "a text of its own that nobody else has at all"
    frame = spark.createDataFrame([(1, same), (2, same), (2, other), (None, same), (2, other)], SCHEMA).withColumns({"_id": F.lit(1), "key": F.lit(2), "stays": F.lit(3)})
    for drop in (exact_dedup.drop_exact_duplicates, near_dedup.drop_near_duplicates):
        kept = drop(frame)
        assert kept.columns == frame.columns and rows(kept.select("doc_id", "text")) == [(1, same), (2, other)]
    nulls = spark.createDataFrame([(None, same), (None, same), (None, other), (None, None), (None, "")], SCHEMA)
    assert len(rows(exact_dedup.drop_exact_duplicates(nulls))) == 3 == len(rows(near_dedup.drop_near_duplicates(nulls)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == 100
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_language(spark, odd, none):
    got = QUERIES["op9_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    learned = language.learn_filter(spark.createDataFrame([("the cat the cat", "en"), ("le chat le chat", "fr"), (None, "de"), ("x", None)], "text string, lang string"), bits=12)
    assert learned.languages == ["en", "fr"]
    both = language.learn_filter(spark.createDataFrame([("a chat", "en")] * 2 + [("chat", "fr")] * 2, "text string, lang string"))
    assert all(both.masks[0][int(at[0])] == 0b11 for at in language.slots(np.array([int.from_bytes(b"chat", "big")], dtype=np.uint32), both.bits))  # both contain it
    preds = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, learned).collect()}
    assert preds[5] == preds[6] == preds[7] == "und" and preds[8] in ("en", "fr")
    assert language.identify(none, learned).collect() == []
    assert {r["lang_pred"] for r in language.identify(odd, language.learn_filter(none.withColumn("lang", F.lit("x")))).collect()} == {"und"}


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_toxicity_detects_what_it_has_not_seen(spark, scale):
    sf = f"/root/testdata/{scale}"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = QUERIES["op10_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    toxic, other = ([r for r in got if r["toxic"] == t] for t in (1, 0))
    assert np.mean([r["predicted"] for r in toxic]) >= 0.8 and np.mean([r["predicted"] for r in other]) <= 0.02
    below = np.array([r["score"] for r in other])
    assert np.mean([(below < r["score"]).mean() + (below == r["score"]).mean() / 2 for r in toxic]) >= 0.93


def test_toxicity_is_kneser_ney(spark):
    """Likelihood ratios of a toy corpus by the formula, word by word."""
    corpus = [("you foolish clownish lot", 1), ("clowns all of you", 1), ("what a lovely day", 0), ("you and the foolproof day", 0), ("day of days", 0)]
    n, pred = [Counter(), Counter()], set()
    for text, toxic in corpus:
        w = text.split()
        n[toxic].update(set(w))
        pred |= set(zip(["", *w[:-1]], w, strict=True))
    after = Counter(b for _, b in pred)
    cut = lambda w, i: w if i == 2 else w[: (4, 6)[i]]

    def p(c, w, i):
        """Of step i of the word after step i - 1, in class c; None where nothing follows that was seen."""
        within = lambda v: i == 0 or cut(v, i - 1) == cut(w, i - 1)
        count, shared = Counter(), Counter()
        for v, x in n[c].items():
            count[cut(v, i)] += x * within(v)
        for v, x in after.items():
            shared[cut(v, i)] += x * within(v)
        total, kinds = sum(count.values()), sum(x > 0 for x in count.values())
        rest = toxicity.DISCOUNT * kinds / total if total else 1.0
        known = cut(w, i) in {cut(v, i) for v in after}
        base = shared[cut(w, i)] / sum(shared.values()) if known else 1.0
        return (max(count[cut(w, i)] - toxicity.DISCOUNT, 0) / total if total and known else 0.0) + rest * base, known

    def ratio(w):
        out = 0.0
        for i in range(3):
            (a, known), (b, _) = p(1, w, i), p(0, w, i)
            out += np.log(a / b)
            if not known:
                break
        return out

    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(corpus)], SCHEMA)
    model = toxicity.learn_toxicity(frame, spark.createDataFrame([(i, c) for i, (_, c) in enumerate(corpus)], "doc_id long, toxic int"))
    for text in ("clownish", "clowning about", "foolish day", "Days of NEVER seen", "lovely lot you all", "clo"):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        want = np.log(np.mean([np.exp(ratio(w)) for w in text.lower().split()]))
        assert model.evidence(raw, np.array([0, len(raw)]))[0] == pytest.approx(want, abs=1e-5), text


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(odd, labels)
    scores = toxicity.toxicity_scores(odd, model).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)
    assert len({r["score"] for r in scores if r["doc_id"] in (5, 6, 7)}) == 1
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        assert toxicity.drop_toxic(odd, few).columns == odd.columns and toxicity.drop_toxic(odd, few).count() == len(ODD)
    assert toxicity.toxicity_scores(none, toxicity.learn_toxicity(none, labels)).collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).persist()
        assert kept.columns == docs.columns and kept.count() <= before.count()
    texts = [r["text"] for r in kept.collect()]
    assert len({norm(t) for t in texts}) == len(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    assert not [1 for i, a in enumerate(sets) for b in sets[:i] if len(a & b) >= 0.8 * len(a | b)]
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == len(texts)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and long texts, ties, repeated rows, clashing columns; then no rows at all."""
    import corpus_pipeline

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    frame = spark.createDataFrame([*ODD, ODD[0], (3, "another text of the same id")], SCHEMA)
    for f in schema.fields[2:]:
        frame = frame.withColumn(f.name, F.lit(1).cast(f.dataType))
    frame = frame.withColumns({"key": F.lit("x"), "component": F.lit(1), "stays": F.lit(True)})
    for name, docs in (("odd", frame), ("none", frame.limit(0))):
        sf = str(tmp_path / name)
        docs.write.parquet(f"{sf}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
        kept = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, sf)
            assert kept.columns == frame.columns
        packed = corpus_pipeline.run(spark, sf).collect()
        # Left are: "a b c ...", one empty text, "x", the long one, two of odd letters, and the other text of id 3.
        assert {r["doc_id"] for r in packed} == ({1, 5, 8, 9, 10, 11, 3} if name == "odd" else set())
