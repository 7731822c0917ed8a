"""Problems 2, 3, 7 and 8 on small tables: brute force, hot groups, and odd rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from passagework.llm import encoding, lexicon, neighbours, packing, similar

VECTORS = "chunk_index int, embedding array<float>, id string, v string"

# ---------------------------------------------------------------- 2


def near(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    return {(r.chunk_index, r.neighbour): r.cosine for r in neighbours.neighbours(df, dim=16, **options).collect()}


def brute_near(rows, k, least):
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for i, a in x.items():
        near = sorted(((-float(a @ b / np.sqrt((a @ a) * (b @ b))), j) for j, b in x.items() if j != i))[:k]
        out |= {(i, j): -c for c, j in near if -c >= least}
    return out


def clustered(n, rng, spread=0.12):
    centres = rng.standard_normal((n // 4, 16))
    return [(i, (centres[i % len(centres)] + spread * rng.standard_normal(16)).round(4).tolist()) for i in range(n)]


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = clustered(800, rng)
    rows += [(1000, None), (1001, []), (1002, [1.0]), (1003, [0.0] * 16), (1004, [float("nan")] * 16), (1005, [None] + [1.0] * 15), (None, [1.0] * 16), rows[5], (1006, [x * 3 for x in rows[7][1]])]
    got, want = near(spark, rows, k=3, min_cosine=0.8, leaf=128), brute_near(rows, 3, 0.8)
    assert len(got.keys() & want.keys()) / len(want) >= 0.97 and all(abs(c - want[p]) < 1e-5 for p, c in got.items() if p in want)
    assert max(Counter(i for i, _ in got).values()) <= 3


def test_neighbours_whatever_their_cosine(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).round(4).tolist()) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(3)] + [(500, None), rows[5]]
    got, want = near(spark, rows, k=3, min_cosine=None, leaf=100), brute_near(rows, 3, -1)
    # each has all its places, also where nothing is near
    assert set(Counter(i for i, _ in got).values()) == {3} and len(got) == len(want)
    assert len(got.keys() & want.keys()) / len(want) >= 0.95 and all(abs(c - want[p]) < 1e-5 for p, c in got.items() if p in want)


def test_a_third_of_the_vectors_are_equal(spark):
    rng = np.random.default_rng(2)
    rows = clustered(200, rng) + [(1000 + i, [1.0] * 16) for i in range(100)] + [(2000 + i, [1.0] * 15 + [1.1]) for i in range(3)]
    got = near(spark, rows, k=5, min_cosine=0.9, leaf=64)
    hot = defaultdict(list)
    for i, j in got:
        hot[i].append(j)
    # ties go to the smaller key
    assert all(sorted(hot[1000 + i]) == [1000 + j for j in range(6) if j != i][:5] for i in range(100))
    assert all(sorted(hot[2000 + i]) == sorted([2000 + j for j in range(3) if j != i] + [1000, 1001, 1002]) for i in range(3))


def test_vectors_are_read_five_times_at_most(spark):
    rows = clustered(200, np.random.default_rng(6))
    # copies, keys delivered again, and a key with two unlike vectors
    rows += [(1000 + i, rows[7][1]) for i in range(3)] + rows[:5] + [(2000, [1.0] * 16), (2000, [1.0, -1.0] * 8), (2001, [1.0] * 15 + [1.1]), (2002, [1.0, -1.0] * 7 + [1.0, -1.1])]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS).mapInArrow(counted, VECTORS)
    got = {(r.chunk_index, r.neighbour): r.cosine for r in neighbours.neighbours(df, k=3, min_cosine=0.8, dim=16, leaf=128).collect()}
    assert len(rows) <= read.value <= 5 * len(rows)
    # either of the two vectors, but the same in all of the result
    want = [brute_near([*rows, (2000, v)], 3, 0.8) for v in ([1.0] * 16, [1.0, -1.0] * 8)]
    shared = [{(i, j) for i, j in got if 2000 in (i, j)} == {(i, j) for i, j in w if 2000 in (i, j)} for w in want]
    assert sorted(shared) == [False, True] and len(got.keys() & want[shared.index(True)].keys()) >= 0.97 * len(want[0])


def test_no_vectors(spark):
    assert near(spark, [(1, None)]) == {} and near(spark, [(1, [1.0] * 16)]) == {}


def test_chi_square_and_sketches():
    assert abs(neighbours.chi_square(0.9, 128) - 148.9) < 0.5 and abs(neighbours.chi_square(0.01, 64) - 40.6) < 0.5
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 384)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sketch = x @ neighbours.projections(384, 1)[0]
    step = 6 / 128**0.5 / 16
    assert np.abs(neighbours.dequantize(neighbours.quantize(sketch)) - np.clip(sketch, -8 * step, 8 * step)).max() <= step / 2 + 1e-6


def test_neighbours_closer_than_a_step():
    rng = np.random.default_rng(4)
    x = rng.standard_normal(384) + 0.01 * rng.standard_normal((600, 384))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sketches = neighbours.dequantize(neighbours.quantize(x.astype(np.float32) @ neighbours.projections(384, 1)[0]))
    got = {p for i, j in neighbours.near_in_leaf(sketches, 0.5, 10) for p in zip(i.tolist(), j.tolist(), strict=True)}
    cosine = x @ x.T - 2 * np.eye(600)
    want = [(min(i, j), max(i, j)) for i in range(600) for j in np.argsort(-cosine[i])[:10].tolist()]
    assert sum(p in got for p in want) >= 0.9 * len(want)


def test_tree_leaves_are_even():
    points = np.random.default_rng(3).standard_normal((4096, 8)).astype(np.float32)
    points[:1400] = points[0] + 1e-3 * points[:1400]
    leaves = neighbours.leaf_of(points, neighbours.fit_tree(points, 5), 5)
    assert np.bincount(leaves, minlength=32).max() <= 140


# ---------------------------------------------------------------- 3


def brute_groups(rows, least=0.6):
    shingles = {}
    for i, t in rows:
        w = similar.words_of(t)
        if i is not None and len(w) >= 20:
            shingles[i] = set(zip(w, w[1:], w[2:], strict=False))
    parent = {i: i for i in shingles}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(shingles), 2):
        n = len(shingles[a] & shingles[b])
        if n >= least * (len(shingles[a]) + len(shingles[b]) - n):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    sizes = Counter(map(find, shingles))
    return {i: find(i) for i in shingles if sizes[find(i)] > 1}


def texts(rng, n, words=60):
    """Families of texts with small edits."""
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if i % 4 == 0 or not out:
            base = [rng.choice(vocabulary) for _ in range(rng.randrange(15, words))]
        edited = list(base)
        for _ in range(rng.randrange(3)):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        out.append((i, " ".join(edited).capitalize()))
    return out


def grouped(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "chunk_index int, text string, id string, rep string")
    got = [(r.chunk_index, r.group) for r in similar.groups(df).collect()]
    assert len(got) == len(set(got)) == len(dict(got))
    return dict(got)


def test_groups_equal_brute_force(spark):
    rng = random.Random(6)
    rows = texts(rng, 300) + [(500, None), (501, ""), (502, "short text"), (None, "w1 " * 40), (503, "w1 " * 40), (504, "W1 " * 40), (505, "a b " * 20_000)]
    rows += [(600 + i, rows[8][1]) for i in range(5)] + rows[:20]
    want, got = brute_groups(dict(rows).items()), grouped(spark, rows)
    assert len(got.keys() ^ want.keys()) <= 2 and sum(got.get(i) != g for i, g in want.items()) <= 2


def test_hot_groups_of_copies_and_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(similar, "SMALL_BUCKET", 6)
    monkeypatch.setattr(similar, "HOT_SAMPLE", 2)
    monkeypatch.setattr(similar, "HOT_ROWS", 40)
    assert len(similar._hot_keys(spark.createDataFrame([(i, " ".join([*(f"h{j}" for j in range(60)), f"n{i}"])) for i in range(200)], "id long, text string"), 200)) > 5
    rng = random.Random(7)
    rows = texts(rng, 120)
    base = [f"h{i}" for i in range(60)]
    rows += [(1000 + i, " ".join([*base[:-1], f"n{i}"])) for i in range(120)]  # near copies
    rows += [(2000 + i, " ".join(f"c{j}" for j in range(40))) for i in range(120)]  # copies
    want, got = brute_groups(rows), grouped(spark, rows)
    assert {i: g for i, g in got.items() if i >= 1000} == {i: g for i, g in want.items() if i >= 1000}
    assert len(got.keys() ^ want.keys()) <= 2


def test_minmax_estimates_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (300, 100, 100))
    both = similar.minmax(np.concatenate([common, a, common, b]), np.array([400, 400]), 1000)
    assert abs((both[0] == both[1]).mean() - 0.6) < 0.06


def test_entries_are_packed_and_unpacked():
    rng = np.random.default_rng(5)
    for ids in (rng.integers(0, 1000, 500), rng.integers(-(2**62), 2**62, 500)):
        keys = rng.integers(-(2**63), 2**63 - 1, 500, dtype=np.int64)
        keys[::7] = keys[0]
        got = [similar.unpack_entries(p, x) for p, x in similar.pack_entries(keys, ids, 6)]
        assert sorted(np.concatenate([i for _, i in got]).tolist()) == sorted(ids.tolist())
        buckets = defaultdict(set)
        for own_keys, own_ids in got:
            for k, i in zip(own_keys.tolist(), own_ids.tolist(), strict=True):
                buckets[k].add(i)
        assert any(set(ids[::7].tolist()) <= members for members in buckets.values())


def test_a_group_in_blocks_gives_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "PAIR_BLOCK", 7)
    members = spark.createDataFrame([(i, 0 if i < 60 else i // 3) for i in range(90)], "chunk_index long, group long")
    got = [tuple(r) for r in similar.pairs_of(members, "chunk_index").collect()]
    want = {(a, b) for a, b in combinations(range(90), 2) if (0 if a < 60 else a // 3) == (0 if b < 60 else b // 3)}
    assert len(got) == len(set(got)) and set(got) == want


def test_links_between_members_that_miss_the_least_of_a_large_bucket(spark, monkeypatch):
    """A bucket far above the bound for all pairs, whose least member is like no other: planted pairs are found all the same."""
    monkeypatch.setattr(similar, "SMALL_BUCKET", 8)
    common, rows, want = " ".join(f"t{i}" for i in range(120)), [], {}
    for i in range(600):
        own = [f"o{i}x{k}" for k in range(60)]
        if i % 2 and i > 300:
            own[:22] = [f"o{i - 1}x{k}" for k in range(22)]
            want |= {i - 1: i - 1, i: i - 1}
        rows.append((i, common + " " + " ".join(own)))
    least = similar.alike(rows[0][1], rows[1][1])
    planted = similar.alike(rows[400][1], rows[401][1])
    assert least < 0.6 <= planted
    got = grouped(spark, rows)
    assert got.items() <= want.items() and len(got) >= 0.97 * len(want)


def test_bucket_pairs():
    a, b, large = similar.bucket_pairs(np.array([1, 2, 1, 1, 2, 3]), np.array([5, 8, 6, 7, 9, 4]), 10)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(5, 6), (5, 7), (6, 7), (8, 9)} and not large.any()
    a, b, large = similar.bucket_pairs(np.zeros(5, np.int64), np.arange(5), 3)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(0, i) for i in range(1, 5)} and large.all()


def test_pairs_among_texts_of_one_template(spark):
    template, rows, want = " ".join(f"t{i}" for i in range(100)), [], {}
    for i in range(1500):
        own = [f"o{i}x{k}" for k in range(36)]
        if i % 25 == 24:
            # like the text before, but like no other
            own[:6] = [f"o{i - 1}x{k}" for k in range(6)]
            want |= {i - 1: i - 1, i: i - 1}
        rows.append((i, template + " " + " ".join(own)))
    assert similar.alike(rows[23][1], rows[24][1]) >= 0.6 > 0.59 > similar.alike(rows[0][1], rows[24][1])
    got = grouped(spark, rows)
    assert got.items() <= want.items() and len(got) >= 0.95 * len(want)


def test_groups_of_nothing(spark):
    assert grouped(spark, [(1, None)]) == {}


# ---------------------------------------------------------------- 7

def test_long_runs_of_letters_take_no_square_of_time():
    import time

    ranks = lexicon.load_ranks(encoding.vocabulary_path())
    rng, token = random.Random(2), {v: k for k, v in ranks.items()}
    for word in (bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz", k=100_000)), b"a" * 100_000):
        start = time.process_time()
        ids = lexicon.merge(word, ranks)
        assert time.process_time() - start < 10 and b"".join(token[i] for i in ids) == word


TEXTS = ["", None, " ", "Hello, world! It's 2024.", "don't  stop\n\n\tnow ", "Größe ÉTÉ é日本語 😀👍🏽", "<|endoftext|> is text", "a" * 5000, " ​\x00", "مرحبا Привет"]


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encoding.vocabulary_path().replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids if text else []


def test_ids_equal_the_tokenizer(spark, tokenizer):
    documents = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1), (None, "x", 1)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encoding.encode(documents, encoding.vocabulary_path()).collect()}
    assert got == {i: tokenizer(t) for i, t in enumerate(TEXTS)} and got[0] == got[1] == []
    counts = {r.doc_id: r.n_tokens for r in encoding.token_counts(documents, encoding.vocabulary_path()).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encoding.encode(documents.limit(0), encoding.vocabulary_path()).count() == 0


def test_real_texts_round_trip(spark, tokenizer):
    d = "/root/testdata/sf0.001"
    ranks = lexicon.load_ranks(encoding.vocabulary_path())
    token = {v: k for k, v in ranks.items()}
    rows = encoding.QUERIES["p7_ids"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        assert b"".join(token[i] for i in r.ids) == (r.text or "").encode() and r.ids == tokenizer(r.text)


def test_lexicon(tmp_path):
    rng = random.Random(1)
    words = {"".join(rng.choices("abc", k=rng.randrange(1, 7))).encode(): [rng.randrange(100) for _ in range(rng.randrange(1, 4))] for _ in range(300)}
    automaton = lexicon.build(words)
    (tmp_path / "l").write_bytes(lexicon.dump(automaton))
    mapped = lexicon.Lexicon(str(tmp_path / "l"))
    assert len(mapped) == len(words) and all(mapped.ids(w) == ids for w, ids in words.items())
    assert [mapped.number(w) for w in sorted(words)] == list(range(len(words)))
    assert mapped.ids(b"zzz") is None and mapped.ids(b"") is None
    # suffixes are shared: fewer states than a trie has
    assert len(automaton["final"]) < len({w[:i] for w in words for i in range(len(w) + 1)})


# ---------------------------------------------------------------- 8


def test_best_fit_packs_tightly_and_splits_nothing():
    rng = random.Random(3)
    items = [(rng.randrange(0, 2049),) for _ in range(2000)]
    placed = packing.best_fit(items)
    load, size = Counter(), {}
    for (n,), (c, s) in zip(items, placed, strict=True):
        load[c] += n
        size[c] = s
    assert all(load[c] <= size[c] for c in size) and set(size.values()) <= set(packing.SIZES)
    assert all(size[c] == packing.SIZES[0] or load[c] > max(s for s in packing.SIZES if s < size[c]) for c in size)
    # items above half the largest size that find no partner bound what can be filled
    assert sum(load.values()) / sum(size.values()) > 0.97
    assert packing.best_fit([]) == [] and packing.best_fit([(0,), (0,)]) == [(0, 256), (0, 256)]


def test_sizes_are_chosen_by_what_would_fill_them():
    # nothing else fits beside an item of 1100 in 2048, but 1200 holds it
    assert set(packing.best_fit([(1100,)] * 5, (1200, 2048))) == {(i, 1200) for i in range(5)}
    # 900 fill the rest of 2048, so that one container is cheaper than two
    assert packing.best_fit([(1100,), (900,)], (1200, 2048)) == [(0, 2048), (0, 2048)]
    # items that leave a third of any container empty go where they leave least
    many = packing.best_fit([(n,) for n in range(600, 1100)])
    assert Counter(dict(many).values()).keys() == {1024, 2048}
    assert sum(range(600, 1100)) / sum(dict(many).values()) > 0.85
    sizes = packing.best_fit([(n,) for n in [1020] * 7 + [3] * 4], (1024, 2048), 0)
    assert sum(dict(sizes).values()) == 7 * 1024


def test_pack(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice([0, 1, 2048, 2049, 5000, rng.randrange(2000)]) for i in range(500)}
    df = spark.createDataFrame([(i, n, 1) for i, n in sizes.items()] + [(900, None, 1), (None, 5, 1)], "doc_id long, n_tokens long, capacity int")
    rows = packing.pack(df, pieces_at_once=200).collect()
    covered, load = defaultdict(list), Counter()
    for r in rows:
        covered[r.doc_id].append((r.start, r.length))
        load[r.bucket, r.container, r.capacity] += r.length
    assert covered.keys() == sizes.keys() and all(n <= cap for (_, _, cap), n in load.items()) and len({b for b, _, _ in load}) > 1
    for i, n in sizes.items():
        parts = sorted(covered[i])
        assert sum(x for _, x in parts) == n and len(parts) == max(1, -(-n // 2048)) and all(s == 2048 * k for k, (s, _) in enumerate(parts))
    assert packing.pack(df.limit(0)).count() == 0


def test_found_queries_have_their_columns(spark):
    d = "/root/testdata/sf0.001"
    assert dict(neighbours.found(spark, d).dtypes) == {"chunk_index_a": "bigint", "chunk_index_b": "bigint"}
    assert dict(similar.found(spark, d).dtypes) == {"chunk_index_a": "bigint", "chunk_index_b": "bigint"}
    assert dict(packing.found(spark, d).dtypes) == {"doc_id": "bigint"}
    assert dict(encoding.QUERIES["p7_ids"](spark, d).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
