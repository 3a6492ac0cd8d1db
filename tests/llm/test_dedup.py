import random
import re
from collections import defaultdict

import numpy as np

from millrace.llm import embedding_dedup, order_minhash, set_join


def word_shingles(text):
    """Tuples of words themselves, without a hash."""
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, num=75, den=100):
    sets = [word_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return [(rows[i][0], len(sets[i]), min(low[find(i)])) for i in range(len(rows))]


def texts(seed: int, n: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 300)) for _ in range(rng.choice([3, 6, 20, 60, 200]))] for _ in range(n // 8)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 50))
        out.append((1000 - i, " ".join(w) if rng.random() < 0.5 else " ".join(w).upper()))
    return out


def test_join_equals_brute_force(spark):
    for seed in (1, 2):
        rows = texts(seed, 240)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(tuple(r) for r in set_join.jaccard_components(df).collect())
        assert got == sorted(brute(rows))


def test_large_components_are_compared_in_blocks(spark, monkeypatch):
    rows = texts(5, 200)
    monkeypatch.setattr(set_join, "BLOCK_TOKENS", 300)
    got = sorted(tuple(r) for r in set_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute(rows))


def test_small_limits_chain_pair_and_split(spark, monkeypatch):
    """The same links when nearly every list is long, runs are sent, texts are hashed in pieces and lists are dealt to many tasks."""
    rows = texts(6, 160)
    family = ("w%d " * 40).strip()
    for i in range(60):  # a family of near copies, and a passage that unlike texts share
        words = (family % tuple(range(40))).split()
        words[i % 37] = "x"
        rows.append((2000 + i, " ".join(words)))
        rows.append((3000 + i, " ".join([*(f"own{i}_{k}" for k in range(30)), *(f"common{k}" for k in range(25))])))
    rows += [(4000, "Ünï " * 9000 + "end"), (4001, "ünï " * 9000 + "end"), (4002, "a\tb\x0bc\x0cd\re\nf\x1cg"), (4003, "A b c d e f\x1cg"), (4004, "a\u00a0b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name, value in (("LONG", 3), ("RUN", 2), ("BATCH_TOKENS", 500), ("LIST_ENTRIES", 300), ("PIECE", 64), ("BLOCK_TOKENS", 400), ("FREQUENT", 100)):
        monkeypatch.setattr(set_join, name, value)
    assert sorted(tuple(r) for r in set_join.jaccard_components(df).collect()) == sorted(brute(rows))


def test_skipping_by_position_loses_no_link():
    rng = np.random.default_rng(3)
    for _ in range(30):
        base = rng.permutation(200)[: rng.integers(5, 80)]
        sets = [np.unique(np.r_[base[rng.random(len(base)) > 0.12], rng.integers(300, 400, rng.integers(0, 6))]).astype(np.uint64) for _ in range(12)]
        n = np.array([len(s) for s in sets])
        entries = [(int(t), i, k) for i, s in enumerate(sets) for k, t in enumerate(s[: set_join.prefix(len(s), 75, 100)])]
        t, s, p = (np.array(c) for c in zip(*entries))
        a, b, c = set_join.list_pairs(t, s, p, n, 75, 100)
        got = dict(zip(zip(a.tolist(), b.tolist()), c.tolist()))
        k = set_join.prefix(n, 75, 100)
        for i in range(12):
            for j in range(i + 1, 12):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (n[i] + n[j] - both):
                    shared = len(np.intersect1d(sets[i][: k[i]], sets[j][: k[j]]))
                    assert got[i, j] == shared >= -(-75 * (n[i] + n[j]) // 175) - max(n[i] - k[i], n[j] - k[j])


def test_join_odd_rows(spark, odd_docs, no_docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in set_join.jaccard_components(odd_docs).collect()}
    assert got[5] == (0, 5) and got[6] == (0, 6) and got[8][1] == 7 and got[9][1] == 7 and got[11] == (1, 11) and got[13][0] == 1
    assert set_join.jaccard_components(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "q")], "doc_id long, text string")
    assert sorted((tuple(r) for r in set_join.jaccard_components(twice).collect()), key=str) == [(1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 1, None)]


def test_block_derivation_matches_direct_counts():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 5000, 400)).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, int(len(base) * rng.uniform(0.7, 1)), replace=False), rng.integers(0, 5000, 20).astype(np.uint64)]) for _ in range(60)]
    sizes = np.array([len(s) for s in sets])
    got = set_join.link_block(sizes, sets, 75, 100)
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 75 * (sizes[i] + sizes[j] - n):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert got.tolist() == root


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    rows = []
    for i in range(400):
        v = base[rng.integers(30)] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2, 0.4])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, rows[0][1], None), (404, [1.0, None] + [0.0] * 14, 1), (405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1), (407, [], 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as copies", "2 as leaf")
    for block in (2000, 40):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, leaf=40, block=block).collect()}
        good = [(i, np.float32(e).astype(float), k) for i, e, k in rows if i is not None and i < 400] + [(405, np.array([1.0, 2.0]), 1), (406, np.array([2.0, 4.0]), 1)]
        links, root = defaultdict(int), {i: i for i in got}
        for x, (i, a, k) in enumerate(good):
            for j, b, m in good[:x]:
                if k == m and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    p, q = root[i], root[j]
                    root = {n: min(p, q) if r in (p, q) else r for n, r in root.items()}
        found = sum(n for n, _, _ in got.values())
        assert found >= 0.97 * sum(links.values())
        assert all(got[i][0] <= links[i] for i in got)
        assert all(got[i] == (0, i, True) for i in (400, 401, 402, 403, 404, 407))
        assert got[406][1] == 405
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_order_minhash_follows_edits():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    one = order_minhash.sketch(text)
    near = order_minhash.sketch(text[:2000] + "#" + text[2000:])
    moved = order_minhash.sketch(text[2000:] + text[:2000])
    assert order_minhash.likeness(one, order_minhash.sketch(text)) == 1.0
    assert order_minhash.likeness(one, near) > 0.85
    assert order_minhash.likeness(one, moved) < order_minhash.likeness(one, near) - 0.2  # order counts
    assert order_minhash.likeness(one, order_minhash.sketch("z" * 50)) == 0
    assert order_minhash.from_text(order_minhash.as_text(one)).tolist() == one.tolist()


def plain_sketch(text, k, ell, slots):
    """The definition: number occurrences, deal to slots, take the smallest, restore order, hash."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    h = order_minhash.kmer_hashes(points, k) >> np.uint64(order_minhash.POSITION_BITS)
    seen, pairs = defaultdict(int), []
    with np.errstate(over="ignore"):
        for pos, v in enumerate(h):
            n = seen[int(v)]
            seen[int(v)] += 1
            rank = v if not n else (order_minhash.mix(np.array([v ^ order_minhash.mix(np.array([n], np.uint64) * order_minhash._M1)[0]]))[0] >> np.uint64(order_minhash.POSITION_BITS))
            pairs.append((int(rank), pos, v))
        out = []
        for j in range(slots):
            chosen = []
            for step in range(slots):
                if len(chosen) >= ell:
                    break
                chosen += sorted(p for p in pairs if p[0] % slots == (j + step) % slots)[: ell - len(chosen)]
            value = np.array([j + 1], np.uint64)
            for _, _, v in sorted(chosen, key=lambda p: p[1]):
                value = order_minhash.mix(value * order_minhash._M1 + v)
            out.append(max(1, int(value[0] >> np.uint64(32))))
    return out


def test_order_minhash_equals_its_definition():
    rng = random.Random(2)
    for n in (1, 3, 8, 9, 40, 300, 5000):
        text = "".join(rng.choice("ab c") for _ in range(n))
        assert order_minhash.sketch(text).tolist() == plain_sketch(text, order_minhash.K, order_minhash.ELL, order_minhash.SLOTS)


def test_next_document(spark, odd_docs, no_docs):
    import hashlib

    rows = sorted([(r["doc_id"], r["text"] or "") for r in odd_docs.collect()], reverse=True)
    for per in (4000, 2):
        got = {r["doc_id"]: r for r in order_minhash.compare_with_next(odd_docs, per).collect()}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(rows):
            nxt = rows[(k + 1) % len(rows)][1]
            e = order_minhash.edited(t, nxt)
            assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
            assert got[i]["n_chars"] == len(t)
            assert got[i]["near_next"] == order_minhash.likeness(order_minhash.sketch(t), order_minhash.sketch(nxt))
    assert order_minhash.compare_with_next(no_docs).count() == 0
    assert order_minhash.fingerprints(odd_docs).count() == len(rows)
