import random

from quarry.llm import neardup
from quarry.llm.graph import components
from quarry.llm.neardup import deduplicate, near_duplicates
from quarry.llm.words import shingle_set, words_of


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").translate({i: i + 32 for i in range(65, 91)}).split()
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(rows))]


def copies(seed, groups, most):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice((4, 8, 30, 90)))]
        for _ in range(rng.randint(1, most)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append(" ".join(t))
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


def test_matches_brute_force(spark):
    rows = copies(3, 40, 12) + [(1, "a b"), (2, "A  b"), (3, "a c"), (4, ""), (5, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_group_of_edited_copies(spark, monkeypatch):
    """One group holds most rows, its copies differ by zero to many edits, and blocks are small."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(260):
        t = list(base)
        for k in range(rng.randint(0, 14)):
            t[rng.randrange(120)] = f"n{d}x{k}"
        rows.append((d, " ".join(t)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85))


def test_odd_rows(spark, odd_docs):
    got = {(r.doc_id, r.component_id, r.n_shingles) for r in near_duplicates(odd_docs).collect()}
    assert {(1, 1, 0), (2, 2, 0), (3, 3, 1), (4, 3, 1), (5, 5, 0), (None, None, 0)} <= got
    assert near_duplicates(odd_docs.limit(0)).count() == 0
    kept = deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("_key = 'k' AND n = 1 AND _row = 3").count() == kept.count()
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert ids == [-1, -1, 1, 2, 3, 5, 6, 7, 8]


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001)], "a long, b long")
    got = dict(components(edges).collect())
    assert {got[i] for i in range(301)} == {0} and got[1001] == 1000


def test_pigeonhole_keys_cover_the_distance():
    masks = neardup.chunk_masks(8, 2, 3)  # one error allowed in each of two chunks
    assert len(masks) == 8 and all(len(m) == 3 for m in masks)
    rng = random.Random(1)
    for _ in range(200):
        wrong = set(rng.sample(range(8), 3))
        assert any(not wrong & set(m.tolist()) for m in masks)


def test_words_follow_the_contract():
    w = words_of(["A\x0bb\x1cc É", None, "x"], lower=True)
    assert len(w.of(0)) == 3 and len(w.of(1)) == 0  # \x1c is no separator
    assert w.of(0)[0] == words_of(["a"]).of(0)[0] and len(shingle_set(w.of(0)[:2], 3)) == 1


def test_cells_join_what_all_pairs_join_with_few_rows(spark, monkeypatch):
    """Every link between components of a key counts, and what comes out grows with members, not with pairs."""
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2 ** 60, 100)
    rows, sets = [], {}
    for node in range(120):
        kept = rng.permutation(base)[:rng.integers(86, 100)]
        sets[node] = np.unique(np.concatenate([kept, rng.integers(0, 2 ** 60, rng.integers(0, 12))])).astype(np.uint64)
        for h in {node % 3, 3 + node % 5}:
            rows.append((h, node, int(0 if node % 4 == 0 else node), len(sets[node])))
    members = spark.createDataFrame(rows, "h long, node long, component long, n long").repartition(3)
    items = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in sets.items()], "node long, items binary")
    part = {node: c for _, node, c, _ in rows}

    def joined(links):
        up = {c: c for c in part.values()}

        def of(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in links:
            up[of(part[a])] = of(part[b])
        return {frozenset(c for c in up if of(c) == r) for r in map(of, up)}
    want = [(a, b) for h, a, ca, na in rows for g, b, cb, nb in rows
            if h == g and ca != cb and a < b and 100 * (both := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (na + nb - both)]
    for block, columns in ((512, 8192), (8, 16)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "COLUMNS", columns)
        got = [tuple(r) for r in neardup._blocks(members, items, 85).collect()]
        true = set(want) | {(b, a) for a, b in want}
        assert want and set(got) <= true and joined(got) == joined(want) and len(got) <= len(rows) < len(want)


def test_distance_follows_the_similarity(spark):
    """Pairs at 0.80 whose signatures differ in more symbols than 0.85 allows are still one document."""
    for percent, distance in ((85, 21), (80, 25)):
        assert neardup.max_distance(percent) == distance and neardup.missed(percent, distance) < 2e-4 < neardup.missed(percent, distance - 2)
    rng = random.Random(11)
    rows = []
    while len(rows) < 6:
        a = [f"v{rng.randrange(10**6)}" for _ in range(200)]
        b = a[:179] + [f"v{rng.randrange(10**6)}" for _ in range(21)]
        x, y = (neardup.signature(shingle_set(words_of([" ".join(t)], lower=True).of(0), 5)) for t in (a, b))
        if 21 < (x != y).sum() <= 25:
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), width=5, percent=80)
    assert sorted(r.doc_id for r in got.collect()) == [0, 2, 4]
