"""Near-dedup by long fingerprints against plain Python."""

import random

import numpy as np
import pytest
import xxhash

from atlasmill.llm import near_texts as N


def brute_bits(items):
    """A fingerprint as an integer, bit by bit."""
    mask = (1 << 64) - 1
    counts = [0] * (64 * N.LONGS)
    for item in items:
        h = xxhash.xxh64_intdigest(item, N.SEED)
        for k in range(N.LONGS):
            x = h + (k + 1) * 0x9E3779B97F4A7C15 & mask
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            x ^= x >> 31
            for b in range(64):
                counts[64 * k + b] += x >> b & 1
    return sum(1 << b for b, n in enumerate(counts) if 2 * n > len(items))


def sets_of(text):
    words = (text or "").encode().translate(N._LOWER).split()
    return set(words), {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    """The smallest id of each id's component, over all pairs that share a block and are within the distance."""
    most = N.most_bits(N.SIMILARITY - N.MARGIN)
    prints = {i: tuple(int.from_bytes(p, "little") for p in N.fingerprints(t or "")) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            (wi, si), (wj, sj) = prints[i], prints[j]
            differ = wi ^ wj
            if (si ^ sj).bit_count() <= most and any(not differ >> 32 * k & 0xFFFFFFFF for k in range(2 * N.LONGS)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def near_copies(rng, words, base, n, edits):
    """n texts that differ from the base in so many words each."""
    out = []
    for _ in range(n):
        copy = list(base)
        for k in rng.sample(range(len(copy)), edits):
            copy[k] = rng.choice(words)
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    words = [f"wo{k}rd" for k in range(2000)]
    out = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        out += [" ".join(base), *near_copies(rng, words, base, 2, 2)]
    out += ["", None, "one", "One", "one two", " ".join(rng.choice(words) for _ in range(5000))]
    return dict(enumerate(out))


@pytest.mark.parametrize("text", ["", "One", "a b c d", "The quick brown fox jumps over the lazy dog, the quick brown fox jumps", "x " * 600 + " ".join(map(str, range(700)))])
def test_fingerprints(text):
    words, shingles = sets_of(text)
    assert tuple(int.from_bytes(p, "little") for p in N.fingerprints(text)) == (brute_bits(words), brute_bits(shingles))


def test_groups_match_brute_force(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.id: r.first.id for r in N.near_text_groups(docs).collect()}
    assert got == brute_groups(texts)
    # against similarity itself
    sets = {i: sets_of(t)[1] for i, t in texts.items() if i < 75}
    pairs = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 20 and sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)
    assert all(len(sets[i] & sets[j]) > 0.5 * len(sets[i] | sets[j]) for i in sets for j in sets if i < j and got[i] == got[j])


def test_a_large_group_takes_few_rows(spark, monkeypatch):
    """Three hundred copies of one text and as many of another, which share blocks: leaders link them."""
    rng = random.Random(4)
    words = [f"wo{k}rd" for k in range(2000)]
    bases = [[rng.choice(words) for _ in range(200)] for _ in range(2)]
    rows = [t for b in bases for t in near_copies(rng, words, b, 300, 1)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.id: r.first.id for r in N.near_text_groups(docs).collect()}
    assert set(got.values()) == {0, 300} and all(got[i] == i // 300 * 300 for i in got)
    assert sorted(r.doc_id for r in N.drop_near_texts(docs).collect()) == [0, 300]


def test_a_crowded_block_of_many_groups_loses_no_link(spark, monkeypatch):
    """More groups in one block than there are leaders, links between followers of different leaders, and tasks of few texts."""
    monkeypatch.setattr(N, "PART", 3)
    rng = random.Random(6)
    most = N.most_bits(N.SIMILARITY - N.MARGIN)

    def flipped(bits, n):
        for k in rng.sample(range(1024), n):
            bits ^= 1 << k
        return bits

    prints = []
    for _ in range(15):
        prints += [base := rng.getrandbits(1024), near := flipped(base, 150), flipped(near, 150), flipped(base, 100)]
    signed = lambda bits: [int.from_bytes((bits >> 64 * k & (1 << 64) - 1).to_bytes(8, "little"), "little", signed=True) for k in range(N.LONGS)]
    # the first 32 bits of the words' fingerprint are the same for all, the others are each text's own
    rows = [(i, [i + 1 << 8, *[(i + 1) * 1000 + k + ((i + 1) * 1000 + k << 32) for k in range(1, N.LONGS)]], signed(p)) for i, p in enumerate(prints)]
    root = {i: i for i in range(len(prints))}
    for _ in root:
        for i, p in enumerate(prints):
            root[i] = min(root[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= most)
    assert len(set(root.values())) == 15
    scratch = N.Scratch()
    found = N._edges(spark.createDataFrame(rows, "node long, words array<long>, shingles array<long>"), most, scratch).collect()
    assert root == {**{i: i for i in root}, **{r.node: r.root for r in found}}


def join_rows(df):
    """The most rows that a join of a collected DataFrame's plan made."""

    def walk(plan):
        inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else []
        children = plan.children()
        below = max([walk(p) for p in [*inner, *(children.apply(i) for i in range(children.size()))]], default=0)
        return max(below, plan.metrics().apply("numOutputRows").value()) if "Join" in plan.nodeName() else below

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("part", [2048, 40])
def test_a_crowded_block_of_single_texts_makes_no_row_a_pair(spark, monkeypatch, part):
    """A hundred and twenty texts of one block, none linked yet, two of which should be: rows grow with texts and tiles."""
    monkeypatch.setattr(N, "PART", part)
    rng = random.Random(8)
    bits = [[rng.getrandbits(63) for _ in range(N.LONGS)] for _ in range(119)]
    bits.append([bits[60][0] ^ 0b111, *bits[60][1:]])
    n, most = len(bits), N.most_bits(N.SIMILARITY - N.MARGIN)
    crowd = spark.createDataFrame([(0, 7, i) for i in range(n)], "k int, key long, node long")
    prints = spark.createDataFrame(list(enumerate(bits)), "node long, shingles array<long>")
    leaders = spark.createDataFrame([(0, 7, i, bits[i]) for i in range(2)], "k int, key long, b long, sb array<long>")
    roots = spark.createDataFrame([], "node long, root long")
    found = N._rest(crowd, leaders, roots, prints, most, N.Scratch())
    assert [{r.a, r.b} for r in found.collect()] == [{60, 119}]
    assert join_rows(found) <= n * (-(-n // part) + 8) < n * (n - 1) // 2


def test_links_between_tiles():
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 1 << 63, (40, N.LONGS)).astype(np.uint64)
    bits[20:] = bits[:20] ^ np.uint64(3)  # 32 bits apart
    root = np.arange(40) % 7
    brute = {(int(root[i]), int(root[j])) for i in range(40) for j in range(40) if root[i] != root[j] and np.bitwise_count(bits[i] ^ bits[j]).sum() <= 40}
    assert N.links_between(40, True, root, bits, root, bits) == {p for p in brute if p[0] < p[1]}
    assert N.links_between(40, False, root[:20], bits[:20], root[20:], bits[20:]) == {(int(root[i]), int(root[i + 20])) for i in range(20)}
    assert N.links_between(31, True, root, bits, root, bits) == set()


def test_odd_rows(odd, none):
    out = N.drop_near_texts(odd)
    assert out.columns == odd.columns
    kept = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert 1 in kept and 2 not in kept and 10 not in kept and kept.count(3) == 1 and 4 not in kept and kept.count(9) == 2
    assert N.drop_near_texts(none).collect() == []


def test_distance_of_a_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 100).astype(np.uint64)])  # 800 of 1000: 0.8
    x, y = (int.from_bytes(N.majority_bits(v), "little") for v in (a, b))
    assert abs((x ^ y).bit_count() - N.most_bits(0.8)) < 40
