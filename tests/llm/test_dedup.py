import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from atlasmill.llm import line_dedup
from atlasmill.llm.components import components
from atlasmill.llm.exact_dedup import KEY, digest_rows, drop_copies, exact_dedup, merge_round
from atlasmill.llm.line_dedup import Bitmap, Heavy, Lines, Sets, dedup_lines, hashed_words, settled
from atlasmill.llm.simhash import drop_near, fingerprint, links, near_groups

from llm_rows import TEXTS


def brute_print(text, width=3):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=2):
    """Smallest id by fingerprint, by flooding over all pairs."""
    nodes = sorted(set(prints.values()))
    seen = {}
    for n in nodes:
        if n in seen:
            continue
        group, stack = set(), [n]
        while stack:
            x = stack.pop()
            if x not in group:
                group.add(x)
                stack += [y for y in nodes if (x ^ y).bit_count() <= distance]
        least = min(i for i, p in prints.items() if p in group)
        seen |= dict.fromkeys(group, least)
    return {i: seen[p] for i, p in prints.items()}


def test_exact_dedup(odd):
    got = exact_dedup(odd).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        group = [i for i, t, *_ in TEXTS if hashlib.sha256((t or "").encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(group) and r.keep_id == max((i for i in group if i is not None), default=None)
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r.kept)
    assert all(sum(k) == 1 for k in by_text.values())
    assert {r.keep_id for r in exact_dedup(odd, keep="smallest").collect() if r.doc_id in (1, 2)} == {1}


def test_exact_dedup_of_nothing(none):
    assert exact_dedup(none).collect() == [] and drop_copies(none).collect() == []


def test_drop_copies_keeps_rows_and_columns_whole(odd):
    out = drop_copies(odd)
    assert out.columns == odd.columns
    got = sorted((r.doc_id is None, r.doc_id, r.text or "") for r in out.collect())
    assert len(got) == len({t or "" for _, t, *_ in TEXTS}) and (False, 2, TEXTS[0][1]) in got


@pytest.mark.parametrize("runs,fan_in", [(1, 8), (16, 2), (64, 8)])
def test_any_tree_gives_the_same(spark, runs, fan_in):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    got = exact_dedup(df, runs=runs, fan_in=fan_in).groupBy("keep_id", "group_size").count().collect()
    assert sorted((r.keep_id, r.group_size, r["count"]) for r in got) == sorted((max(range(k, 400, 7)), len(range(k, 400, 7)), len(range(k, 400, 7))) for k in range(7))


def test_simhash_matches_brute_force(spark, odd):
    got = near_groups(odd.filter("doc_id IS NOT NULL")).collect()
    texts = [(i, t) for i, t, *_ in TEXTS if i is not None]
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((i, f"{brute_print(t):016x}") for i, t in texts)
    assert fingerprint("One two") & (1 << 64) - 1 == brute_print("One two")


@pytest.mark.parametrize("distance", [2, 4])
def test_links_of_crowded_and_of_small_buckets(spark, distance):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(120):  # a crowd around one print, so that buckets exceed the pairwise limit
        prints.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    for _ in range(40):
        x = rng.getrandbits(64)
        prints |= {x, x ^ 3, x ^ 3 ^ (1 << 40), x ^ 7 ^ (1 << 50) ^ (1 << 51), x ^ 15 ^ (7 << 30), x ^ (31 << 20)}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in components(links(nodes, distance)).collect()}
    got = defaultdict(set)
    for s in signed:
        got[roots.get(s, s)].add(s & (1 << 64) - 1)
    ids = {p: p for p in prints}
    want = defaultdict(set)
    for p, least in brute_components(ids, distance).items():
        want[least].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain(spark):
    df = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).filter("a <> 120")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {k: 0 if k <= 120 else 121 for k in range(1, 201) if k != 121}
    assert components(df.filter("a < 0")).collect() == []


def test_drop_near(odd, none):
    out = drop_near(odd)
    assert out.columns == odd.columns
    kept = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert 1 in kept and 2 not in kept and 10 not in kept and kept.count(3) == 1 and 4 not in kept
    assert drop_near(none).collect() == [] and near_groups(none).collect() == []


def test_drop_near_by_other_shingles_and_distance(spark, odd):
    rng = random.Random(3)
    words = [f"wo{k}rd" for k in range(300)]
    texts = {}
    for i in range(0, 120, 4):
        base = [rng.choice(words) for _ in range(200)]
        texts[i] = " ".join(base)
        for k in range(1, 4):
            texts[i + k] = " ".join("changed" if n in range(7 * k, 7 * k + k) else w for n, w in enumerate(base))
    want = brute_components({i: brute_print(t, 2) for i, t in texts.items()}, 4)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_groups(docs, shingle=2, distance=4).collect()}
    assert got == want and len(set(want.values())) < len(set(brute_components({i: brute_print(t) for i, t in texts.items()}).values()))
    assert sorted(r.doc_id for r in drop_near(docs, shingle=2, distance=4).collect()) == sorted(set(want.values()))
    assert drop_near(odd, shingle=2, distance=4).columns == odd.columns
    for bad in (3, 0, 6):
        with pytest.raises(ValueError):
            links(docs, bad)


def brute_lines(rows, threshold=0.8, least=1):
    seen, out = [], {}
    for key, text in rows:
        gone = []
        for k, line in enumerate(text.split("\n")):
            words = frozenset(line.encode().split())
            if len(words) < max(1, least):
                continue
            if any(len(words & s) / len(words | s) >= threshold - 1e-12 for s in seen):
                gone.append(k)
            seen.append(words)
        out[key] = gone
    return out


@pytest.mark.parametrize("hot,bucket,least", [(1 << 17, 500_000, 1), (20, 300, 5)])
def test_line_dedup_matches_brute_force(spark, monkeypatch, hot, bucket, least):
    """With small and large buckets, and with many words treated as hot."""
    monkeypatch.setattr(line_dedup, "HOT_WORD", hot)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 0)
    monkeypatch.setattr(line_dedup, "BUCKET_ROWS", bucket)
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(60)] + [f"rare{k}" for k in range(900)]
    stock = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 40))] for _ in range(60)]
    family = [f"f{k}" for k in range(30)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = list(family if rng.random() < 0.3 else rng.choice(stock))
            for _ in range(rng.choice((0, 0, 1, 2, 3, 5))):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_lines(rows, least=least)
    got = {r.doc_id: r for r in dedup_lines(df, least=least).collect()}
    for i, text in rows:
        assert got[i].removed == ",".join(map(str, want[i]))
        assert got[i].text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[i])
    assert sum(map(len, want.values())) > 100


def test_line_dedup_of_short_lines(spark, tmp_path):
    """The query leaves no line with words out: equal short sets, and four words within five."""
    from atlasmill.llm.registry import op2_line_dedup

    rng = random.Random(9)
    stock = [[f"s{rng.randrange(12)}" for _ in range(rng.randint(1, 6))] for _ in range(40)]
    rows = [(0, "Read more\na b c d\n\n \t"), (1, "more Read\na b c d e\nRead\n"), (2, "Read more Read\na b c\na b c x"), (3, None), (4, "q w e r t"), (5, "q w e r")]
    rows += [(i, "\n".join(" ".join(rng.sample(x, len(x))) for x in rng.choices(stock, k=5))) for i in range(6, 60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_lines([(i, t or "") for i, t in rows], least=1)
    assert want[1] == [0, 1] and want[2] == [0] and want[5] == [0] and want[0] == []
    got = {r.doc_id: r.removed for r in op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: ",".join(map(str, x)) for i, x in want.items()}


def test_line_dedup_of_odd_rows(odd, none):
    got = dedup_lines(odd).collect()
    assert len(got) == len(TEXTS)
    removed = {(r.doc_id, r.n_removed) for r in got}
    assert {(1, 0), (2, 1), (3, 0), (4, 0), (10, 0)} <= removed  # 10 differs in two words of thirteen
    assert dedup_lines(none).collect() == []


def test_words_and_sets_of_lines():
    texts = ["a b  a", "", "\u00a0 b\tc\x0bd", " ", "z\u2028z a"]
    line, token = hashed_words(pa.array(texts))
    assert line.tolist() == [0, 0, 0, 2, 2, 2, 2, 4, 4]
    assert token[0] == token[2] == token[8] and token[1] == token[4] and len(set(token.tolist())) == 6
    assert hashed_words(pa.array(["", " \n"]))[0].tolist() == [] and hashed_words(pa.array([], pa.string()))[0].tolist() == []
    sets = Sets(Lines(np.array([7, 8]), pa.array(["x y x\n\nz", "y x"])), None, 1)
    assert sets.n.tolist() == [2, 1, 2] and sets.ids.tolist() == [7, 7, 8] and sets.numbers.tolist() == [0, 2, 0]
    d0, d1 = sets.digests()
    assert d0[0] == d0[2] != d0[1] and d1[0] == d1[2] != d1[1]


def test_copies_of_the_heaviest_sets_are_known():
    sets = Sets(Lines(np.array([1, 2, 3]), pa.array(["a b\nc d", "b a\ne f", "f e"])), None, 1)
    d0, d1 = (d.view(np.int64) for d in sets.digests())
    heavy = Heavy([Row(d0=int(d0[0]), d1=int(d1[0]), id=1, line=0), Row(d0=int(d0[3]), d1=int(d1[3]), id=2, line=1)])
    assert heavy.copies(sets).tolist() == [False, False, True, False, True]
    assert not Heavy([]).copies(sets).any()


def test_lines_left_over_are_verified_on_whole_sets(spark):
    words = {1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 4, 6], 3: [1, 2, 3, 4, 5, 6], 4: [9]}
    rows = [(t, i, 0, i != 1, w) for t in (5, 6) for i, w in words.items()]
    df = spark.createDataFrame(rows, "token long, id long, line long, waiting boolean, tokens array<long>")
    assert [r.id for r in settled(df, 0.8).collect()] == [3]


def test_a_line_in_every_document(spark):
    rows = [(i, f"all rights reserved by the {'same' if i % 2 else 'very same'} people of old\nown {i} a{i} b{i}") for i in range(400)]
    got = {r.doc_id: r.removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {i: "0" if i else "" for i in range(400)}


def test_bitmap_never_misses(spark):
    keys = spark.range(500).select((F.col("id") * 31 - 400).alias("a"), F.col("id").alias("b"))
    b = Bitmap.of(keys, 500)
    ids = np.arange(500)
    assert b.has(ids * 31 - 400, ids).all() and b.has(ids * 31 - 399, ids).mean() < 0.2


def test_long_words_that_look_alike_are_told_apart(spark):
    """Words whose polynomial hashes modulo 2^64 agree, and lines of very long words, against brute force."""
    swap = str.maketrans("ab", "ba")
    word = "a"
    while len(word) < 2048:
        word += word.translate(swap)
    rng = random.Random(11)
    longs = ["".join(rng.choice("xyz") for _ in range(2048)) for _ in range(6)]
    rows = [(1, word), (2, word.translate(swap)), (3, f"{word} tail"), (4, f"{word.translate(swap)} tail"), (5, word), (6, " ".join(longs[:5])), (7, " ".join(longs[:4])), (8, " ".join(longs[1:])), (9, " ".join(longs))]
    rows += [(10, longs[0][:-1] + "q"), (11, longs[0][:300]), (12, longs[0])]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least=1).collect()}
    gone = brute_lines(rows)
    assert {d for d, text in rows if got[d] != text} == {d for d, lines in gone.items() if lines}
    assert got[2] == rows[1][1] and got[5] == ""


def test_runs_move_and_merge_in_each_round(spark):
    """Rows of every round against plain sets; each round's exchange and merge is in the plan."""
    rng = random.Random(2)
    texts = [(k, f"text {rng.randrange(120)}") for k in range(2000)] + [(5000 + k, "hot") for k in range(1000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = digest_rows(docs, "doc_id", "text", 16)
    level = rows.groupBy(*KEY, "run").agg(F.max(F.struct("id")).alias("best"), F.sum("copies").alias("copies"))
    plain = defaultdict(list)
    run_of = {r.id: r.run for r in rows.collect()}
    for k, t in texts:
        plain[t, run_of[k]].append(k)
    for n in range(1, 5):
        level = merge_round(level, n, 1)
        merged = defaultdict(list)
        for (t, run), ids in plain.items():
            merged[t, run >> 1] += ids
        plain = merged
        got = sorted((r.run, r.best.id, r.copies) for r in level.collect())
        assert got == sorted((run, max(ids), len(ids)) for (_, run), ids in plain.items())
        exchanges = level._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression")
        assert exchanges == n
    assert len(plain) == 121
