"""The pipeline against a plain version of its stages on a small table."""

import hashlib
import random

import public_tokenizers
import sentencepiece
from llm_rows import TEXTS
from pyspark.sql import functions as F
from test_near_texts import brute_groups
from test_rows import targets

import corpus_pipeline


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "source mixing", "sentencepiece"]


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(8)
    words = [f"wo{k}rd" for k in range(400)]
    docs, labels = [], []
    for i in range(240):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(40, 80)))
        if i % 6 == 0:
            text = text.replace(" ", "### ")
        if i % 10 == 3 and i > 10:
            text = docs[i - 10][1]
        if i % 10 == 7 and i > 10:
            text = docs[i - 10][1] + " end"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int("###" not in text), 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = {i: t for i, t, *_ in docs if "###" not in t}
    last = {}
    for i, t in good.items():
        last[t] = max(i, last.get(t, i))
    unique = {i: t for t, i in last.items()}
    roots = brute_groups(unique)
    kept = {i: t for i, t in unique.items() if roots[i] == i}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = {i: hashlib.sha256(" ".join(map(str, library.encode(t, add_eos=True))).encode()).hexdigest() for i, t in kept.items()}
    assert {r.doc_id for r in got} <= set(kept)
    assert all(r.ids_sha256 == sha[r.doc_id] for r in got)
    # each source's words come near its target
    want = targets({s: sum(len(t.split()) for i, t in kept.items() if i % 3 == s) for s in range(3)})
    taken = {s: sum(len(kept[r.doc_id].split()) for r in got if r.doc_id % 3 == s) for s in range(3)}
    assert all(abs(taken[s] - want[s]) <= 81 for s in want)


def test_pipeline_of_odd_and_of_no_rows(spark, tmp_path, odd, none):
    """Null, empty, repeated and very long rows, clashing extra columns, and an empty table."""
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("none", none)):
        docs.withColumn("n_chars", F.lit(1).cast("long")).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in got} <= {i for i, *_ in TEXTS} and all(r.n_tokens > 0 for r in got)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
