import hashlib
import random
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import pytest

from atlasmill.llm import token_alignment as M
from atlasmill.llm.registry import tokenizer_path

from llm_rows import TEXTS

FILES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """The alignment of a text, by the libraries' encodings of the whole text and byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    of = M._byte_of_char()

    def align(text):
        if not text:
            return None
        x, ids_b = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        bytes_a = [bytes(of[c] for c in t) for t in x.tokens]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return None

        def ends(parts):
            out, at = [], 0
            for p in parts:
                out.append(at := at + len(p))
            return out

        ea, eb = ends(bytes_a), ends(bytes_b)
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        links = [(x.ids[i], ids_b[j]) for i in range(len(ea)) for j in range(bisect_right(eb, sa[i]), bisect_left(sb, ea[i]))]
        cuts = sorted({*ea} & {*eb})
        ga, gb = defaultdict(list), defaultdict(list)
        for g, e, ids in ((ga, ea, x.ids), (gb, eb, ids_b)):
            for k, end in enumerate(e):
                g[bisect_left(cuts, end)].append(str(ids[k]))
        groups = ";".join(",".join(ga[k]) + "|" + ",".join(gb[k]) for k in range(len(cuts)))
        return len(ea), len(eb), len(cuts), links, groups

    return align


ALPHABET = ["a", "the", " ", "  ", "\n", "é", "😀", "日本", "<s>", "<|endoftext|>", "'s", "1", "12345", "\t", "...", " \n x", "\x00", " ", "　", "\x1c", "don't", "ing", " word"]


def test_random_texts_equal_the_libraries(plain, monkeypatch):
    monkeypatch.setattr(M, "LANE", 3)
    rng = random.Random(4)
    texts = ["".join(rng.choices(ALPHABET + ["▁"] * (k % 9 == 0), k=rng.randint(0, 60))) for k in range(400)]
    one, small = M.Aligner(M.read_tokenizers(*FILES)), M.Aligner(M.read_tokenizers(*FILES), memory=20)
    monkeypatch.setattr(M, "PIECE", 40)  # long texts in pieces
    monkeypatch.setattr(M, "BATCH", 300)
    for aligner in (one, small):
        n_plain = 0
        for text, *got in zip(texts, *aligner.run(texts, True), strict=True):
            want = plain(text)
            n_plain += want is not None
            if want is None:
                assert got == [0, 0, 0, 0, "", b"", b"", ""]
                continue
            n_a, n_b, n_groups, links, groups = want
            assert got[:4] == [n_a, n_b, n_groups, len(links)] and got[7] == groups
            assert got[4] == hashlib.sha256(groups.encode()).hexdigest()
            pairs = Counter(a * aligner.size_b + b for a, b in links)
            assert dict(zip(M.unpacked(got[5]).tolist(), M.unpacked(got[6]).tolist(), strict=True)) == pairs
        assert n_plain > 200


@pytest.mark.parametrize("known", [1 << 20, 200, 0])
def test_counts_over_all_documents(spark, odd, plain, known):
    docs = odd.select("doc_id", "text", "id", "n_bytes").unionByName(spark.createDataFrame([(20 + k, t, "", "") for k, t in enumerate(("a the a", "the a, the b", None, "x▁y", "the  a"))], "doc_id long, text string, id string, n_bytes string"))
    rows = docs.select("doc_id", "text").collect()
    made = [plain(r.text) for r in rows]
    counts = Counter(p for m in made if m for p in set(m[3]))
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    want = []
    for r, m in zip(rows, made, strict=True):
        if m is None:
            want.append((r.doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, groups = m
            want.append((r.doc_id, n_a, n_b, n_groups, len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest()))
    got = M.align_tokenizers(docs, *FILES, known=known)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(d == 2 for d, *_ in TEXTS) == 2 and sum(w[0] == 2 for w in want) == 2


def test_no_documents(none):
    assert M.align_tokenizers(none, *FILES).collect() == []


def test_packing_round_trip():
    import numpy as np

    for x in ([], [0], [5, 5, 9, 1 << 50], [3, 1, 2]):
        assert M.unpacked(M.packed(np.array(x, np.int64))).tolist() == x
