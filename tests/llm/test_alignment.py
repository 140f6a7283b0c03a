"""Cross-tokenizer alignment against the two libraries on whole texts."""
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from pairlens.llm import alignment
from pairlens.llm.common import table
from pairlens.llm.queries import op13_alignment

SMALL = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = [chr(c) for c in [*range(1, 127), *range(160, 400), 0x2581, 0x3000, 0x2028, 0x85, 0x1C, 0x200B, 0x4E2D, 0x1F600, 0x301]]


def by_hand(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of every text, straight from the contract."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(A)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=B)
    signs = {s: b for s, b in alignment._byte_signs().items()}
    told = []
    for text in texts:
        links, groups = [], []
        if text:
            a = a_side.encode(" " + text, add_special_tokens=False).ids
            b = b_side.encode(text)
            bytes_a = [bytes(signs[c] for c in a_side.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in ((i, b_side.id_to_piece(i)) for i in b)]
            raw = (" " + text).encode()
            if b"".join(bytes_a) == raw == b"".join(bytes_b):
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
                place_a, place_b = ({int(e): n + 1 for n, e in enumerate(x)} for x in (ends_a, ends_b))
                i = j = 0
                for cut in sorted(place_a.keys() & place_b.keys()):
                    i2, j2 = place_a[cut], place_b[cut]
                    groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
                    for x in range(i, i2):
                        for y in range(j, j2):
                            if (ends_a[x] - len(bytes_a[x]) < ends_b[y]) and (ends_b[y] - len(bytes_b[y]) < ends_a[x]):
                                links.append((a[x], b[y]))
                    i, j = i2, j2
        told.append((len(a) if links else 0, len(b) if links else 0, groups, links))
    counts = Counter(pair for *_, links in told for pair in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for n_a, n_b, groups, links in told]


def got(df):
    return Counter((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


def test_words_one_by_one_equal_the_whole_text():
    both = alignment.Aligner(A, B)
    assert both.b.by_word
    rnd = random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choices(SIGNS, k=rnd.randint(1, 25))) if rnd.random() < 0.5 else "".join(
            rnd.choices(["a", "the", " ", " ", "\n", "\t", "'s", "1", "é", "▁", "　", "<|endoftext|>", "</s>", "."], k=12))
        assert both.documents([text, None, text]) == [both.whole(text), alignment.NOTHING, both.whole(text)], repr(text)


@pytest.mark.parametrize("small", [False, True])
def test_query_equals_the_libraries(spark, small, monkeypatch):
    """Also with chunks of three documents, merges of two runs and blocks of 16 pairs."""
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    if small:
        for name, value in (("CHUNK_ROWS", 3), ("FAN", 2), ("PAIRS", 16)):
            monkeypatch.setattr(alignment, name, value)
        rows = rows[:25]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        assert alignment.FAN < 25 / 3
        found = got(alignment.align_tokenizers(df, A, B))
    else:
        found = got(op13_alignment(spark, SMALL))
    assert found == Counter(zip([i for i, _ in rows], by_hand([t for _, t in rows])))


def test_merge_and_edge_rows(spark):
    rnd = random.Random(2)
    runs, expected = [], Counter()
    for _ in range(7):
        own = Counter(rnd.choices(range(500), k=rnd.randint(0, 400)))
        expected.update(own)
        keys = sorted(own)
        runs.append(iter([alignment.pack_pairs(np.array(keys[i:i + 16], np.uint32), np.array([own[k] for k in keys[i:i + 16]], np.uint64))
                          for i in range(0, len(keys), 16)]))
    merged = [(int(k), int(c)) for ks, cs in alignment.merge_runs(runs) for k, c in zip(ks, cs)]
    assert merged == sorted(expected.items())

    rows = [(1, None), (2, ""), (3, " "), (4, "a▁b"), (4, "a▁b"), (None, "no id"), (5, "tie tie"), (5, "tie tie"),
            (6, "x" * 50_000), (7, "long words " * 20_000), (8, "<|endoftext|> </s>\n\n  end ")]
    wide = [(i, t, 1, 2, "p", 3) for i, t in rows]
    df = spark.createDataFrame(wide, "doc_id long, text string, chunk long, place int, pairs string, radix int")
    short = [(i, t if len(t or "") < 1000 else None) for i, t in rows]
    expected = by_hand([t for _, t in short])
    found = alignment.align_tokenizers(df.where("text is null or length(text) < 1000"), A, B)
    assert got(found) == Counter((i, e) for (i, t), e, (_, s) in zip(short, expected, rows) if s is None or len(s) < 1000)
    assert len(alignment.align_tokenizers(df, A, B).collect()) == len(rows)
    assert alignment.align_tokenizers(df.limit(0), A, B).collect() == []
    assert got(alignment.align_tokenizers(df.where("text is null"), A, B)) == Counter({(1, (0, 0, 0, 0, 0, 0, "")): 1})
