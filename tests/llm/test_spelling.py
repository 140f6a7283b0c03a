"""Spelling variants against brute force."""
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pairlens.llm import spelling
from pairlens.llm.common import table
from pairlens.llm.queries import op12_spelling

SMALL = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_hand(rows):
    counts = Counter()
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for word in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = defaultdict(set)
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[:i]:
            if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for a in near:
        b = min(near[a], key=lambda w: (-counts[w], w))
        if counts[b] >= 2 * counts[a]:
            form[a] = b

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_scan_equals_all_pairs():
    rnd = random.Random(1)
    for _ in range(60):
        words = sorted({"".join(rnd.choices("abc", k=rnd.randint(0, 7))) for _ in range(60)})
        shared = spelling.shared_prefixes(words)
        for q in [*words, "", "abcabca"]:
            assert spelling.near_in_list(q, words, shared) == [i for i, w in enumerate(words) if one_edit(q, w)]


@pytest.mark.parametrize("block", [spelling.BLOCK, 3])
def test_query_equals_all_pairs(spark, block, monkeypatch):
    """Also with tiles cut into blocks of three words, as a very common beginning is."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    if block == 3:
        rows = rows[:40]
        found = got(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    else:
        found = got(op12_spelling(spark, SMALL))
    assert found == by_hand(rows) and any(f[0] for f in found.values())


def test_chains_of_forms_and_edge_rows(spark):
    chain = ["abcde", "abcdef", "abcdefg", "abcdefgh", "abcdefghi"]
    text = " ".join(w.upper() + " " + " ".join([w] * (3 * 2 ** i - 1)) for i, w in enumerate(chain))
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "12 -- 34"), (5, "x" * 200_000),
            (6, "ÉCOLE Éclat éclat éclat straße straße straße Straßen straßen straßen straßen straßen straßen")]
    wide = [(i, t, "w", 1, "f", "r", 2) for i, t in rows]
    df = spark.createDataFrame(wide, "doc_id long, text string, word string, n long, form string, root string, n_near long")
    found = got(spelling.spelling_variants(df))
    assert found == by_hand(rows)
    assert found["abcde"][:2] == ("abcdef", "abcdefghi")
    assert found["abcdefghi"][:2] == (None, "abcdefghi")
    assert got(spelling.spelling_variants(df.limit(0))) == {}
    assert got(spelling.spelling_variants(df.where("text is null"))) == {}
