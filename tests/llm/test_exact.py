"""Operators against plain versions on small tables."""
import collections
import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairlens.llm import (bpe, decontaminate, minhash, neighbours, pseudonyms, queries, secrets, sharding, suffixes,
                          toxicity, wrappers)
from pairlens.llm.common import table
from pairlens.llm.graph import components

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents").select("doc_id", "text").toPandas().sort_values("doc_id").reset_index(drop=True)


def test_bpe_equals_the_tokenizer(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, other = bpe.Vocabulary(path), Tokenizer.from_file(path)
    rnd = random.Random(3)
    signs = [chr(c) for c in [*range(32, 127), *range(160, 700), *range(0x370, 0x400), 0x300, 0x301, 0x1F600, 0x4E2D,
                              0x130, 0x3A3, 0xB2, 0x2028, 0x85, 0x1C, 0x200B]]
    texts = [*docs["text"], *("".join(rnd.choices(signs, k=rnd.randint(0, 50))) for _ in range(500)),
             *("".join(rnd.choices("abcdeinthr' ", k=60)) for _ in range(500)), "a<|endoftext|>b", "ΟΔΟΣ", "a" * 3000]
    for text in texts:
        ids = other.encode(text, add_special_tokens=False).ids
        raw = own.encode(text)
        assert np.frombuffer(raw, "<u4").tolist() == ids
        assert own.decode(np.frombuffer(raw, "<u4")).decode() == other.decode(ids, skip_special_tokens=False)


def repeats_by_hand(rows):
    seen, out = set(), {}
    for i, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p:p + 100] in seen:
                gone[p:p + 100] = True
            seen.add(raw[p:p + 100])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_equal_a_scan(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = [(int(i), t) for i, t in zip(docs.doc_id, docs.text)]
    rows += [(10_000, "ab" * 400), (10_001, "xyz" * 200 + rows[3][1] + "xyz" * 200), (10_002, "é" * 150)]
    got = {r[0]: tuple(r)[1:] for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == repeats_by_hand(rows)


def test_merged_shards_equal_one_sort():
    rng = np.random.default_rng(5)
    symbols = [rng.integers(0, 3, 400) for _ in range(suffixes.ROUNDS)]
    shards = []
    for lo, hi in ((0, 100), (100, 150), (150, 400)):
        order, orders = np.arange(lo, hi), []
        for s in symbols:
            order = order[np.argsort(s[order], kind="stable")]
            orders.append(order)
        shards.append(orders)
    merged, block = suffixes.interleave(shards, symbols)
    key = list(zip(*[s.tolist() for s in reversed(symbols)]))
    assert [key[i] for i in merged] == sorted(key)
    assert all((block[j] == block[j - 1]) == (key[merged[j]] == key[merged[j - 1]]) for j in range(1, 400))


def duplicates_by_hand(rows, words, percent=80):
    hashes = minhash.Words()
    sets = {i: set(minhash.shingles(t, words, hashes).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, docs, words, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "BLOCK_OUT", 4)
    rnd = random.Random(1)
    origin = [f"w{i}" for i in range(60)]
    copies = []
    for n in range(60):  # a large group, partly linked through others only
        text = list(origin)
        for _ in range(rnd.randint(0, 9)):
            text[rnd.randrange(60)] = f"v{rnd.randrange(40)}"
        copies.append((20_000 + n, " ".join(text)))
    rows = [(int(i), t) for i, t in zip(docs.doc_id, docs.text)] + copies
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == duplicates_by_hand(rows, words)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_min_and_max_estimate_resemblance():
    rng = np.random.default_rng(2)
    hits = 0
    for _ in range(200):
        base = rng.integers(0, 2**63, 90, dtype=np.uint64)
        a, b = np.unique(base[:85]), np.unique(np.r_[base[5:85], base[85:]])
        hits += bool(np.intersect1d(minhash.bands(a), minhash.bands(b)).size)
    assert hits == 200  # resemblance 0.89


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r[0]: r[1] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_shards_follow_the_law(spark):
    got = sharding.shard_documents(table(spark, SMALL, "documents"), 5).toPandas()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert (got.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() <= got["size"].sum() / 5 + got["size"].max()


def test_smallest_capacity(spark):
    rnd = random.Random(9)
    sizes = [rnd.randint(1, 50) for _ in range(60)]
    placed = sharding.minimax_cells(spark.createDataFrame(list(enumerate(sizes)), "cell int, bytes long"), 6).collect()
    load = collections.Counter()
    for r in placed:
        load[r["shard"]] += sizes[r["cell"]]

    def shards(cap):
        n, now = 1, 0
        for s in sizes:
            n, now = (n + 1, s) if now + s > cap else (n, now + s)
        return n

    assert max(load.values()) == next(c for c in range(max(sizes), sum(sizes) + 1) if shards(c) <= 6)


def test_giant_group_leaves_no_shard_empty(spark):
    cells = spark.createDataFrame([(i, 1000 if i == 7 else 1) for i in range(100)], "cell int, bytes long")
    assert len({r["shard"] for r in sharding.minimax_cells(cells, 4).collect()}) == 4


def test_wrappers_read_the_article():
    page = ("<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>"
            "<div class='ad'>Buy</div>{}<div id=comments><p>first!</p></div><footer>&copy;</footer>")
    inner = ["<article><h1>A &amp; B</h1><p><b>one\n two<br><p>three&nbsp;four</article>",
             "<article><h1>C</h1><ul><li>x<li>y</ul><form><p>sign up</form><p>z</article>", "<p>plain</p>"]
    pages = [wrappers.parse(page.format(i)) for i in inner]
    whole = wrappers.decide(wrappers.align(wrappers.wrapper_of(p) for p in pages))
    assert [wrappers.extract(p, whole) for p in pages] == ["A & B\none two\nthree four", "C\nx\ny\nz", "plain"]
    assert "p(#text)" in whole.pattern() and "?" in whole.pattern()
    again = wrappers.Item.load(json.loads(json.dumps(whole.dump())))
    assert again.pattern() == whole.pattern()


def test_pages_equal_a_plain_reading(spark):
    import html
    import re

    got = {r["page_id"]: r["text"] for r in queries.op1_wrappers(spark, SMALL).collect()}
    for r in table(spark, SMALL, "pages").collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_leaks(spark):
    question = "If Anna Miller buys 12 apples for 3 euro and gives 4 of them to Bob, how many apples has Anna Miller now?"
    benchmark = spark.createDataFrame([(1, question), (2, "short one")], "item_id long, text string")
    texts = ["Well. If Clara Jones buys 17 apples for 5 dollars and gives 9 of them to Tom, how many apples has Clara Jones now?",
             "If Clara Jones buys 17 apples for 5 dollars and gives 9 of them to Tom, how many apples has Dora Smith now?",
             question.upper(), question.lower(), "short one", "how many apples has she now, if any at all?"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["kind"] for r in decontaminate.find_leaks(rows, benchmark).collect()}
    assert got == {0: "reparameterised", 2: "verbatim", 3: "verbatim"}
    assert sorted(r[0] for r in decontaminate.drop_leaks(rows, benchmark).collect()) == [1, 4, 5]


def test_leaks_equal_a_scan(spark):
    import re

    docs, items = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    asked = {r["item_id"]: grams(split(r["text"])) for r in items.collect()}
    held = {(r["doc_id"], i) for r in docs.collect() for i, g in asked.items() if len(g & grams(split(r["text"]))) >= 0.8 * len(g)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()} == held


def leaks_of(spark, item, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    return {r["doc_id"]: r["kind"] for r in decontaminate.find_leaks(rows, benchmark).collect()}


def test_leaks_with_windows_that_come_again(spark):
    terms = "Find the next term of the sequence 2 4 8 16 32 64 128 and explain in one sentence how you have found it."
    pens = "A shop sells 3 red pens for 2 dollars and 5 red pens for 4 dollars, which of the two offers is better for you?"
    before = ["so it goes " * k for k in range(0, 16, 3)]
    assert leaks_of(spark, terms, [b + terms for b in before]) == dict.fromkeys(range(len(before)), "verbatim")
    assert leaks_of(spark, pens, [b + pens for b in before]) == dict.fromkeys(range(len(before)), "verbatim")
    other = pens.replace("3", "7").replace("2", "9").replace("5", "8").replace("4", "6")
    mixed = "A shop sells 3 red pens for 3 dollars and 3 red pens for 3 dollars, which of the two offers is better for you?"
    assert leaks_of(spark, pens, [b + other for b in before]) == dict.fromkeys(range(len(before)), "reparameterised")
    # An item value that stands for two values is no copy, beside one that is.
    assert leaks_of(spark, mixed, [other, other + " " + mixed]) == {1: "verbatim"}


def test_leaks_with_long_insertions(spark):
    words = [f"{a}{b}" for a in ("bal", "cor", "dem", "fin", "gor", "hul") for b in ("an", "es", "it", "om", "ur", "ax", "el", "ig", "op", "yt")][:59]
    words[9], words[40], words[50] = "12", "7", "12"
    notice = [f"notice{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    other = ["33" if w == "12" else "5" if w == "7" else w for w in words]
    texts, kinds = [], {}
    for n in (12, 17, 60, 400):
        for k in range(0, 16, 5):
            for copy, kind in ((words, "verbatim"), (other, "reparameterised")):
                kinds[len(texts)] = kind
                texts.append(" ".join(["so"] * k + copy[:30] + notice[:n] + copy[30:]))
    texts.append(" ".join(words[30:] + notice[:17] + words[:30]).replace(words[30], "or"))  # not in order
    assert leaks_of(spark, " ".join(words), texts) == kinds


def test_leaks_whose_sentences_begin_with_names(spark):
    item = "Alice has 3 apples. Bob has 5 pears. Carol buys 7 plums. How many fruits do the three of them have?"
    other = "Dora has 8 apples. Emil has 2 pears. Frank buys 9 plums. How many fruits do the three of them have?"
    texts = [other, item, item.lower(), "So. " + other.replace(". ", ".\n"), other.replace("How", "how").replace(". ", ": "),
             other.replace("many fruits do the three", "few nuts will this one"), other + " " + item]
    assert leaks_of(spark, item, texts) == {0: "reparameterised", 1: "verbatim", 2: "verbatim", 3: "reparameterised",
                                            4: "reparameterised", 6: "verbatim"}
    assert leaks_of(spark, "What is the capital of France?", ["Paris is the capital of Spain, they say.", "What is the capital of Spain?"]) \
        == {1: "reparameterised"}


def test_network_gradients():
    rng = np.random.default_rng(0)
    a = {"W": None, "U": rng.normal(0, .4, (2, toxicity.HIDDEN, 3 * toxicity.HIDDEN)), "v": rng.normal(0, .4, 2 * toxicity.HIDDEN),
         "o": rng.normal(0, .4, 2 * toxicity.HIDDEN), "o0": np.array(0.1)}
    p = rng.normal(0, 1, (2, 6, 4, 3 * toxicity.HIDDEN))
    mask = (np.arange(6)[:, None] < np.array([6, 3, 1, 5])[None, :]).astype(float)
    y, w = np.array([1.0, 0, 1, 0]), np.ones(4)

    def loss():
        logit = toxicity._pool(a, toxicity._passes(a, p, mask), mask)[0]
        return np.mean(np.log1p(np.exp(logit)) - y * logit)

    grads, dp = toxicity.gradients(a, p, mask, y, w)
    for array, grad in ((a["U"], grads["U"]), (a["v"], grads["v"]), (a["o"], grads["o"]), (p, dp)):
        for at in [tuple(rng.integers(0, n) for n in array.shape) for _ in range(6)]:
            kept, step = array[at], 1e-2
            array[at] = kept + step
            up = loss()
            array[at] = kept - step
            down = loss()
            array[at] = kept
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-3


def test_toxicity_is_learned_and_held_out():
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(300)]

    def text(bad):
        t = rnd.choices(words, k=rnd.randint(5, 300))
        for _ in range(3 * bad):
            t[rnd.randrange(len(t))] = rnd.choice(["Rotten", "nasty!!", "vilely", "vileness"])
        return " ".join(t)

    labels = [int(rnd.random() < 0.3) for _ in range(900)]
    texts = [text(b) for b in labels]
    model = toxicity.Model.load(toxicity.train(texts[:700], np.array(labels[:700])).dump())
    scores = toxicity.Scorer(model).scores(texts[700:])
    assert np.mean((scores >= 0.5) == (np.array(labels[700:]) == 1)) > 0.95
    late = " ".join(rnd.choices(words, k=5000)) + " nasty rotten vilest"
    assert toxicity.Scorer(model).scores([late])[0] > 0.5  # the end of a long text counts


def test_pseudonyms():
    there, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", True)
    text = "4111 1111 1111 1111, 4111111111111111, 97.51.17.173, +1 (417) 555-7713, 1984-02-29, 123-45-6789, jo.34@mail.example.com"
    new, found = there.replace(text)
    assert [k for k, _, _ in found] == ["card", "card", "ip", "phone", "date", "ssn", "email"]
    assert back.replace(new)[0] == text and len(new) == len(text) + len(new.split(", ")[2]) - len("97.51.17.173")
    first, second = (v.replace(" ", "") for v in new.split(", ")[:2])
    assert first == second != "4111111111111111" and pseudonyms.check_digit(first[:-1]) == first[-1]
    for wrong in ("4111111111111112", "1984-02-30", "999.1.1.1", "000-12-3456"):
        assert there.replace(wrong) == (wrong, [])
    f = pseudonyms.Feistel(b"key")
    for size in (1, 2, 7, 1000):
        moved = [f.permute(i, size, "t") for i in range(size)]
        assert sorted(moved) == list(range(size)) and [f.undo(m, size, "t") for m in moved] == list(range(size))
    assert pseudonyms.Pseudonyms(b"other").replace(text)[0] != new


def test_pseudonyms_in_long_runs_of_numbers():
    there, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", True)
    card = there.replace("4111 1111 1111 1111")[0]
    cases = {"1 2024-05-01 2024-05-02 2024-05-03": ["date"] * 3,
             "2024-05-01 12:30:45 4111 1111 1111 1111": ["date", "card"],
             "10 20 30 40 50 60 70 80 4111-1111-1111-1111": ["card"],
             "7 " * 5000 + "4111 1111 1111 1111 " + "2024-05-01 97.51.17.173 " * 50: ["card"] + ["date", "ip"] * 50,
             "2024-05-01-2024-05-31 (2024-05-01) 97.51.17.173/24 2024-05-01/2024-05-31": ["date"] * 3 + ["ip"] + ["date"] * 2,
             "10 20 30 2024-05-01 47.jo@mail.example.com": ["date", "email"],
             "2024-05-01 2024-05-02 2024-05-03x 1.2.3.4.5": ["date"] * 2, "(" * 20000 + "1 " * 20000: []}
    for text, kinds in cases.items():
        new, found = there.replace(text)
        assert [k for k, _, _ in found] == kinds, text[:60]
        assert back.replace(new)[0] == text and all(a == 0 or text[a - 1] in " (/-" for _, a, _ in found)
    for text in list(cases)[1:2]:
        assert there.replace(text)[0].endswith(card)  # linked to its other occurrences


def test_secrets(spark):
    model = secrets.train(secrets.example_findings(spark))
    texts = ['set token = "5f3a9c0e77b1d2468ace13579bdf02468ace1357" now', "commit 5f3a9c0e77b1d2468ace13579bdf02468ace1357 fixes it",
             "card 4111111111111111 and +1 (017) 555-7713", "id: 3f2504e0-4f89-11d3-9a0c-0305e82c3301", "no digits here at all",
             "see https://www.example.com/blog/2024/some-long-page-123", "password = changeme-example1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.find_secrets(rows, model)
    assert {r["doc_id"] for r in found.collect()} == {0}
    r = found.first()
    assert texts[0][r["start"] - 1:][:40] == r["secret"] and r["n_found"] == 1
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(rows, model).collect()}
    assert clean[0] == 'set token = "[SECRET]" now' and all(clean[i] == texts[i] for i in range(1, len(texts)))


def test_secrets_at_a_later_place(spark):
    model = secrets.train(secrets.example_findings(spark))
    value = "5f3a9c0e77b1d2468ace13579bdf02468ace1357"
    texts = [f'commit {value} fixes it; set token = "{value}" now', f"commit {value} and commit {value}",
             f'\x01é commit {value} ' * 30 + f'token = "{value}"', f'token = "{value}"', f"{value}"]
    found = {r["doc_id"]: r for r in secrets.find_secrets(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert set(found) == {0, 2, 3} and [found[i]["n_found"] for i in (0, 2, 3)] == [2, 31, 1]
    assert all(texts[i][r["start"] - 10:][:49] == f'token = "{value}' for i, r in found.items())
    inside = spark.createDataFrame([(0, "abcK3k9Qm2Lpx7 is no value, token: K3k9Qm2Lpx7")], "doc_id long, text string")
    assert [r["start"] for r in secrets.candidates(inside, "doc_id").collect()] == [36]


def test_secrets_of_every_form(spark):
    model = secrets.train(secrets.example_findings(spark))
    forty, bearer = "wJalrXUtnFEMIKbPxRfiCYEXAMqLEKEYabcdefgh", "mFqzBtKwPlXcVnRjHsDgYaTeUoIkZbQw"
    forms = [('SECRET_KEY = "%s"', "hunter2pass!"), ("secret_key: %s", "abcdEFGHijklMNOPqrstUVWX"),
             ("aws_secret_access_key = %s", forty), ("api-key: %s", "Zk3k9Qm2Lp"), ("passphrase = %s", "correct.Horse9"),
             ("password: %s", "Ab1!xyz"), ("Authorization: Bearer %s", bearer), ("postgres://admin:%s@host", "S3cr3tPw9")]
    plain = ["password: required", "token = none", "secret: garden", "Bearer authentication is used", "tokens: 2048",
             "password = config.password", "secret_key: your_secret_here", "https://user:password@host", "password: ********"]
    texts = [f % v for f, v in forms] + [f"so it is, {f % v} and so on" for f, v in forms] + plain
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.find_secrets(rows, model)
    got = {r["doc_id"]: r["secret"] for r in found.collect()}
    assert got == {i: forms[i % len(forms)][1] for i in range(2 * len(forms))}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(rows, model).collect()}
    assert all(clean[i] == f % "[SECRET]" for i, (f, _) in enumerate(forms))


def test_neighbours_recall(spark):
    import pandas as pd

    rows = table(spark, SMALL, "embeddings").select("vec_id", "embedding").toPandas()
    x = np.array(rows["embedding"].tolist(), float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = neighbours.nearest(table(spark, SMALL, "embeddings"), 50, 5).toPandas()
    hit = 0
    for i in np.flatnonzero(rows["vec_id"] % 50 == 0):
        s = unit @ unit[i]
        s[i] = -2
        best = set(rows["vec_id"].to_numpy()[np.argsort(-s, kind="stable")[:5]])
        mine = got[got["query_id"] == rows["vec_id"][i]].sort_values("rank")
        hit += len(best & set(mine["vec_id"]))
        assert np.allclose(mine["score"], [unit[rows.index[rows["vec_id"] == v][0]] @ unit[i] for v in mine["vec_id"]])
    assert hit >= 0.9 * len(got)
    assert isinstance(got, pd.DataFrame)


def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert 0 < len(out) < docs.count() and [n for n, _ in corpus_pipeline.STAGES][1] == "near_duplicates"
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SMALL)
        assert after.columns == docs.columns, name
        now = after
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    assert set(texts) == set(out)
    v = bpe.Vocabulary(queries.word_bpe())
    assert all(np.frombuffer(v.encode(t), "<u4").tolist() == out[i] for i, t in texts.items())
    left = duplicates_by_hand([(i, t) for i, t in texts.items()], 5)
    assert all(i == c for i, c in left.items())
    assert not spark.createDataFrame(list(texts.items()), "doc_id long, text string").where(
        F.lower("text").rlike('token = "[0-9a-f]{40}"')).count()
