"""Values and rows that limits or ids could lose; copies that are none."""
import random

import pytest

from pairlens.llm import decontaminate, minhash, secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.example_findings(spark))


def mixed(n, seed):
    rnd = random.Random(seed)
    return "".join(rnd.choices("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789", k=n))


def test_long_values_go_whole(spark, forest):
    long, late = mixed(10_000, 1), mixed(120, 2).translate(str.maketrans("0123456789", "abcdefghij")) + "7Q9z" + mixed(30, 3)
    user = "u" * 150
    texts = [f'token = "{long}" and on', f'set secret_key = {late} now', f"postgres://{user}:S3cr3tPw9xY7@host/db",
             f"token: {mixed(1022, 4)}9 x", f"token: {mixed(1024, 5)}9 x", f"{mixed(5000, 6)}7 without a word for it"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["candidate"] for r in secrets.candidates(rows, "doc_id").collect()}
    assert found[0] == long and found[1] == late and found[2] == "S3cr3tPw9xY7" and len(found[3]) == 1023 and len(found[4]) == 1025
    assert len(found[5]) == 5001
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(rows, forest).collect()}
    assert clean[0] == 'token = "[SECRET]" and on' and clean[2] == f"postgres://{user}:[SECRET]@host/db"
    assert long[-200:] not in clean[0]


def test_redaction_by_text(spark, forest):
    key = "5f3a9c0e77b1d2468ace13579bdf02468ace1357"
    short = 'password = "Zk3k9!" and Zk3k9!, not Zk3k9!Qm2Lpx7777 nor aZk3k9! but (Zk3k9!)'
    rows = [(None, f'token = "{key}"', 1), (1, f'token = "{key}"', 2), (1, "harmless words", 3), (1, f"commit {key}", 4), (2, None, 5),
            (3, short, 6), (4, r'password = "Ab\E1!x.y+" then Ab\E1!x.y+ again', 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    clean = {(r["doc_id"], r["text"]): r["n_chars"] for r in secrets.redact(df, forest).collect()}
    assert (None, 'token = "[SECRET]"') in clean and (1, 'token = "[SECRET]"') in clean and clean[1, 'token = "[SECRET]"'] == 18
    assert clean[1, "harmless words"] == 3 and clean[1, f"commit {key}"] == 4 and clean[2, None] == 5
    assert (3, 'password = "[SECRET]" and [SECRET], not Zk3k9!Qm2Lpx7777 nor aZk3k9! but ([SECRET])') in clean
    assert (4, 'password = "[SECRET]" then [SECRET] again') in clean


def test_rows_go_not_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(3, a), (5, a), (5, b), (7, b), (None, a), (8, ""), (8, a)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, digest string, some string")
    kept = sorted(((r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(df).collect()), key=str)
    assert kept == sorted([(3, a), (5, b), (None, a), (8, "")], key=str)


def leaks_of(spark, items, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.find_leaks(rows, benchmark).collect()}


def test_shared_function_words_are_no_copy(spark):
    item = "wie viele Tage hat der Monat Februar in einem Jahr mit Schalttag?"
    other = "wie viele Seiten hat der Band Zwei in einem Regal mit Glas?"
    assert leaks_of(spark, [item], [other, item, "so: " + item]) == {(1, 0): "verbatim", (2, 0): "verbatim"}


def test_tables_of_numbers_and_empty_benchmarks(spark):
    row = "The measured values in the second column are 12 15 18 21 24 27 30 33 36 39 42 45 and the mean is sought."
    table = " ".join(str(i) for i in range(5000))
    assert leaks_of(spark, [row, "1 2 3 4 5 6 7"], [table, row, "no numbers in these few words at all"]) == {
        (0, 1): "verbatim", (1, 0): "verbatim"}
    assert leaks_of(spark, ["", "too short"], [row]) == {}
    empty = spark.createDataFrame([], "item_id long, text string")
    rows = spark.createDataFrame([(1, row)], "doc_id long, text string")
    assert decontaminate.find_leaks(rows, empty).collect() == []
    assert decontaminate.drop_leaks(rows, empty).count() == 1


def test_findings_do_not_depend_on_other_documents(spark):
    item = "Alice has 3 apples. Bob has 5 pears. Carol buys 7 plums. How many fruits do the three of them have?"
    other = item.replace("Alice", "Dora").replace("Bob", "Emil").replace("3", "8")
    alone = leaks_of(spark, [item], [other])
    assert alone == leaks_of(spark, [item], [other] + ["dora emil carol alice bob " * 50] * 3) == {(0, 0): "reparameterised"}
