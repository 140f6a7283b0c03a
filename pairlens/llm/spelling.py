"""Spelling variants: words one edit apart, found by a dynamic programme over sorted lists.

A sorted vocabulary is scanned like a tree: the rows of the edit matrix (a band of
three cells, since one edit is allowed) that belong to the prefix which a word
shares with the word before it are used again, and when a row holds no cell of at
most one edit, every word with that prefix is skipped.

The list is dealt out so that no task holds all of it.  Two words one edit apart
agree in their first code points or in their last ones, whichever side the edit
does not touch.  Each word therefore stands in a tile of words with the same
beginning and, written backwards, in one of words with the same end.  A tile is
cut into blocks of consecutive words by a range sort; a common beginning is cut
into many blocks, and two blocks meet only if their own common prefixes allow
words one edit apart.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import stored

#: Least code points and occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many (by its hash) loses a code point.
ONE_IN = 97
#: Shortest words of a class of lengths, and the code points at the beginning and at the
#: end of which one edit leaves one side alone if the shorter word is in that class.
CLASSES = ((5, 2, 3), (9, 4, 4))
#: Most words of a block.
BLOCK = 2_048
#: Words counted in a task's memory before they are passed on.
HELD = 100_000
#: Block pairs that a task gets at least on average.
PAIRS_PER_TASK = 64

_RUN = re.compile("[a-zÀ-ÿ]+")
_LAST = "\U0010ffff"


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur often enough in all texts.

    Runs of letters are lower-cased (A-Z only); where the unsigned crc32 of
    ``<doc_id>:<run>`` is divisible by 97, the run loses one code point.  A null
    text has no words, a null doc_id is written as nothing before the colon, and
    repeated rows count as often as they stand there.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["id"], batch["text"]):
                if not text:
                    continue
                start = zlib.crc32(f"{doc_id}:".encode())
                words = _RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
                for word, n in Counter(words).items():
                    h = zlib.crc32(word.encode(), start)
                    if not h % ONE_IN:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= least_length:
                        seen[word] += n
                if len(seen) > HELD:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())}).astype({"word": object, "n": "int64"})

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                        F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def shared_prefixes(words: list[str]) -> list[int]:
    """How many code points each word shares with the one before it."""
    return [0, *(len(commonprefix(pair)) for pair in zip(words, words[1:]))]


def near_in_list(query: str, words: list[str], shared: list[int], start: int = 0) -> list[int]:
    """Places from ``start`` on in the sorted list of the words exactly one edit from ``query``."""
    size, n = len(query), len(words)
    found: list[int] = []
    # rows[d]: edits (2 means too many) between the list word's first d code points
    # and the query's first d-1, d and d+1.
    rows = [(2, 0, 1 if size else 2)]
    i, kept = start, 0
    while i < n:
        word = words[i]
        del rows[kept + 1:]
        x, y, z = rows[kept]
        for d in range(kept, len(word)):
            c = word[d]
            left = min(x if 0 < d <= size and query[d - 1] == c else x + 1, y + 1) if d <= size else 2
            mid = min(y if query[d] == c else y + 1, z + 1, left + 1) if d < size else 2
            right = min(z if query[d + 1] == c else z + 1, mid + 1) if d + 1 < size else 2
            if left > 1 and mid > 1 and right > 1:
                i = bisect_left(words, word[:d + 1] + _LAST, i + 1)
                break
            x, y, z = left, mid, right
            rows.append((x, y, z))
        else:
            gap = size - len(word)
            if -2 < gap < 2 and (x, y, z)[gap + 1] == 1:
                found.append(i)
            i += 1
        if i < n:
            kept = min(shared[i], len(rows) - 1)
    return found


def _tiles(words: DataFrame) -> DataFrame:
    """(tile, key, word, n): each word in the tiles of its beginning and, backwards, of its end."""
    parts = []
    for i, (least, head, tail) in enumerate(CLASSES):
        # A word at the lower end of the next class also meets the words one shorter.
        most = CLASSES[i + 1][0] if i + 1 < len(CLASSES) else None
        own = words.where((F.length("word") >= least) & (F.lit(True) if most is None else F.length("word") <= most))
        for side, key, n in (("f", F.col("word"), head), ("b", F.reverse("word"), tail)):
            parts.append(own.select(F.concat(F.lit(f"{i}{side}"), F.substring(key, 1, n)).alias("tile"),
                                    key.alias("key"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _blocks(words: DataFrame) -> DataFrame:
    """(tile, block, prefix, keys, ns): consecutive words of a tile and what they all begin with."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, keys, ns = None, [], []

        def made() -> dict:
            return {"tile": tile, "block": keys[0], "prefix": commonprefix([keys[0], keys[-1]]), "keys": keys, "ns": ns}

        for batch in batches:
            out = []
            for t, key, n in zip(batch["tile"], batch["key"], batch["n"]):
                if t != tile or len(keys) == BLOCK:
                    if keys:
                        out.append(made())
                    tile, keys, ns = t, [], []
                keys.append(key)
                ns.append(n)
            if out:
                yield pd.DataFrame(out)
        if keys:
            yield pd.DataFrame([made()])

    return _tiles(words).repartitionByRange("tile", "key").sortWithinPartitions("tile", "key").mapInPandas(
        pack, "tile string, block string, prefix string, keys array<string>, ns array<long>")


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out: list[tuple[str, int, str, int]] = []
        for tile, same, keys, ns, keys2, ns2 in zip(batch["tile"], batch["same"], batch["keys"], batch["ns"],
                                                    batch["keys2"], batch["ns2"]):
            least, head, _ = CLASSES[int(tile[0])]
            most = CLASSES[int(tile[0]) + 1][0] - 1 if int(tile[0]) + 1 < len(CLASSES) else None
            backwards = tile[1] == "b"
            words = list(keys2)
            shared = shared_prefixes(words)
            for i, (query, n) in enumerate(zip(keys, ns)):
                for j in near_in_list(query, words, shared, i + 1 if same else 0):
                    a, b = query, words[j]
                    if most is not None and min(len(a), len(b)) > most:
                        continue  # found in the class of longer words
                    if backwards:
                        a, b = a[::-1], b[::-1]
                        if a[:head] == b[:head]:
                            continue  # found in the tile of their beginning
                    out.append((a, n, b, ns2[j]))
        yield pd.DataFrame(out, columns=["a", "na", "b", "nb"]).astype({"a": object, "na": "int64", "b": object, "nb": "int64"})


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): every pair of words exactly one edit apart, once; ``words`` is (word, n)."""
    blocks = stored(_blocks(words), "spelling-blocks")
    names = blocks.select("tile", "block", "prefix")
    other = names.select("tile", F.col("block").alias("block2"), F.col("prefix").alias("prefix2"))
    least = F.least(F.length("prefix"), F.length("prefix2"))
    # Equally long beginnings of two words one edit apart differ by two edits at most.
    may = F.levenshtein(F.expr("left(prefix, least(length(prefix), length(prefix2)))"),
                        F.expr("left(prefix2, least(length(prefix), length(prefix2)))")) <= 2
    meet = stored(names.join(other, "tile").where(F.col("block") <= F.col("block2")).where((least == 0) | may)
                  .select("tile", "block", "block2"), "spelling-meetings")
    tasks = max(1, -(-meet.count() // PAIRS_PER_TASK))
    both = (meet.join(blocks.select("tile", "block", "keys", "ns"), ["tile", "block"])
            .join(blocks.select("tile", F.col("block").alias("block2"), F.col("keys").alias("keys2"),
                                F.col("ns").alias("ns2")), ["tile", "block2"]))
    both = both.select("tile", (F.col("block") == F.col("block2")).alias("same"), "keys", "ns", "keys2", "ns2")
    return both.repartition(tasks).mapInPandas(_pairs, "a string, na long, b string, nb long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms.

    A form occurs at least twice as often as its word, so chains are no longer
    than the logarithm of the largest count, and pointer doubling needs the
    logarithm of that many steps.
    """
    now = forms.select("word", F.col("form").alias("root"))
    top = forms.agg(F.max("form_n")).first()[0] or 1
    for _ in range(max(1, int(top).bit_length().bit_length())):
        now = stored(now, "spelling-roots")
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts.

    ``n_near`` counts the words exactly one edit away (0 if none).  ``form`` is
    the most frequent of them (ties: the first in code-point order) if it occurs
    at least twice as often as the word, else null, as is ``form_n``; ``root`` is
    the last of the forms reached from the word, the word itself if it has none.
    Texts without words and an empty table give an empty result; other columns
    are ignored.
    """
    words = stored(word_counts(docs), "spelling-words")
    near = stored(near_words(words), "spelling-near")
    both = near.union(near.select("b", "nb", "a", "na")).toDF("word", "n", "other", "m")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("top"))
    told = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("top.m") >= 2 * F.col("n"), F.col("top.other")).alias("form"),
        F.when(-F.col("top.m") >= 2 * F.col("n"), -F.col("top.m")).alias("form_n")), "spelling-forms")
    roots = _roots(told.where("form is not null").select("word", "form", "form_n"))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
