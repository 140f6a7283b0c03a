"""Byte-pair encoding by backtracking over longest token matches, and decoding.

Encoding a word finds the longest vocabulary token at every position with an
Aho-Corasick automaton, then walks left to right: a token is accepted when it
is compatible with the one before it, otherwise the next shorter prefix token
is tried, and a position from which nothing fits is marked and never entered
again.  Two tokens are compatible when running the merges over their
concatenation gives back exactly these two; a sequence whose neighbours are
all compatible is the one that the merges produce, so the result is exact and
each word takes linear time.  Decoding gathers token bytes from one buffer
through an offset table.

Texts are split at white space first.  No pre-token spans white space, so the
ids of a white-space chunk never depend on its neighbours and can be
remembered; the memory holds at most ``CHUNKS_KEPT`` chunks per worker and only
saves time.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks and pairs remembered per worker (about 200 and 100 bytes each).
CHUNKS_KEPT = 500_000
PAIRS_KEPT = 150_000
#: Rows per output batch.
ROWS = 512

#: Marks a word's end inside the automaton: a private-use character that byte
#: symbols never contain.
END = "\ue000"
#: White space as the tokenizer's regular expressions define it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(extra)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and decoding buffer of one tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", SPACE)).findall
        self.symbols = byte_symbols()

        def inner(token: str) -> str:
            return token[:-len(suffix)] + END if token.endswith(suffix) else token

        # A merge's rank decides; split[t] is the pair that t was merged from.
        self.merge: dict[tuple[int, int], int] = {}
        self.rank = {i: -1 for i in ids.values()}
        self.split: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, made = ids[a], ids[b], ids[a + b]
            self.merge[left, right] = made
            self.rank[made] = rank
            self.split[made] = (left, right)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.length: dict[int, int] = {}
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        by_text: dict[str, int] = {}
        for token, i in sorted(ids.items(), key=lambda x: self.rank[x[1]]):
            # A token that its own merges do not reach can never come out.
            if i in self.split and not (all(p in self.length for p in self.split[i])
                                        and self._joins(*self.split[i], self.rank[i])):
                continue
            text = inner(token)
            self.length[i] = len(text)
            by_text[text] = i
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        for text, i in by_text.items():
            self.shorter[i] = next((by_text[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in by_text), None)

        every = {i: t.encode() for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        parts = [every.get(i, b"") + b" " for i in range(max(every) + 1)]
        self.offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=self.offsets[1:])
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.diff(self.offsets)
        self.chunks: dict[str, bytes] = {}

    def _joins(self, left: int, right: int, below: float = float("inf")) -> bool:
        """Whether no merge under rank ``below`` crosses the border between the two tokens.

        Undoes the later of the two tokens step by step; a merge of the edge
        pieces that comes before the step just undone would have crossed.
        """
        while True:
            made = self.merge.get((left, right))
            if made is not None and self.rank[made] < below:
                return False
            if self.rank[left] > self.rank[right]:
                # The left piece was merged last: at equal rank the crossing
                # merge lies to the right of it, so it comes later.
                below = self.rank[left]
                left = self.split[left][1]
            elif self.rank[right] >= 0:
                # A crossing merge of the same rank lies to the left and comes first.
                below = self.rank[right] + 1
                right = self.split[right][0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[left, right] = self._joins(left, right)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token (normalised text without white space)."""
        symbols = self.symbols
        text = "".join([symbols[b] for b in word.encode("utf-8", "surrogatepass")]) + END
        longest: list[int | None] = [None] * (len(text) + 1)
        for end, (token, n) in self.automaton.iter(text):
            longest[end - n + 1] = token  # ends ascend, so the last one is the longest
        length, shorter, compatible = self.length, self.shorter, self.compatible
        out: list[int] = []
        open_ = [True] * (len(text) + 1)
        at, token = 0, longest[0]
        while at < len(text):
            while token is not None:
                end = at + length[token]
                if open_[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token is None:
                open_[at] = False
                token = out.pop()
                at -= length[token]
                token = shorter[token]
            else:
                out.append(token)
                at = end
                token = longest[at]
        return out

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        pieces = self.special_split.split(chunk) if self.special_split else [chunk]
        for piece in pieces:
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                for word in self.words(plain):
                    ids += self.encode_word(word)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() takes these as white space
            import regex
            chunks = [c for c in regex.split(f"[{SPACE}]+", text) if c]
        else:
            chunks = text.split()
        known, out = self.chunks, []
        for chunk in chunks:
            got = known.get(chunk)
            if got is None:
                if len(known) >= CHUNKS_KEPT:
                    known.clear()
                got = known[chunk] = self._chunk(chunk)
            out.append(got)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: the tokens of ``ids``, one space between two."""
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        take = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.buffer[take].tobytes()[:-1]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, loaded once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` (array<int>) of every row's whole text.

    A null or empty text has no ids; null doc_ids and repeated rows are kept
    as they are; an empty table gives an empty result; other columns are ignored.
    """
    def run(batches):
        v = vocabulary(path)
        for b in _rows(batches):
            ids = [np.frombuffer(v.encode(t), "<u4").astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _input(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded ``text`` of every row of ``encode_documents``."""
    def run(batches):
        v = vocabulary(path)
        for b in _rows(batches):
            texts = [v.decode(np.array(i or [], np.int64)).decode("utf-8", "replace") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text.

    Encodes and decodes as the two functions above, batch by batch, without
    passing the ids themselves on; the same rules hold for nulls.
    """
    def run(batches):
        v = vocabulary(path)
        for b in _rows(batches):
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                raw = v.encode(t)
                ids = np.frombuffer(raw, "<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(v.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
