"""Cross-tokenizer alignment: how often two tokenizers' tokens overlap, counted by external spilling.

Two tokenizers cut the same bytes.  Every pair of a token of side A and one of side
B whose byte ranges overlap is a link.  The corpus-wide count of an id pair needs
all documents, and each document needs the counts of its own links back:

1. Tasks encode their documents chunk by chunk and write, for every radix of the
   B id, one run: the chunk's pairs in order of (B id, A id), delta-coded and
   compressed with zstd, and beside it the pair-document records of the same order.
2. Runs of a radix are merged by a heap over the last pairs of their open blocks;
   a task merges at most about ``FAN`` runs, and passes repeat until one is left.
   Since the order is B id first, the last pass knows the largest count of a B id
   as soon as that id ends.
3. The records of the runs meet the counts of their radix again and give every
   document its contributions.

Runs, merged runs and counts are Parquet tables in the shared folder, so a lost
executor repeats only its own part.  No task holds more than a few blocks of each
of its runs and the counts of one radix, which distinct pairs bound and documents
do not.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import stored

#: Parts of the B ids; runs that a task merges; pairs of one compressed block.
RADIX, FAN, PAIRS = 32, 64, 1 << 16
#: Bytes of text and rows up to which documents share a chunk's runs.
CHUNK_BYTES, CHUNK_ROWS = 8_000_000, 30_000
#: Characters of documents that are aligned together.
SLAB = 400_000
#: Aligned words in each half of what a worker remembers (a cache only) and the longest of them.
WORDS_KEPT, WORD_LENGTH = 200_000, 64

#: Fixed value: how byte-level BPE splits text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Before a space that follows something else: no token of either side reaches over such a place.
_WORD = re.compile(r"(?<=\S)(?= )")


def _byte_signs() -> dict[str, int]:
    """The signs in which byte-level vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {chr(b): b for b in plain}
    signs.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return signs


class ByteTokens:
    """Side A: a byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        signs = _byte_signs()
        ranks = {bytes(signs[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.encode = tiktoken.Encoding("side-a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        # Merged by rank of the result: the same as by order of merges if that is the order of ids.
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"][m.replace(" ", "", 1)] for m in merges]
        if ids != sorted(ids):
            raise ValueError("the vocabulary's ids do not follow its merges")


class PieceTokens:
    """Side B: a sentencepiece model with byte fallback, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i)
                              else piece.replace("▁", " ").encode())
        # Words can be encoded one by one if no piece goes on after a sign with a space.
        self.by_word = not any(b" " in p.lstrip(b" ") for p in self.bytes)
        # A call for a list starts threads, which costs as much as 200 calls for a word.
        self.encode = lambda texts: (model.encode(texts, num_threads=1) if len(texts) > 200 else [model.encode(t) for t in texts])


#: (n_a, n_b, n_groups, groups, links) of some text, links as little-endian unsigned 32-bit b << 16 | a.
Alignment = tuple[int, int, int, bytes, bytes]
NOTHING: Alignment = (0, 0, 0, b"", b"")


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        if len(self.a.bytes) > 1 << 16 or len(self.b.bytes) > 1 << 16:
            raise ValueError("pairs are coded for vocabularies of at most 65,536 ids")
        self.size_a, self.size_b = (np.array([len(t) for t in side.bytes]) for side in (self.a, self.b))
        ids = range(max(len(self.a.bytes), len(self.b.bytes)))
        self.signs = np.array([[b"%d%s" % (i, after) for i in ids] for after in (b",", b"|", b";", b"")], object)
        #: What was aligned lately and, behind it, before that.
        self.known: dict[str, Alignment | tuple[()]] = {}
        self.before: dict[str, Alignment | tuple[()]] = {}

    def align(self, texts: list[str], a: list[list[int]], b: list[list[int]]) -> list[Alignment | tuple[()]]:
        """The alignment of each stretch of text; () where a side's tokens are not its bytes."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (a, b))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(texts)))
        to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
        right = (len(ends_a) and len(ends_b) and n_a.all() and n_b.all()
                 and (ends_a[to_a - 1] == ends).all() and (ends_b[to_b - 1] == ends).all()
                 and b"".join(map(self.b.bytes.__getitem__, flat_b.tolist())) == b"".join(raw)
                 and b"".join(map(self.a.bytes.__getitem__, flat_a.tolist())) == b"".join(raw))
        if not right:  # one of them is the cause
            if len(texts) == 1:
                return [()]
            half = len(texts) // 2
            return self.align(texts[:half], a[:half], b[:half]) + self.align(texts[half:], a[half:], b[half:])
        # Between two neighbouring cuts lies one link; where both sides cut, a group ends.
        cuts, common = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        links = (flat_b[np.searchsorted(ends_b, cuts)] << 16 | flat_a[np.searchsorted(ends_a, cuts)]).astype("<u4").tobytes()
        to_link, to_group = np.searchsorted(cuts, ends) + 1, np.searchsorted(common, ends) + 1
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        # What follows an id: the rest of its side, the other side, the next group, nothing.
        after_a = np.isin(ends_a, common, assume_unique=True).astype(np.int64)
        after_b = 2 * np.isin(ends_b, common, assume_unique=True)
        after_b[to_b - 1] = 3
        signs = self.signs[np.concatenate([after_a, after_b])[order], np.concatenate([flat_a, flat_b])[order]].tolist()
        out, sign, link, group = [], 0, 0, 0
        for x, y, to, g in zip(n_a.tolist(), n_b.tolist(), to_link.tolist(), to_group.tolist()):
            out.append((x, y, g - group, b"".join(signs[sign:sign + x + y]), links[4 * link:4 * to]))
            sign, link, group = sign + x + y, to, g
        return out

    def whole(self, text: str) -> Alignment:
        """The alignment of a text; nothing if a side's bytes are not the text's."""
        spaced = " " + text
        return self.align([spaced], [self.a.encode(spaced)], self.b.encode([text]))[0] or NOTHING

    def documents(self, texts: list[str | None]) -> list[Alignment]:
        """The alignment of each text: word by word where the vocabularies allow it, each new word once."""
        if not self.b.by_word:
            return [self.whole(t) if t else NOTHING for t in texts]
        words = [_WORD.split(" " + t) if t else [] for t in texts]
        known, before = self.known, self.before
        own: dict[str, Alignment | tuple[()]] = {}
        for w in chain.from_iterable(words):
            if w not in known and w not in own:
                own[w] = before.get(w)
        new = [w for w, x in own.items() if x is None]
        if new:
            own.update(zip(new, self.align(new, list(map(self.a.encode, new)), self.b.encode([w[1:] for w in new]))))
        out = []
        for text, parts in zip(texts, words):
            got = [known[w] if w in known else own[w] for w in parts]
            if not all(got):
                out.append(self.whole(text))
            elif got:
                n_a, n_b, n, groups, links = zip(*got)
                out.append((sum(n_a), sum(n_b), sum(n), b";".join(groups), b"".join(links)))
            else:
                out.append(NOTHING)
        if len(known) + len(own) > WORDS_KEPT:
            self.known, self.before = {}, known
        self.known.update((w, x) for w, x in own.items() if len(w) <= WORD_LENGTH)
        return out


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The two tokenizers, loaded once per worker process."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


# -- runs --------------------------------------------------------------------------------

def _packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = struct.pack(f"<{len(arrays)}I", *(a.nbytes for a in arrays))
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpacked(blob: bytes, *types: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = struct.unpack_from(f"<{len(types)}I", raw)
    out, at = [], 4 * len(types)
    for size, kind in zip(sizes, types):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def pack_pairs(keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> bytes:
    """One block of ascending pairs: keys as differences, counts, and more columns."""
    return _packed(np.diff(keys, prepend=np.uint32(0)), counts, *more)


def unpack_pairs(blob: bytes, *more: str) -> list[np.ndarray]:
    keys, *rest = _unpacked(blob, "<u4", "<u8", *more)
    return [np.cumsum(keys, dtype=np.uint32), *rest]


def merge_runs(runs: list[Iterator[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs (blocks of ascending pairs) -> ascending, disjoint blocks of pairs with summed counts.

    The heap holds the last pair of each run's open block: up to the smallest
    of them every run's pairs are at hand.
    """
    open_: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def refill(r: int) -> None:
        blob = next(runs[r], None)
        if blob is not None:
            keys, counts = unpack_pairs(blob)
            open_[r] = keys, counts
            heapq.heappush(heap, (int(keys[-1]), r))

    for r in range(len(runs)):
        refill(r)
    while heap:
        last = heap[0][0]
        keys, counts = [], []
        for r, (k, c) in list(open_.items()):
            cut = int(np.searchsorted(k, last, "right"))
            if cut:
                keys.append(k[:cut])
                counts.append(c[:cut])
                open_[r] = k[cut:], c[cut:]
        while heap and heap[0][0] == last:
            r = heapq.heappop(heap)[1]
            del open_[r]
            refill(r)
        k = np.concatenate(keys)
        order = np.argsort(k, kind="stable")
        k, c = k[order], np.concatenate(counts)[order]
        first = np.flatnonzero(np.diff(k, prepend=~k[:1]) != 0)
        yield k[first], np.add.reduceat(c, first)


def _whole_blocks(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks joined to about ``PAIRS`` pairs, each ending where a B id ends."""
    keys, counts, n = [], [], 0
    for k, c in blocks:
        keys.append(k)
        counts.append(c)
        n += len(k)
        if n >= PAIRS:
            k, c = np.concatenate(keys), np.concatenate(counts)
            cut = int(np.searchsorted(k >> np.uint32(16), k[-1] >> np.uint32(16)))
            if cut:
                yield k[:cut], c[:cut]
            keys, counts, n = [k[cut:]], [c[cut:]], len(k) - cut
    if n:
        yield np.concatenate(keys), np.concatenate(counts)


RUNS = "radix int, chunk long, pairs array<binary>, records binary"
ROWS = "chunk long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " + RUNS.replace(", chunk long", "")


def _encode(path_a: str, path_b: str):
    """Batches of documents -> a row per document and, for each chunk and radix, a run."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        both = aligner(path_a, path_b)
        base, chunk = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []
        links: list[bytes] = []
        size = 0

        def made() -> Iterator[pd.DataFrame]:
            names = [c.split()[0] for c in ROWS.split(", ")]
            for kind, columns in ((rows, names[:8]), ([(base + chunk, *x) for x in _runs(links)], ["chunk", *names[8:]])):
                out = pd.DataFrame(kind, columns=columns, dtype=object)
                yield out.assign(**{c: None for c in names if c not in columns})[names]

        for batch in batches:
            for doc_id, text, aligned in _by_slab(batch, both):
                n_a, n_b, n, groups, found = aligned
                rows.append((base + chunk, len(rows), None if pd.isna(doc_id) else int(doc_id), n_a, n_b, n,
                             len(found) // 4, hashlib.sha256(groups).hexdigest() if n else ""))
                links.append(found)
                size += len(text or "")
                if size >= CHUNK_BYTES or len(rows) >= CHUNK_ROWS:
                    yield from made()
                    chunk, size = chunk + 1, 0
                    rows.clear()
                    links.clear()
        if rows:
            yield from made()

    return run


def _by_slab(batch: pd.DataFrame, both: Aligner) -> Iterator[tuple]:
    """(doc_id, text, alignment) of a batch's rows, some of which share the work on new words."""
    slab: list[tuple] = []
    size = 0
    for doc_id, text in zip(batch["doc_id"], batch["text"]):
        slab.append((doc_id, text))
        size += len(text or "")
        if size >= SLAB:
            yield from ((*row, x) for row, x in zip(slab, both.documents([t for _, t in slab])))
            slab, size = [], 0
    yield from ((*row, x) for row, x in zip(slab, both.documents([t for _, t in slab])))


def _runs(links: list[bytes]) -> Iterator[tuple[int, list[bytes], bytes]]:
    """(radix, blocks of pairs, records) of a chunk whose documents have these links."""
    sizes = np.array([len(x) // 4 for x in links])
    if not sizes.sum():
        return
    both = np.frombuffer(b"".join(links), "<u4").astype(np.uint64) << np.uint64(32)
    both |= np.repeat(np.arange(len(links), dtype=np.uint64), sizes)
    both.sort()
    first = np.flatnonzero(np.diff(both, prepend=~both[:1]) != 0)
    times = np.diff(first, append=len(both)).astype(np.uint32)
    keys, places = (both[first] >> np.uint64(32)).astype(np.uint32), both[first].astype(np.uint32).astype(np.uint16)
    del both
    radix = (keys >> np.uint32(16)) % np.uint32(RADIX)
    for r in range(RADIX):
        at = np.flatnonzero(radix == r)
        if len(at):
            k, c = keys[at], times[at]
            start = np.flatnonzero(np.diff(k, prepend=~k[:1]) != 0)
            pair, total = k[start], np.add.reduceat(c.astype(np.uint64), start)
            documents = np.diff(start, append=len(k)).astype(np.uint16)
            yield (r, [pack_pairs(pair[i:i + PAIRS], total[i:i + PAIRS]) for i in range(0, len(pair), PAIRS)],
                   _packed(pair, documents, places[at], c))


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """The runs of one radix and share -> one run."""
    blocks = [pack_pairs(k, c) for k, c in _whole_blocks(merge_runs([iter(list(x)) for x in rows["pairs"]]))]
    return pd.DataFrame([{"radix": rows["radix"][0], "chunk": rows["share"][0], "pairs": blocks}])


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """The last merge of a radix: blocks of pairs, counts and whether the count is its B id's highest."""
    out = []
    for k, c in _whole_blocks(merge_runs([iter(list(x)) for x in rows["pairs"]])):
        b = k >> np.uint32(16)
        start = np.flatnonzero(np.diff(b, prepend=~b[:1]) != 0)
        top = np.repeat(np.maximum.reduceat(c, start), np.diff(start, append=len(b)))
        out.append(pack_pairs(k, c, (c == top).astype(np.uint8)))
    return pd.DataFrame([{"radix": rows["radix"][0], "counts": out}])


def _contribute(runs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Runs of one radix and share beside the radix's counts -> (chunk, place, n_best, count_sum)."""
    out = []
    if len(runs) and len(counts):
        blocks = [unpack_pairs(x, "u1") for x in counts["counts"][0]]
        keys, total, best = (np.concatenate(x) for x in zip(*blocks))
        total = total.astype(np.int64)
        for chunk, blob in zip(runs["chunk"], runs["records"]):
            pair, documents, places, times = _unpacked(blob, "<u4", "<u2", "<u2", "<u4")
            at = np.repeat(np.searchsorted(keys, pair), documents)
            times = times.astype(np.int64)
            size = int(places.max()) + 1
            sums, bests = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(sums, places, times * total[at])
            np.add.at(bests, places, times * best[at])
            some = np.flatnonzero(sums)
            out.append(pd.DataFrame({"chunk": chunk, "place": some, "n_best": bests[some], "count_sum": sums[some]}))
    return pd.concat(out) if out else pd.DataFrame({"chunk": [], "place": [], "n_best": [], "count_sum": []})


def _shares(rows: DataFrame, runs: int) -> tuple[DataFrame, int]:
    """``rows`` with a ``share`` of about ``FAN`` of the ``runs`` that each radix has, and how many there are."""
    shares = max(1, -(-runs // FAN))
    return rows.withColumn("share", F.pmod(F.xxhash64("chunk"), F.lit(shares)).cast("long")), shares


def pair_counts(runs: DataFrame) -> DataFrame:
    """(radix, counts): blocks of each radix's pairs with their counts, merged from its runs."""
    now = runs.select("radix", "chunk", "pairs")
    left = now.select("chunk").distinct().count()
    while left > FAN:
        dealt, left = _shares(now, left)
        now = stored(dealt.groupBy("radix", "share").applyInPandas(_merge, "radix int, chunk long, pairs array<binary>"), "merged-runs")
    return now.groupBy("radix").applyInPandas(_count, "radix int, counts array<binary>")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Side A encodes a space and the text with a byte-level BPE vocabulary, side B
    the text with a sentencepiece model that adds the space; strings of special
    tokens are plain text.  Where both cut the bytes, a group ends; every pair of
    tokens with overlapping bytes is a link.  ``n_best`` counts the links whose
    pair is the most frequent one of its B id in the corpus (ties included),
    ``count_sum`` adds the corpus counts of all links.

    A text that is null, empty or not given back by a side's tokens has zeros and
    an empty digest.  Null doc_ids and repeated rows are kept and count as they
    stand; an empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spilled = stored(texts.mapInPandas(_encode(path_a, path_b), ROWS), "alignment-runs")
    rows = spilled.where("radix is null").drop("radix", "pairs", "records")
    runs = spilled.where("radix is not null").select("radix", "chunk", "pairs", "records")
    counts = stored(pair_counts(runs), "pair-counts")
    dealt, shares = _shares(runs.select("radix", "chunk", "records"), runs.select("chunk").distinct().count())
    copies = counts.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    given = dealt.groupBy("radix", "share").cogroup(copies.groupBy("radix", "share")).applyInPandas(
        _contribute, "chunk long, place int, n_best long, count_sum long")
    sums = given.groupBy("chunk", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    return rows.join(sums, ["chunk", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
