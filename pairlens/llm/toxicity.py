"""Toxicity scores from a bidirectional gated recurrent network, trained and run in numpy.

Each white-space token is one step.  Its word input is the evidence of the
word and a trained vector of the word's hash; its character input is the
evidence of its character 4- and 5-grams and the mean of trained 4-gram vectors.
Two gated recurrent passes read every window of ``WINDOW`` steps, attention
pools their states, and a logistic unit scores the window.  Windows overlap by
half and cover the whole text; a text's score is that of its worst window.

Labels are learned from at most ``POSITIVES`` + ``NEGATIVES`` labelled rows that
are not held out, chosen by a hash of doc_id (the whole texts of these rows).
Evidence is the lower confidence bound of the log odds that a word or n-gram
occurs in a toxic text; while the network trains, each part of the rows sees
the evidence of the other parts only.  After a first round on the windows with
the most evidence, further rounds train on each text's worst window so far.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are learned from, by class.
POSITIVES, NEGATIVES = 2_000, 6_000
WINDOW, STRIDE = 64, 32
HIDDEN = 8
BUCKETS = 1 << 18
WORD_ROWS, GRAM_ROWS, SIZE = 1 << 12, 1 << 11, 4
#: Standard errors by which the evidence is lowered.
SURE = 3.0
EPOCHS, BATCH, RATE = 3, 256, 0.01
#: Least steps of each round, whatever the number of windows.
STEPS = 150
#: Pull of the trained vectors towards zero.
DECAY = 1e-4
#: Rounds of picking windows, and parts of the rows for evidence.
PICKS, PARTS = 3, 4
#: Tokens a worker remembers, and windows it scores at a time.
TOKENS_KEPT, AT_ONCE = 150_000, 4096
#: A longer token is cut into steps of this many characters.
LONGEST = 48

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def steps(text: str | None) -> list[str]:
    """The tokens of a whole text; null or blank: none."""
    tokens = (text or "").split()
    if tokens and max(map(len, tokens)) > LONGEST:
        tokens = [t[i:i + LONGEST] for t in tokens for i in range(0, len(t), LONGEST)]
    return tokens


def hashed(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each token, its 4- and 5-gram buckets, and where each token's grams begin.

    Tokens are lower-cased and freed of what is not a letter or digit at both
    ends; a border sign stands before and after, so prefixes are grams too.
    """
    plain = []
    for t in tokens:
        t = t.lower()
        if not t.isalnum():
            a, b = 0, len(t)
            while a < b and not t[a].isalnum():
                a += 1
            while b > a and not t[b - 1].isalnum():
                b -= 1
            t = t[a:b]
        plain.append(t.encode("utf-8", "surrogatepass"))
    words = np.fromiter((zlib.crc32(t) for t in plain), np.int64, len(plain)) % BUCKETS
    data = np.frombuffer(b"".join(b"\x01" + t + b"\x02\0\0\0\0" for t in plain), np.uint8).astype(np.uint64)
    # A gram begins at each byte up to the end sign; none reaches into the next token.
    counts = np.fromiter(map(len, plain), np.int64, len(plain)) + 2
    begin = np.cumsum(counts) - counts
    places = np.arange(counts.sum()) + np.repeat(4 * np.arange(len(plain)), counts)
    n = max(0, len(data) - 4)
    four = np.zeros(n, np.uint64)
    for j in range(4):
        four = four * np.uint64(257) + data[j:j + n] + np.uint64(1)
    five = four * np.uint64(257) + data[4:4 + n] + np.uint64(1)
    mix = lambda x: ((x[places] * _FACTOR) >> np.uint64(64 - 18)).astype(np.int64)
    return words, mix(four), mix(five ^ np.uint64(0x5BD1E995)), begin


class Model:
    """Evidence tables and network weights; arrays by name, so that it travels as one binary."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.a)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as z:
            return Model({k: z[k] for k in z.files})

    def inputs(self, tokens: list[str], evidence: np.ndarray | None = None) -> np.ndarray:
        """The input vector of each token (word part, then character part)."""
        if not tokens:
            return np.zeros((0, 3 + 2 * SIZE), np.float32)
        word, four, five, begin = hashed(tokens)
        e = self.a["evidence"] if evidence is None else evidence
        grams = self.a["grams"][four % GRAM_ROWS]
        counts = np.diff(np.r_[begin, len(four)])[:, None]
        return np.concatenate([
            e[0][word][:, None], self.a["words"][word % WORD_ROWS],
            np.maximum.reduceat(e[1][four], begin)[:, None], np.maximum.reduceat(e[2][five], begin)[:, None],
            np.add.reduceat(grams, begin) / np.maximum(counts, 1)], axis=1).astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """(n, d) inputs -> (n, 2, 3 * HIDDEN): what both passes take from each input."""
        return (np.einsum("nd,kdh->nkh", x, self.a["W"]) + self.a["b"]).astype(np.float32)


def _passes(a: dict, p: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (2, steps, batch, HIDDEN) of both passes over p (2, steps, batch, 3 * HIDDEN)."""
    steps_, batch = p.shape[1:3]
    h = np.zeros((2, batch, HIDDEN), np.float32)
    out = np.empty((2, steps_, batch, HIDDEN), np.float32)
    gates, candidate = a["U"][:, :, :2 * HIDDEN], a["U"][:, :, 2 * HIDDEN:]
    for t in range(steps_):
        x = np.stack([p[0, t], p[1, steps_ - 1 - t]])
        on = np.stack([mask[t], mask[steps_ - 1 - t]])[:, :, None]
        g = 0.5 + 0.5 * np.tanh(0.5 * (x[:, :, :2 * HIDDEN] + h @ gates))
        z, r = g[:, :, :HIDDEN], g[:, :, HIDDEN:]
        c = h @ candidate
        n = np.tanh(x[:, :, 2 * HIDDEN:] + r * c)
        new = h + on * z * (n - h)
        if trace is not None:
            trace.append((h, z, r, c, n, on))
        h = new
        out[0, t], out[1, steps_ - 1 - t] = h[0], h[1]
    return out


def _pool(a: dict, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Attention pooling: (logit, context, weights, joined states)."""
    s = np.concatenate([states[0], states[1]], axis=2)
    e = s @ a["v"] + (mask - 1) * 1e4
    e = np.exp(e - e.max(0))
    w = e / e.sum(0)
    context = np.einsum("tb,tbh->bh", w, s)
    return context @ a["o"] + a["o0"], context, w, s


def logits(model: Model, p: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return _pool(model.a, _passes(model.a, p, mask), mask)[0]


def gradients(a: dict, p: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weighted log loss by backpropagation through both passes, and that of ``p``."""
    trace: list = []
    states = _passes(a, p, mask, trace)
    logit, context, w, s = _pool(a, states, mask)
    d = (1 / (1 + np.exp(-logit)) - y) * weight / len(y)
    g = {"o": context.T @ d, "o0": np.array(d.sum())}
    dc = np.outer(d, a["o"])
    de = w * (np.einsum("tbh,bh->tb", s, dc) - np.sum(context * dc, 1))
    g["v"] = np.einsum("tb,tbh->h", de, s)
    ds = w[:, :, None] * dc + de[:, :, None] * a["v"]
    steps_ = p.shape[1]
    dp, du = np.zeros_like(p), np.zeros_like(a["U"])
    gates, candidate = a["U"][:, :, :2 * HIDDEN], a["U"][:, :, 2 * HIDDEN:]
    dh = np.zeros_like(trace[0][0])
    for t in range(steps_ - 1, -1, -1):
        h, z, r, c, n, on = trace[t]
        dh = dh + np.stack([ds[t, :, :HIDDEN], ds[steps_ - 1 - t, :, HIDDEN:]])
        dn = dh * on * z * (1 - n * n)
        dz = dh * on * (n - h) * z * (1 - z)
        dr = dn * c * r * (1 - r)
        dg = np.concatenate([dz, dr], axis=2)
        dx = np.concatenate([dg, dn], axis=2)
        dp[0, t], dp[1, steps_ - 1 - t] = dx[0], dx[1]
        back = h.transpose(0, 2, 1)
        du[:, :, :2 * HIDDEN] += back @ dg
        du[:, :, 2 * HIDDEN:] += back @ (dn * r)
        dh = dh * (1 - on * z) + dg @ gates.transpose(0, 2, 1) + (dn * r) @ candidate.transpose(0, 2, 1)
    g["U"] = du
    return g, dp


def _evidence(texts: list[tuple[np.ndarray, ...]], labels: np.ndarray) -> np.ndarray:
    """(3, BUCKETS): lowered log odds of words, 4-grams and 5-grams, from the distinct ones of each text."""
    counts = np.zeros((2, 3, BUCKETS), np.float32)
    for features, label in zip(texts, labels):
        for k, f in enumerate(features):
            counts[int(label), k, f] += 1
    n = np.maximum(np.bincount(labels.astype(int), minlength=2), 1)
    pos, neg = counts[1] + 0.5, counts[0] + 0.5
    odds = np.log(pos / (n[1] + 1)) - np.log(neg / (n[0] + 1))
    return (np.maximum(odds - SURE * np.sqrt(1 / pos + 1 / neg), 0) / 2).astype(np.float32)


def _windows(n: int) -> list[tuple[int, int]]:
    """The overlapping windows of n steps; the last one ends with the text."""
    starts = range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else [0]
    return [(s, min(s + WINDOW, n)) for s in starts]


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Learn evidence and network from whole texts and their 0/1 labels; any number of either."""
    rng = np.random.default_rng(seed)
    inputs = 3 + 2 * SIZE
    a = {
        "evidence": np.zeros((3, BUCKETS), np.float32),
        "words": rng.normal(0, 0.05, (WORD_ROWS, SIZE)).astype(np.float32),
        "grams": rng.normal(0, 0.05, (GRAM_ROWS, SIZE)).astype(np.float32),
        "W": rng.normal(0, 0.3, (2, inputs, 3 * HIDDEN)).astype(np.float32),
        "b": np.zeros((2, 3 * HIDDEN), np.float32),
        "U": rng.normal(0, 0.3, (2, HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "v": rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32),
        "o": rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32),
        "o0": np.float32(-2.0),
    }
    model = Model(a)
    # Copies say nothing new.
    seen: dict[str, int] = {}
    for i, t in enumerate(texts):
        seen.setdefault(t or "", i)
    index = np.array(sorted(seen.values()), int)
    labels = np.asarray(labels, np.float32)[index] if len(index) else np.zeros(0, np.float32)
    one: dict[str, str] = {}  # each distinct token once in memory
    tokens = [[one.setdefault(w, w) for w in steps(texts[i])] for i in index]
    if not len(labels) or labels.min() == labels.max():
        a["o"][:] = 0
        a["o0"] = np.float32(2.0 if len(labels) and labels.max() == 1 else -2.0)
        return model
    features = []
    for t in tokens:
        word, four, five, _ = hashed(t) if t else (np.zeros(0, int),) * 4
        features.append(tuple(np.unique(f).astype(np.int32) for f in (word, four, five)))
    part = np.fromiter((zlib.crc32(" ".join(t[:WINDOW]).encode("utf-8", "surrogatepass")) % PARTS for t in tokens),
                       int, len(tokens))
    a["evidence"] = _evidence(features, labels)
    other = [_evidence([f for f, p in zip(features, part) if p != k], labels[part != k]) for k in range(PARTS)]
    del features
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in a.items() if k != "evidence"}
    at = 0
    for pick in range(PICKS):
        chosen: list[tuple[list[str], float, int, float]] = []
        values: list[np.ndarray | None] = [None] * len(tokens)
        for k in range(PARTS if pick else 0):
            own = np.flatnonzero(part == k)
            for i, v in zip(own, Scorer(Model(a | {"evidence": other[k]})).windows([tokens[i] for i in own])):
                values[i] = v
        for t, label, k, value in zip(tokens, labels, part, values):
            spans = _windows(len(t))
            if pick:
                best = [int(np.argmax(value))] if label else np.argsort(-value, kind="stable")[:2].tolist()
                sure = True
            else:
                e = model.inputs(t, other[k])[:, [0, 1 + SIZE, 2 + SIZE]].max(1) if t else np.zeros(0)
                sums = np.array([e[s:f].sum() for s, f in spans])
                best = [int(np.argmax(sums))]
                sure = sums[best[0]] > 0
            if not label:
                best.append(int(rng.integers(0, len(spans))))
            for w in best:
                # A toxic text's window without evidence may be clean: it counts little.
                chosen.append((t[spans[w][0]:spans[w][1]], label, k, 1.0 if not label or sure else 0.1))
        share = max(1.0, sum(1 - c[1] for c in chosen) / max(1, sum(c[1] for c in chosen)))
        tokens_used = Tokens(list(dict.fromkeys(w for c in chosen for w in c[0])), other)
        rows = [(tokens_used.numbers(c[0]), *c[1:]) for c in chosen]
        batch = min(BATCH, max(16, len(chosen) // 32))
        for _ in range(max(EPOCHS, -(-STEPS * batch // len(chosen)))):
            order = rng.permutation(len(chosen))
            for s in range(0, len(order), batch):
                at += 1
                _step(model, tokens_used, [rows[i] for i in order[s:s + batch]], share, moments, at)
    return model


class Tokens:
    """The tokens of the windows that are trained on: their buckets and, for each part, their evidence."""

    def __init__(self, tokens: list[str], other: list[np.ndarray]):
        self.number = {t: i for i, t in enumerate(tokens)}
        if not tokens:
            tokens = [""]
        self.word, self.four, five, self.begin = hashed(tokens)
        self.counts = np.diff(np.r_[self.begin, len(self.four)])
        self.evidence = np.stack([np.stack([
            e[0][self.word], np.maximum.reduceat(e[1][self.four], self.begin),
            np.maximum.reduceat(e[2][five], self.begin)], axis=1) for e in other])
        self.word, self.four = self.word % WORD_ROWS, self.four % GRAM_ROWS

    def numbers(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))


def _step(model: Model, tokens: Tokens, rows: list, share: float, moments: dict, at: int) -> None:
    """One Adam step on a batch of windows (token numbers, label, part, weight)."""
    a = model.a
    flat = np.concatenate([r[0] for r in rows])
    owner = np.repeat([r[2] for r in rows], [len(r[0]) for r in rows])
    own, back = np.unique(flat, return_inverse=True)
    n = tokens.counts[own]
    starts = np.cumsum(n) - n
    grams = tokens.four[np.arange(n.sum()) + np.repeat(tokens.begin[own] - starts, n)]
    mean = np.add.reduceat(a["grams"][grams], starts) / n[:, None] if len(own) else np.zeros((0, SIZE))
    e = tokens.evidence[owner, flat]
    x = np.concatenate([e[:, :1], a["words"][tokens.word[flat]], e[:, 1:], mean[back]], axis=1).astype(np.float32)
    sizes = np.array([len(r[0]) for r in rows])
    b = np.repeat(np.arange(len(rows)), sizes)
    t = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    longest = max(1, int(sizes.max()))
    mask = np.zeros((longest, len(rows)), np.float32)
    mask[t, b] = 1
    p = np.zeros((2, longest, len(rows), 3 * HIDDEN), np.float32)
    p[:, t, b] = model.project(x).transpose(1, 0, 2)
    y = np.array([r[1] for r in rows], np.float32)
    weight = np.array([r[3] for r in rows], np.float32) * np.where(y == 1, np.sqrt(share), 1)
    g, dp = gradients(a, p, mask, y, weight.astype(np.float32))
    dflat = dp[:, t, b]
    g["b"] = dflat.sum(1)
    g["W"] = np.einsum("nd,knh->kdh", x, dflat)
    dx = np.einsum("knh,kdh->nd", dflat, a["W"])
    g["words"], g["grams"] = DECAY * a["words"], DECAY * a["grams"]
    if len(flat):
        np.add.at(g["words"], tokens.word[flat], dx[:, 1:1 + SIZE])
        each = np.zeros((len(own), SIZE), np.float32)
        np.add.at(each, back, dx[:, 3 + SIZE:])
        np.add.at(g["grams"], grams, np.repeat(each / n[:, None], n, axis=0))
    for k, grad in g.items():
        m, v = moments[k]
        m, v = moments[k] = (0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad)
        a[k] = (a[k] - RATE * (m / (1 - 0.9**at)) / (np.sqrt(v / (1 - 0.999**at)) + 1e-8)).astype(np.float32)


class Scorer:
    """Scores texts; remembers what the two passes take from each token."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, 2, 3 * HIDDEN), np.float32)

    def _learn(self, tokens: list[str]) -> None:
        new = [t for t in dict.fromkeys(tokens) if t not in self.rows]
        if not new:
            return
        if len(self.rows) + len(new) > TOKENS_KEPT and self.rows:
            self.forget()
            new = list(dict.fromkeys(tokens))
        first = len(self.rows)
        if first + len(new) > len(self.table):
            size = max(first + len(new), min(2 * len(self.table), TOKENS_KEPT))
            more = np.zeros((size, 2, 3 * HIDDEN), np.float32)
            more[:first] = self.table[:first]
            self.table = more
        self.table[first:first + len(new)] = self.model.project(self.model.inputs(new))
        self.rows.update(zip(new, range(first, first + len(new))))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), -np.inf)
        group: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            group.append((i, steps(text)))
            size += len(group[-1][1])
            if size >= AT_ONCE * STRIDE:
                self._group(group, out)
                group, size = [], 0
        self._group(group, out)
        return 1 / (1 + np.exp(-out))

    def windows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The logit of each window of each text, given as tokens."""
        out, group, size = [], [], 0
        for i, tokens in enumerate(texts):
            group.append((i, tokens))
            size += len(tokens)
            if size >= AT_ONCE * STRIDE or i + 1 == len(texts):
                counts = [len(_windows(len(t))) for _, t in group]
                flat = np.zeros(sum(counts))
                self._group(group, flat, each=True)
                out += np.split(flat, np.cumsum(counts)[:-1])
                group, size = [], 0
        return out

    def _group(self, group: list[tuple[int, list[str]]], out: np.ndarray, each: bool = False) -> None:
        if not group:
            return
        flat = [t for _, tokens in group for t in tokens]
        # Very long texts go through in pieces, so the memory of tokens stays bounded.
        rows = np.empty(len(flat), np.int64)
        tables = []
        for s in range(0, len(flat), TOKENS_KEPT // 2):
            part = flat[s:s + TOKENS_KEPT // 2]
            self._learn(part)
            rows[s:s + len(part)] = np.fromiter(map(self.rows.__getitem__, part), np.int64, len(part))
            tables.append((s, s + len(part), self.table))
        begin = np.cumsum([0] + [len(t) for _, t in group])
        spans = [(k, begin[k] + s, begin[k] + f) for k, (_, t) in enumerate(group) for s, f in _windows(len(t))]
        for s in range(0, len(spans), AT_ONCE):
            now = spans[s:s + AT_ONCE]
            lo = np.array([x[1] for x in now])
            sizes = np.array([x[2] for x in now]) - lo
            longest = max(1, int(sizes.max()))
            place = np.arange(longest)[:, None] + lo[None, :]
            mask = (np.arange(longest)[:, None] < sizes[None, :]).astype(np.float32)
            place = np.minimum(place, max(0, len(flat) - 1))
            p = np.zeros((2, longest, len(now), 3 * HIDDEN), np.float32)
            if len(flat):
                if len(tables) == 1:
                    p[:] = self.table[rows[place]].transpose(2, 0, 1, 3)
                else:
                    for a, b, table in tables:
                        inside = (place >= a) & (place < b)
                        p[:, inside] = table[rows[place[inside]]].transpose(1, 0, 2)
            got = logits(self.model, p, mask)
            if each:
                out[s:s + len(now)] = got
            else:
                np.maximum.at(out, [group[x[0]][0] for x in now], got)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows that are learned from: a bounded, fixed choice."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id"))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (known.where("toxic = 1").orderBy(*order).limit(POSITIVES)
              .union(known.where("toxic = 0").orderBy(*order).limit(NEGATIVES)))
    # Broadcast bound: POSITIVES + NEGATIVES rows of two numbers.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(chosen), "doc_id")


def held_out(column: str):
    """Whether crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> bytes:
    """The trained model as one binary (under two megabytes).

    One task trains on the bounded choice of rows; without labelled rows, or
    with one class only, the model gives every text the same score.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"])
        return pd.DataFrame({"model": [train(group["text"].fillna("").tolist(), group["toxic"].to_numpy()).dump()]})

    rows = training_rows(docs, labels).withColumn("one", F.lit("one"))
    got = rows.groupBy("one").applyInPandas(run, "model binary").first()
    return bytes(got[0]) if got else train([], np.zeros(0)).dump()


_LOADED: dict[int, Scorer] = {}


def _scorer(model: bytes) -> Scorer:
    """The scorer of ``model``, kept by the worker process."""
    key = zlib.crc32(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Scorer(Model.load(model))
    return _LOADED[key]


def score_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; nothing but the text is scored.

    A null, empty or blank text has the score of a window without steps.  Null
    ids count as not held out; repeated rows are scored alike; an empty table
    gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(shared.value)
        for batch in batches:
            s = scorer.scores(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": s,
                                "predicted": (s >= 0.5).astype("int32")})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       held_out("doc_id").alias("held_out")) \
        .mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: bytes) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array(scorer.scores(texts) < 0.5))

    return docs.mapInArrow(run, docs.schema)
