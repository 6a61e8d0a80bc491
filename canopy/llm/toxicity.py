"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word is the sum of a learned vector of the word and the mean of learned
vectors of its character n-grams (3 to 5, with word borders), both by hashing.
Every pre-token but white space is a word: letters, numbers, marks and signs.
One of more than 24 bytes is a word for each of its overlapping pieces.
Windows of 32 words, each overlapping the next by 8, cover the whole text; a
window's states in both directions are pooled by attention to one logit.  The highest
logits of all windows, and past the recurrent layers the highest log odds of a single
word, give the text's probability; their weights are fitted on texts that the network
hasn't learned from, so where few labels are known the words' odds count for more.

Null texts and texts without words get the score of an empty window.  Without
labelled rows every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm import learn, pretokens
from canopy.llm.common import blank_null, chunks, release, table

WINDOW, STRIDE = 32, 24
SIZE, STATE = 8, 8
SIZES = (3, 4, 5)
#: Buckets that n-grams are hashed to; the share of the rarer label's training texts that a word and an n-gram must be in to get a vector (two texts at least).
BUCKETS = 1 << 20
WORD_SHARE, GRAM_SHARE = 0.03, 0.04
#: Bytes of a word at most, and from one piece of a longer pre-token to the next: any 13 bytes of it are in one piece.
WORD_BYTES, PIECE_STEP = 24, 12
#: Texts of average toxicity that are added to the counts of each word and n-gram.
PRIOR = 10
#: Plain learning rate of the vectors.
VECTOR_RATE = 0.5
#: Training: texts of each label; passes over the windows; in the first ones all windows of a toxic text count as toxic, then its worst.
PER_CLASS = 1000
EPOCHS, WARM, BATCH, RATE = 8, 1, 256, 0.02
#: Windows whose logits tell a text's probability.
TOP = 3
#: Windows of a clean text in a later pass: the worst of so many parts.
CLEAN_SHARE = 3
MODULUS, HELD = 4, 2
THRESHOLD = 0.3
#: Words whose n-grams are in memory at a time.
WORDS_AT_ONCE = 4096
#: Distinct words whose gate inputs a worker remembers.
WORDS_KEPT = 150_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(words: list[bytes]) -> np.ndarray:
    """Hash buckets of each lower-case word's n-grams; 0 fills the rows."""
    spelled = [b"\x02" + w + b"\x03" for w in words]
    width = max(max(map(len, spelled), default=0), max(SIZES))
    return np.concatenate([_gram_block(spelled[a : a + WORDS_AT_ONCE], width) for a in range(0, max(1, len(words)), WORDS_AT_ONCE)])


def _gram_block(words: list[bytes], width: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in words), np.uint8).reshape(len(words), width).astype(np.uint64)
    lengths = np.array([len(s) for s in words], np.int64)[:, None]
    buckets = []
    for n in SIZES:
        h = np.full((len(words), width - n + 1), n, np.uint64)
        for k in range(n):
            h = (h + flat[:, k : width - n + 1 + k] + np.uint64(1)) * _MIX
            h ^= h >> np.uint64(29)
        h = (h % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
        buckets.append(np.where(np.arange(width - n + 1) <= lengths - n, h, 0))
    return np.concatenate(buckets, axis=1)


class Features:
    """Words and n-grams that enough training texts have; row 0 stands for all others and has no vector."""

    def __init__(self, words: dict[bytes, int], grams: np.ndarray):
        self.words, self.grams = words, grams

    @classmethod
    def learn(cls, words: list[bytes], index: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> tuple[Features, np.ndarray, np.ndarray]:
        """The features of a training set with the log odds of each word and each n-gram."""
        pairs = np.unique(np.stack([index, doc], axis=1), axis=0)
        buckets = gram_buckets(words)
        toxic = labels[pairs[:, 1]] == 1
        share = labels.mean()

        def shrunk(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
            odds = np.log((bad + PRIOR * share) / (good + PRIOR * (1 - share)) * (1 - share) / share)
            return np.clip(odds, -3, 3).astype(np.float32)

        total = np.bincount(pairs[:, 0], minlength=len(words))
        bad = np.bincount(pairs[toxic, 0], minlength=len(words))
        rate = shrunk(bad, total - bad)
        rarer = min(labels.sum(), len(labels) - labels.sum())
        kept = np.flatnonzero(total >= max(2, round(WORD_SHARE * rarer)))
        table_ = {words[k]: n + 1 for n, k in enumerate(kept)}
        pairs = pairs[np.argsort(pairs[:, 1], kind="stable")]
        counts = np.zeros((2, BUCKETS), np.int64)
        for a in range(0, len(labels), 50):  # a text counts once for each of its n-grams
            low, high = np.searchsorted(pairs[:, 1], [a, a + 50])
            wide = buckets[pairs[low:high, 0]]
            both = np.unique((pairs[low:high, 1][:, None] * BUCKETS + wide)[wide > 0])
            for y in (0, 1):
                counts[y] += np.bincount(both[labels[both // BUCKETS] == y] % BUCKETS, minlength=BUCKETS)
        gram_total, gram_rate = counts.sum(axis=0), shrunk(counts[1], counts[0])
        good = np.flatnonzero(gram_total >= max(2, round(GRAM_SHARE * rarer)))
        grams = np.zeros(BUCKETS, np.int32)
        grams[good] = np.arange(1, len(good) + 1)
        return cls(table_, grams), np.append(0, rate[kept]).astype(np.float32), np.append(0, gram_rate[good]).astype(np.float32)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of each word and of its n-grams, and how many n-grams it has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros((0, 1), np.int32), np.zeros(0, np.int64)
        buckets = gram_buckets(words)
        row = np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))
        return row, self.grams[buckets], (buckets > 0).sum(axis=1)


class Recurrent:
    def __init__(self, weights: dict[str, np.ndarray], features: Features):
        self.w, self.features = weights, features

    @classmethod
    def new(cls, seed: int = 11) -> Recurrent:
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        w = {"word": np.zeros((1, SIZE), np.float32), "gram": np.zeros((1, SIZE), np.float32)}
        for side in "fb":
            w |= {f"in_{side}": draw(SIZE, 3 * STATE, scale=SIZE**-0.5), f"bias_{side}": np.zeros(3 * STATE, np.float32), f"state_{side}": draw(STATE, 3 * STATE, scale=STATE**-0.5)}
        w["odds"] = np.zeros(1, np.float32)
        w |= {"look": draw(2 * STATE, 2 * STATE, scale=0.25), "pick": draw(2 * STATE, scale=0.25), "out": draw(2 * STATE, scale=0.25), "out_b": np.zeros(1, np.float32)}
        return cls(w, Features({}, np.zeros(BUCKETS, np.int32)))

    def vectors(self, word: np.ndarray, grams: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = self.w["word"][word]
        for a in range(0, len(word), WORDS_AT_ONCE):
            some = slice(a, a + WORDS_AT_ONCE)
            out[some] += self.w["gram"][grams[some]].sum(axis=1) / np.sqrt(np.maximum(count[some], 1))[:, None].astype(np.float32)
        return out

    def word_vectors(self, words: list[bytes]) -> np.ndarray:
        """Vectors of new words, a block at a time."""
        blocks = [self.vectors(*self.features.of(words[a : a + WORDS_AT_ONCE])) for a in range(0, len(words), WORDS_AT_ONCE)]
        return np.concatenate(blocks) if blocks else np.zeros((0, SIZE), np.float32)

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Input part of all gates in both directions; the last row is for places without a word."""
        x = np.concatenate([x, np.zeros((1, SIZE), np.float32)])
        return {s: x @ self.w[f"in_{s}"] + self.w[f"bias_{s}"] for s in "fb"}

    def states(self, gates: dict[str, np.ndarray], index: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (window, place, both directions); ``index`` has the gates' row of each place, -1 for none."""
        n, t = index.shape
        out = np.empty((n, t, 2 * STATE), np.float32)
        for side, order, at in (("f", range(t), 0), ("b", range(t - 1, -1, -1), STATE)):
            h = np.zeros((n, STATE), np.float32)
            u = self.w[f"state_{side}"]
            for k in order:
                g = gates[side][index[:, k]]
                real = (index[:, k] >= 0)[:, None].astype(np.float32)
                r = h @ u
                zr = learn.sigmoid(g[:, : 2 * STATE] + r[:, : 2 * STATE])
                z, reset = zr[:, :STATE] * real, zr[:, STATE:]
                c = np.tanh(g[:, 2 * STATE :] + reset * r[:, 2 * STATE :])
                if keep is not None:
                    keep.append((side, k, h, z, reset, c, r[:, 2 * STATE :], real, zr[:, :STATE]))
                h = h + z * (c - h)
                out[:, k, at : at + STATE] = h
        return out

    def pool(self, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, ...]:
        look = np.tanh(states @ self.w["look"])
        logit = np.where(real, look @ self.w["pick"], np.float32(-30))
        share = np.exp(logit - logit.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        context = (share[:, :, None] * states).sum(axis=1)
        return context @ self.w["out"] + self.w["out_b"], context, share, look

    def logits(self, gates: dict[str, np.ndarray], index: np.ndarray) -> np.ndarray:
        out = np.empty(len(index), np.float32)
        for a in range(0, len(index), 4096):
            some = index[a : a + 4096]
            out[a : a + 4096] = self.pool(self.states(gates, some), some >= 0)[0]
        return out

    def gradients(self, feats: tuple[np.ndarray, np.ndarray, np.ndarray], index: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        used, local = np.unique(index, return_inverse=True)
        local = local.reshape(index.shape)
        if used[0] < 0:
            used, local = used[1:], local - 1
        word, grams, count = (f[used] for f in feats)
        x = self.vectors(word, grams, count)
        gates = self.gates(x)
        keep: list = []
        states = self.states(gates, local, keep)
        score, context, share, look = self.pool(states, local >= 0)
        error = ((learn.sigmoid(score) - labels) * weight / len(labels)).astype(np.float32)
        w, grad = self.w, {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["out"], grad["out_b"] = error @ context, np.array([error.sum()], np.float32)
        to_context = error[:, None] * w["out"]
        to_share = (states * to_context[:, None, :]).sum(axis=2)
        to_logit = share * (to_share - (share * to_share).sum(axis=1, keepdims=True))
        grad["pick"] = np.einsum("nt,ntk->k", to_logit, look)
        to_look = to_logit[:, :, None] * w["pick"] * (1 - look * look)
        grad["look"] = np.einsum("nti,ntj->ij", states, to_look, optimize=True)
        to_states = share[:, :, None] * to_context[:, None, :] + to_look @ w["look"].T
        to_gates = {s: np.zeros_like(gates[s]) for s in "fb"}
        carry = {s: np.zeros((len(index), STATE), np.float32) for s in "fb"}
        for side, k, h, z, reset, c, rc, real, zfull in reversed(keep):
            at = 0 if side == "f" else STATE
            d = to_states[:, k, at : at + STATE] + carry[side]
            dz = d * (c - h) * real * zfull * (1 - zfull)
            dc = d * z * (1 - c * c)
            dr = dc * rc * reset * (1 - reset)
            first = np.concatenate([dz, dr, dc], axis=1)
            second = np.concatenate([dz, dr, dc * reset], axis=1)
            np.add.at(to_gates[side], local[:, k], first)
            grad[f"state_{side}"] += h.T @ second
            carry[side] = d * (1 - z) + second @ w[f"state_{side}"].T
        to_x = np.zeros_like(x)
        for side in "fb":
            g = to_gates[side]
            grad[f"bias_{side}"] = g.sum(axis=0)
            grad[f"in_{side}"] = x.T @ g[:-1]
            to_x += g[:-1] @ w[f"in_{side}"].T
        share_x = to_x / np.sqrt(np.maximum(count, 1))[:, None]
        flat, per = grams.ravel(), grams.shape[1]
        for k in range(SIZE):
            grad["word"][:, k] = np.bincount(word, to_x[:, k], len(w["word"]))
            grad["gram"][:, k] = np.bincount(flat, np.repeat(share_x[:, k], per), len(w["gram"]))
        grad["word"][0] = grad["gram"][0] = 0
        return grad

    def fit(self, texts: list[str], labels: np.ndarray, prior: float, seed: int = 11) -> Recurrent:
        """Learn the network on three quarters of the texts, and on the rest how window logits tell a text's probability.

        ``prior`` is the share of toxic texts where the sample comes from.
        """
        if len(labels) < 8 or labels.min() == labels.max():
            self.w["text"] = np.array([0] * (TOP + 1) + [-40], np.float32)
            return self
        rest = np.arange(len(labels)) % 4 == 3
        self._fit_windows([t for t, r in zip(texts, rest) if not r], labels[~rest], seed)
        data, ends = pretokens.text_buffers(pa.array([t for t, r in zip(texts, rest) if r]))
        words, index, doc = text_words(data, ends)
        windows, owner = windows_of(index, doc, int(rest.sum()))
        top = top_logits(self.logits(self.gates(self.word_vectors(words)), windows), owner, int(rest.sum()))
        x = np.column_stack([top, self.strongest(words, index, doc, int(rest.sum())), np.ones(int(rest.sum()))])
        y = labels[rest]
        weight = np.where(y == 1, prior / max(y.mean(), 1e-6), (1 - prior) / max(1 - y.mean(), 1e-6))
        a = np.zeros(TOP + 2)
        for _ in range(50):  # Newton steps of a logistic regression, slightly shrunk
            p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
            slope = x.T @ (weight * (p - y)) + 0.1 * a
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(TOP + 2)
            a -= np.clip(np.linalg.solve(curve, slope), -2, 2)
        self.w["text"] = a.astype(np.float32)
        return self

    def strongest(self, words: list[bytes], index: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
        """Each text's highest log odds of a word, past the recurrent layers; 0 without any."""
        row = np.fromiter((self.features.words.get(w, 0) for w in words), np.int64, len(words))
        out = np.zeros(texts, np.float32)
        np.maximum.at(out, doc, self.w["odds"][row[index]])
        return out

    def _fit_windows(self, texts: list[str], labels: np.ndarray, seed: int) -> None:
        data, ends = pretokens.text_buffers(pa.array(texts))
        words, index, doc = text_words(data, ends)
        self.features, word_odds, gram_odds = Features.learn(words, index, doc, labels)
        self.w["odds"] = word_odds.copy()
        random = np.random.default_rng(seed)
        for channel, (name, odds) in enumerate((("word", word_odds), ("gram", gram_odds))):
            self.w[name] = (random.standard_normal((len(odds), SIZE)) * 0.05).astype(np.float32)
            self.w[name][:, :2] = 0
            self.w[name][:, channel] = odds  # one channel each starts from the counts
            self.w[name][0] = 0
        feats = self.features.of(words)
        windows, owner = windows_of(index, doc, len(texts))
        toxic = labels[owner] == 1
        part = np.arange(len(windows)) % CLEAN_SHARE
        adam = learn.Adam(self.w, RATE, {"word": VECTOR_RATE, "gram": VECTOR_RATE})
        for epoch in range(EPOCHS):
            adam.rate = RATE * (1 - epoch / EPOCHS)
            chosen = np.flatnonzero(toxic | (part == epoch % CLEAN_SHARE))
            if epoch >= WARM:  # only its worst window is known to be toxic; clean texts give the likeliest mistakes
                found = self.logits(self.gates(self.vectors(*feats)), windows)
                group = owner * CLEAN_SHARE + np.where(toxic, 0, part)
                rank = np.lexsort((-found, group))
                chosen = rank[np.concatenate([[True], group[rank][1:] != group[rank][:-1]])]
            y = labels[owner[chosen]]
            weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
            order = random.permutation(len(chosen))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                adam.update(self.gradients(feats, windows[chosen[some]], y[some], weight[some]))


def top_logits(logits: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """The highest window logits of each text in descending order, within [-8, 8]; -8 where it has fewer windows."""
    out = np.full((texts, TOP), -8.0, np.float32)
    order = np.lexsort((-logits, owner))
    owned = owner[order]
    place = np.arange(len(order)) - np.searchsorted(owned, owned)
    some = place < TOP
    out[owned[some], place[some]] = np.clip(logits[order][some], -8, 8)
    return out


def pieces(word: bytes) -> list[bytes]:
    """The word, or the overlapping pieces that a longer pre-token is read by."""
    if len(word) <= WORD_BYTES:
        return [word]
    return [word[a : a + WORD_BYTES] for a in range(0, len(word) - WORD_BYTES + PIECE_STEP, PIECE_STEP)]


def text_words(data: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct lower-case words, and for each word of the texts its index there and its text."""
    starts = pretokens.split(data, ends)
    tokens, index = pretokens.words_of(data, starts)
    place: dict[bytes, int] = {}
    rows: list[int] = []
    many = np.zeros(len(tokens), np.int64)
    for k, token in enumerate(tokens.to_pylist()):
        word = token.decode().strip().lower()
        if word:
            parts = pieces(word.encode())
            rows += [place.setdefault(p, len(place)) for p in parts]
            many[k] = len(parts)
    if not len(index):
        return [b""], np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = many[index]
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = np.array(rows, np.int64)[np.repeat((np.cumsum(many) - many)[index], count) + within]
    doc = np.searchsorted(ends, starts, side="right") - 1
    return list(place) or [b""], at, np.repeat(doc, count)


def windows_of(index: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices of all windows (-1 after a text's end) and each window's text; every text has one at least."""
    count = np.bincount(doc, minlength=texts)
    many = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(texts), many)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    at = (within * STRIDE)[:, None] + np.arange(WINDOW)
    real = at < count[owner][:, None]
    begin = (np.cumsum(count) - count)[owner][:, None]
    padded = np.append(index, -1)
    return np.where(real, padded[np.where(real, begin + at, len(index))], -1), owner


class Scorer:
    """A network with the gate inputs of the words seen so far."""

    def __init__(self, model: Recurrent):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.rows = {s: np.zeros((0, 3 * STATE), np.float32) for s in "fb"}

    def scores(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        texts = len(ends) - 1
        if not texts:
            return np.zeros(0, np.float32)
        words, index, doc = text_words(data, ends)
        if len(self.place) + len(words) > WORDS_KEPT:
            self.clear()
        new = [w for w in words if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            made = self.model.gates(self.model.word_vectors(new))
            self.rows = {s: np.concatenate([self.rows[s], made[s][:-1]]) for s in "fb"}
        none = self.model.gates(np.zeros((0, SIZE), np.float32))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        gates = {s: np.concatenate([self.rows[s][at], none[s]]) for s in "fb"}
        windows, owner = windows_of(index, doc, texts)
        top = top_logits(self.model.logits(gates, windows), owner, texts)
        weights = self.model.w["text"]
        strongest = self.model.strongest(words, index, doc, texts)
        return learn.sigmoid((top * weights[:TOP]).sum(axis=1) + weights[TOP] * strongest + weights[TOP + 1])


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", modulus: int = MODULUS, held: int = HELD) -> Recurrent:
    network = Recurrent.new().fit(*learn.training_rows(docs, labels, target, modulus, held, PER_CLASS))
    release()
    return network


def score(docs: DataFrame, network: Recurrent, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the probability of being toxic as ``name`` (double)."""
    names = [f"c{k}" for k in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Scorer(network)
        for part in chunks(batches, "_text", 2 << 20):
            found = model.scores(*pretokens.text_buffers(part.column("_text")))
            yield pa.record_batch([*part.columns[:-1], pa.array(found.astype(np.float64))], [*names, "_score"])
        del model
        release()

    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], blank_null(text_col).alias("_text"))
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))
    made = rows.mapInArrow(run, f"{fields}, _score double")
    return made.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)], F.col("_score").alias(name))


def op10_toxicity_bigru(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), network)
    return scored.select("doc_id", (learn.fold("doc_id", MODULUS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
