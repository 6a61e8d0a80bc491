"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes get a learned embedding and one channel that tells whether the
last bytes repeat what stood a few bytes before.  Learned filters slide over all
bytes; their activations are max-pooled in chunks of 512 bytes that overlap by
half and cover the whole text.  The mean and the maximum over all chunks go
through a small hidden layer to one probability.

Null and empty texts are one chunk of padding and get a score like any other.
Equal texts have equal scores.  Without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm import learn, pretokens
from canopy.llm.common import blank_null, chunks, release, table

HOP = 256  # half a chunk
WIDTH, STRIDE, CHANNELS, FILTERS, HIDDEN = 12, 4, 8, 16, 16
#: Longest distance of a repeat, and the equal bytes that make one.
LAG, RUN = 32, 8
#: Training: passes, texts in a step, hops of one text in a step, learning rate.
EPOCHS, BATCH, HOPS, RATE = 12, 48, 16, 0.01
MODULUS, HELD = 3, 1
THRESHOLD = 0.5
_GAP = LAG + RUN


def layout(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts on whole hops with zeros between them, and each text's first hop (``n + 1`` values)."""
    sizes = np.diff(ends)
    hops = (sizes + _GAP + HOP - 1) // HOP
    first = np.concatenate([[0], np.cumsum(hops)])
    out = np.zeros(int(first[-1]) * HOP + WIDTH, np.uint8)
    if len(data):
        out[np.repeat(first[:-1] * HOP - ends[:-1], sizes) + np.arange(len(data))] = data
    return out, first


def repeats(data: np.ndarray) -> np.ndarray:
    """1 where the last ``RUN`` bytes stood before at one of the distances up to ``LAG``."""
    found = np.zeros(len(data), bool)
    for lag in range(2, LAG + 1):
        same = data[lag:] == data[:-lag]
        for step in (1, 2, 4):
            same[step:] &= same[:-step].copy()
            same[:step] = False
        found[lag:] |= same
    return found & (data != 0)


class ByteNetwork:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def new(cls, seed: int = 7) -> ByteNetwork:
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            {
                "embed": draw(256, CHANNELS - 1, scale=0.5),
                "conv": draw(WIDTH * CHANNELS, FILTERS, scale=(2 / (WIDTH * CHANNELS)) ** 0.5),
                "conv_b": np.zeros(FILTERS, np.float32),
                "hidden": draw(2 * FILTERS, HIDDEN, scale=(1 / FILTERS) ** 0.5),
                "hidden_b": np.zeros(HIDDEN, np.float32),
                "out": draw(HIDDEN, scale=HIDDEN**-0.5),
                "out_b": np.zeros(1, np.float32),
            }
        )

    def _inputs(self, data: np.ndarray) -> np.ndarray:
        embed = self.w["embed"].copy()
        embed[0] = 0
        x = np.empty((len(data), CHANNELS), np.float32)
        np.take(np.concatenate([embed, np.zeros((256, 1), np.float32)], axis=1), data, axis=0, out=x)
        x[:, -1] = repeats(data)
        return x

    def _windows(self, x: np.ndarray, first: int, count: int) -> np.ndarray:
        step = x.strides[0]
        return np.lib.stride_tricks.as_strided(x[first * STRIDE :], (count, WIDTH * CHANNELS), (STRIDE * step, x.strides[1]))

    def hops(self, data: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Each hop's largest activation of every filter, and where it is."""
        x = self._inputs(data)
        per = HOP // STRIDE
        n = (len(data) - WIDTH) // HOP
        best, place = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if where else None
        for a in range(0, n, 256):  # keeps the copied windows in cache
            b = min(n, a + 256)
            act = (self._windows(x, a * per, (b - a) * per) @ self.w["conv"]).reshape(b - a, per, FILTERS)
            best[a:b] = act.max(axis=1)
            if where:
                place[a:b] = act.argmax(axis=1) + np.arange(a, b)[:, None] * per
        return np.maximum(best + self.w["conv_b"], 0), place, x

    def scores(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        if len(ends) == 1:
            return np.zeros(0, np.float32)
        padded, first = layout(data, ends)
        pooled, _, _ = self.hops(padded)
        chunk, _ = self._chunks(pooled, first)
        return self._head(self._features(chunk, first))[0]

    @staticmethod
    def _chunks(pooled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each hop and the next one of its text, and which of the two has it."""
        other = np.minimum(np.arange(1, len(pooled) + 1), np.repeat(first[1:] - 1, np.diff(first)))
        right = pooled[other] > pooled
        return np.where(right, pooled[other], pooled), np.where(right, other[:, None], np.arange(len(pooled))[:, None])

    @staticmethod
    def _features(chunk: np.ndarray, first: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(chunk.astype(np.float64), first[:-1]) / np.diff(first)[:, None]
        return np.concatenate([mean.astype(np.float32), np.maximum.reduceat(chunk, first[:-1])], axis=1)

    def _head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # row by row, so that a text's score doesn't depend on its batch
        hidden = np.maximum((features[:, :, None] * self.w["hidden"]).sum(axis=1) + self.w["hidden_b"], 0)
        return learn.sigmoid((hidden * self.w["out"]).sum(axis=1) + self.w["out_b"]), hidden

    def fit(self, texts: list[str], labels: np.ndarray, seed: int = 7) -> ByteNetwork:
        """Learn by logistic loss; of a long text each step sees one random run of hops."""
        if not len(labels) or labels.min() == labels.max():
            self.w["out"][:] = 0
            return self
        random = np.random.default_rng(seed)
        raw = [t.encode() for t in texts]
        weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
        adam = learn.Adam(self.w, RATE)
        for epoch in range(EPOCHS):
            adam.rate = RATE * (1 - epoch / EPOCHS)
            order = random.permutation(len(raw))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                pieces = []
                for i in some:
                    room = max(0, len(raw[i]) - HOPS * HOP)
                    start = int(random.integers(0, room + 1))
                    pieces.append(raw[i][start : start + HOPS * HOP])
                data = np.frombuffer(b"".join(pieces), np.uint8)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
                adam.update(self._gradients(data, ends, labels[some], weight[some]))
        return self

    def _gradients(self, data: np.ndarray, ends: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        padded, first = layout(data, ends)
        pooled, place, x = self.hops(padded, where=True)
        chunk, chosen = self._chunks(pooled, first)
        features = self._features(chunk, first)
        score, hidden = self._head(features)
        error = ((score - labels) * weight / len(labels)).astype(np.float32)
        back = error[:, None] * w["out"] * (hidden > 0)
        to_features = back @ w["hidden"].T
        to_chunk = np.repeat(to_features[:, :FILTERS] / np.diff(first)[:, None], np.diff(first), axis=0)
        for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
            top = a + chunk[a:b].argmax(axis=0)
            to_chunk[top, np.arange(FILTERS)] += to_features[k, FILTERS:]
        to_hop = np.zeros_like(pooled)
        np.add.at(to_hop, (chosen, np.broadcast_to(np.arange(FILTERS), chosen.shape)), to_chunk)
        to_hop *= pooled > 0
        hop, kind = np.nonzero(to_hop)
        amount, start = to_hop[hop, kind], place[hop, kind] * STRIDE
        taps = start[:, None] + np.arange(WIDTH)
        rows = x[taps].reshape(len(start), -1)
        conv, conv_b = np.zeros_like(w["conv"]), np.zeros_like(w["conv_b"])
        for f in range(FILTERS):
            mine = kind == f
            conv[:, f] = amount[mine] @ rows[mine]
            conv_b[f] = amount[mine].sum()
        to_input = (amount[:, None] * w["conv"][:, kind].T).reshape(len(start), WIDTH, CHANNELS)[:, :, :-1]
        embed = np.zeros_like(w["embed"])
        np.add.at(embed, padded[taps], to_input)
        embed[0] = 0
        return {"embed": embed, "conv": conv, "conv_b": conv_b, "hidden": features.T @ back, "hidden_b": back.sum(axis=0), "out": hidden.T @ error, "out_b": np.array([error.sum()], np.float32)}


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", modulus: int = MODULUS, held: int = HELD) -> ByteNetwork:
    texts, known, _ = learn.training_rows(docs, labels, target, modulus, held)
    network = ByteNetwork.new().fit(texts, known)
    release()
    return network


def score(docs: DataFrame, network: ByteNetwork, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the probability of label 1 as ``name`` (double)."""
    weights = network.w
    names = [f"c{k}" for k in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ByteNetwork(weights)
        for part in chunks(batches, "_text", 2 << 20):
            found = model.scores(*pretokens.text_buffers(part.column("_text")))
            yield pa.record_batch([*part.columns[:-1], pa.array(found.astype(np.float64))], [*names, "_score"])
        release()

    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], blank_null(text_col).alias("_text"))
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))
    made = rows.mapInArrow(run, f"{fields}, _score double")
    return made.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)], F.col("_score").alias(name))


def op5_quality_cnn(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = train(docs, table(spark, sf_dir, "labels"))
    # the text goes to the network only
    scored = score(docs.select("doc_id", "text"), network)
    return scored.select("doc_id", (learn.fold("doc_id", MODULUS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
