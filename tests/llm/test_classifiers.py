"""Quality and toxicity networks: held-out accuracy, gradients, whole texts, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from canopy.llm import learn, pretokens, quality, toxicity

BIG = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@pytest.fixture(scope="session")
def labelled(spark):
    d, l = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    return d, l


@pytest.mark.parametrize("module, target, least", [(quality, "quality", 0.9), (toxicity, "toxic", 0.9)])
def test_held_out_rows(labelled, module, target, least):
    docs, labels = labelled
    model = module.train(docs, labels)
    known = docs.select("doc_id", "text").join(labels, "doc_id").where(learn.fold("doc_id", module.MODULUS) == module.HELD)
    rows = module.score(known, model).select("doc_id", "score", target).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % module.MODULUS == module.HELD for r in rows)
    score, label = np.array([r["score"] for r in rows]), np.array([r[target] for r in rows])
    assert len(rows) > 100 and (score >= 0).all() and (score <= 1).all()
    assert auc(score, label) > least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_queries_use_no_other_column(spark, sf_dir, module):
    query = {quality: quality.op5_quality_cnn, toxicity: toxicity.op10_toxicity_bigru}[module](spark, sf_dir)
    rows = query.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    limit = module.THRESHOLD
    assert all(r["predicted"] == int(r["score"] >= limit) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % module.MODULUS == module.HELD) for r in rows)


@pytest.mark.parametrize("module, empty", [(quality, quality.ByteNetwork.new()), (toxicity, None)])
def test_odd_rows(spark, odd, nothing, module, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (8, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = module.train(odd, labels)
    out = module.score(odd.drop("score"), model)
    rows = out.collect()
    assert len(rows) == 11 and out.columns == [*odd.drop("score").columns, "score"]
    by = {}
    for r in rows:
        by.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(v) == 1 for v in by.values())  # equal texts, equal scores
    assert module.score(nothing, module.train(nothing, labels.limit(0))).collect() == []


def test_quality_gradient():
    """The written gradient against differences of the loss."""
    network = quality.ByteNetwork.new(3)
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    random = np.random.default_rng(0)
    texts = [bytes(random.integers(32, 120, n).astype(np.uint8)) for n in (900, 40, 1500)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    labels, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        p = network.scores(data, ends).astype(np.float64)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = network._gradients(data, ends, labels, weight)
    for name, at in (("out", 2), ("hidden_b", 3), ("conv_b", 5)):
        step = 3e-3
        keep = network.w[name][at]
        network.w[name][at] = keep + step
        up = loss()
        network.w[name][at] = keep - step
        down = loss()
        network.w[name][at] = keep
        assert abs((up - down) / (2 * step) - grads[name][at]) < 5e-3


def test_last_words_of_a_long_text_count():
    """Toxic words at the end of a very long text raise its score: no prefix is scored alone."""
    random = np.random.default_rng(1)
    clean = [f"c{i}" for i in range(200)]
    bad = ["vile", "scum", "filth"]
    texts, labels = [], []
    for k in range(240):
        words = list(random.choice(clean, 120))
        if k % 2:
            at = int(random.integers(0, 100))
            words[at : at + 3] = list(random.choice(bad, 3))
        texts.append(" ".join(words))
        labels.append(k % 2)
    model = toxicity.Recurrent.new().fit(texts, np.array(labels, np.float32), 0.5)
    long = " ".join(random.choice(clean, 30_000))
    found = toxicity.Scorer(model).scores(*pretokens.text_buffers(pa.array([long, long + " vile scum filth", "vile scum filth " + long])))
    assert found[0] + 0.05 < min(found[1], found[2])


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        windows, owner = toxicity.windows_of(np.arange(n), np.zeros(n, np.int64), 1)
        assert set(windows[windows >= 0].tolist()) == set(range(n)) and len(owner) >= 1


def test_long_runs_of_letters_are_read_whole():
    """Every byte of a run without spaces is in a piece, and toxic words in its middle raise the score."""
    for n in (1, 24, 25, 36, 37, 48, 49, 1000):
        run = "".join(chr(97 + k * k % 23) for k in range(n)).encode()
        parts = toxicity.pieces(run)
        assert max(map(len, parts)) <= toxicity.WORD_BYTES
        assert all(any(run[a : a + 13] in p for p in parts) for a in range(max(1, n - 12)))
    words, index, doc = toxicity.text_words(*pretokens.text_buffers(pa.array(["an " + "x" * 70_000 + " end", "", "an"])))
    assert doc.tolist() == [0] * (len(index) - 1) + [2] and len(index) > 70_000 // toxicity.WORD_BYTES and words[index[-2]] == b"end" and words[index[-1]] == b"an"
    random = np.random.default_rng(2)
    clean = [f"{a}{b}lo" for a in "bdfgkm" for b in "aeiou"]
    texts, labels = [], []
    for k in range(240):
        said = list(random.choice(clean, 120))
        if k % 2:
            at = int(random.integers(0, 100))
            said[at : at + 3] = list(random.choice(["vile", "scum", "filth"], 3))
        texts.append(" ".join(said))
        labels.append(k % 2)
    model = toxicity.Recurrent.new().fit(texts, np.array(labels, np.float32), 0.5)
    run = "".join(random.choice(clean, 10_000))
    found = toxicity.Scorer(model).scores(*pretokens.text_buffers(pa.array([run, run[:20_000] + "vilescumfilth" * 3 + run[20_000:]])))
    assert found[0] < found[1]


def small_recurrent():
    dice = np.random.default_rng(2)
    model = toxicity.Recurrent.new()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    model.w["word"], model.w["gram"] = dice.standard_normal((6, toxicity.SIZE)), dice.standard_normal((9, toxicity.SIZE))
    model.w["word"][0] = model.w["gram"][0] = 0
    feats = (np.array([1, 2, 3, 0, 5]), np.array([[1, 2, 0], [3, 0, 0], [4, 5, 6], [7, 0, 0], [8, 1, 0]]), np.array([2, 1, 3, 2, 2]))
    index = np.array([[0, 1, 2, 3], [4, 2, -1, -1], [3, 3, 0, -1]])
    return model, feats, index


def test_toxicity_gradient():
    """The written gradient against differences of the loss."""
    model, feats, index = small_recurrent()
    labels, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        p = learn.sigmoid(model.logits(model.gates(model.vectors(*feats)), index).astype(np.float64))
        return float((-weight * np.log(np.where(labels == 1, p, 1 - p))).sum() / len(labels))

    grads = model.gradients(feats, index, labels, weight)
    for name in ("word", "gram", "in_f", "in_b", "bias_f", "state_f", "state_b", "look", "pick", "out", "out_b"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        kept = model.w[name][at]
        values = []
        for step in (0.02, -0.02):
            model.w[name][at] = kept + step
            values.append(loss())
        model.w[name][at] = kept
        assert abs((values[0] - values[1]) / 0.04 - grads[name][at]) < 2e-3 + 0.02 * abs(grads[name][at]), name


def test_toxicity_forward_pass_by_loops():
    """One window's logit by plain loops over its words."""
    model, feats, index = small_recurrent()
    w, s = model.w, toxicity.STATE
    x = [w["word"][a] + w["gram"][g].sum(axis=0) / np.sqrt(max(n, 1)) for a, g, n in zip(*feats, strict=True)]
    sig = lambda v: 1 / (1 + np.exp(-v))
    for window, got in zip(index, model.logits(model.gates(model.vectors(*feats)), index), strict=True):
        places = [k for k in window if k >= 0]
        states = np.zeros((len(places), 2 * s))
        for side, order, at in (("f", range(len(places)), 0), ("b", reversed(range(len(places))), s)):
            h = np.zeros(s)
            for t in order:
                g, r = x[places[t]] @ w[f"in_{side}"] + w[f"bias_{side}"], h @ w[f"state_{side}"]
                z, reset = sig(g[:s] + r[:s]), sig(g[s : 2 * s] + r[s : 2 * s])
                h = h + z * (np.tanh(g[2 * s :] + reset * r[2 * s :]) - h)
                states[t, at : at + s] = h
        look = np.exp(np.tanh(states @ w["look"]) @ w["pick"])
        assert abs((look / look.sum()) @ states @ w["out"] + w["out_b"][0] - got) < 1e-4


def test_few_labels_still_tell(spark):
    """305 labelled rows with 37 toxic ones: far better than chance, though a count of words alone has 0.8 to 0.9 there."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    known = docs.select("doc_id", "text").join(labels, "doc_id").where(learn.fold("doc_id", toxicity.MODULUS) == toxicity.HELD)
    rows = toxicity.score(known, model).select("score", "toxic").collect()
    found = auc(np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows]))
    print("AUC", found)
    assert found > 0.6
