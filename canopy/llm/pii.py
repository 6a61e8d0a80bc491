"""Personal data: rules for plain forms, and a character network with a CRF for those that stand close to others.

The rules (``base_spans``) take the leftmost matches of each kind and drop those that
fail a check, so two card numbers one space apart, or a telephone number before an
address of numbers, are one failing match and are lost.  A bidirectional LSTM over
classes of characters scores tags, a CRF decodes them, and what it proposes is added if
it passes the kind's check and touches no span of the rules.

The network learns from labelled spans: pieces of a bounded sample of the texts with
the spans that the rules find, and the same pieces with spans of random digits put in
alone or side by side.  Texts are read in overlapping windows; a proposal that is cut
by a window's edge gives way to the one of the next window that shows it whole, or is
joined to its other half.  All kinds need a digit or an at sign, so windows without
either can't hold a span and aren't scored.

Null and empty texts have no spans; equal texts have equal spans, repeated rows stay; a
table without texts is trained on spans alone; very long texts are scored in groups of
windows; other columns are left alone, ``pii`` takes a longer name if there is one.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import chunks, release, table
from canopy.llm.learn import Adam, sigmoid

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # none, then first and further characters of each kind
#: Characters of a window, and of the overlap of two; a span of up to the overlap is whole in one of them.
WINDOW, OVERLAP = 96, 48
#: States of each direction, training steps, windows of a step and of a scored batch.
STATES, STEPS, BATCH, SCORED = 20, 400, 48, 1024
#: Pieces of texts that are learned from: so many anywhere, so many around a digit or an at sign; their length.
PIECES, LENGTH = 1500, 240
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_SIGN = re.compile("[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DIGIT = frozenset(string.digits)


def digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGIT)


def luhn(number: str) -> bool:
    doubled = sum(2 * d - 9 * (d > 4) for d in map(int, number[-2::-2]))
    return (doubled + sum(map(int, number[-1::-2]))) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


#: Whether a match of the kind's pattern is one.
CHECKS = {
    "email": lambda s: True,
    "ip": lambda s: all(map(_small, s.split("."))),
    "card": lambda s: 13 <= len(d := digits(s)) <= 19 and luhn(d),
    "phone": lambda s: 9 <= len(digits(s)) <= 15,
}
PATTERNS = {"email": re.compile(r"[A-Za-z0-9._%+-]++@" + _DOMAIN.pattern), "ip": _IP, "card": _CARD, "phone": _PHONE}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign both ways; searching from the left would read a long run again for each of its letters."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            free = host.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by the rules, by kind and start."""
    if not _SIGN.search(text):
        return []
    out = [("email", *span) for span in _emails(text)]
    for kind in KINDS[1:]:
        out += [(kind, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if CHECKS[kind](m.group())]
    return out


def _class_table() -> np.ndarray:
    """Class of each code point below 256: signs one by one, digits, letters by case; 0 is padding."""
    signs = "@.+-()[]{}<>,;:!?/\\|'\"#$%&*=_~^` \n"
    out = np.full(257, 1, np.uint8)
    for i, c in enumerate(signs):
        out[ord(c)] = 6 + i
    for c in range(128):
        if chr(c).isdigit():
            out[c] = 2
        elif chr(c).islower():
            out[c] = 3
        elif chr(c).isupper():
            out[c] = 4
    out[192:] = 5  # accented letters, and all that is above them
    return out


CLASS = _class_table()
CLASSES = int(CLASS.max()) + 1


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CLASS[np.minimum(codes, 256)]


class Network:
    """Both directions run at once: arrays have the direction first."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, dice: np.random.Generator) -> Network:
        h = STATES
        near = lambda *shape: (dice.standard_normal(shape) / np.sqrt(h)).astype(np.float32)
        weights = {"in": near(2, CLASSES, 4 * h), "again": near(2, h, 4 * h), "out": near(2, h, TAGS), "bias": np.zeros(TAGS, np.float32), "from": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        weights["in"][:, :, h : 2 * h] += 1  # remember at first
        return cls(weights)

    def states(self, x: np.ndarray, keep: bool = False):
        """Hidden states (direction, place, window, unit) of class windows (window, place); the second direction's places run backwards."""
        w, h, (n, t) = self.weights, STATES, x.shape
        both = np.stack([x.T, x.T[::-1]])
        side = np.arange(2)[:, None]
        state = np.zeros((2, n, h), np.float32)
        cell = np.zeros((2, n, h), np.float32)
        out = np.empty((2, t, n, h), np.float32)
        kept = []
        for k in range(t):
            z = w["in"][side, both[:, k]] + state @ w["again"]
            gates, new = sigmoid(z[:, :, : 3 * h]), np.tanh(z[:, :, 3 * h :])
            before, cell = cell, gates[:, :, h : 2 * h] * cell + gates[:, :, :h] * new
            bent = np.tanh(cell)
            if keep:
                kept.append((gates, new, before, bent, state))
            state = gates[:, :, 2 * h :] * bent
            out[:, k] = state
        return (out, both, kept) if keep else out

    def scores(self, out: np.ndarray) -> np.ndarray:
        """Tag scores (place, window, tag)."""
        w = self.weights
        return out[0] @ w["out"][0] + out[1, ::-1] @ w["out"][1] + w["bias"]

    def loss(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags (window, place), and its gradients."""
        w, h, (n, t) = self.weights, STATES, x.shape
        out, both, kept = self.states(x, keep=True)
        s = self.scores(out).astype(np.float64)
        move, gold, rows = w["from"].astype(np.float64), tags.T, np.arange(n)
        # forward and backward sums of the CRF
        ahead, behind = np.empty((t, n, TAGS)), np.zeros((t, n, TAGS))
        ahead[0] = s[0] + w["first"]
        for k in range(1, t):
            ahead[k] = s[k] + _log_sum(ahead[k - 1][:, :, None] + move, 1)
        for k in range(t - 2, -1, -1):
            behind[k] = _log_sum(move + (s[k + 1] + behind[k + 1])[:, None, :], 2)
        total = _log_sum(ahead[-1], 1)
        right = s[np.arange(t)[:, None], rows, gold].sum(0) + w["first"][gold[0]] + move[gold[:-1], gold[1:]].sum(0)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        ds = np.exp(ahead + behind - total[:, None])
        pairs = np.exp(ahead[:-1, :, :, None] + move + (s + behind)[1:, :, None, :] - total[:, None, None])
        grad["from"] += pairs.sum((0, 1)).astype(np.float32)
        np.subtract.at(grad["from"], (gold[:-1].ravel(), gold[1:].ravel()), 1)
        ds[np.arange(t)[:, None], rows, gold] -= 1
        grad["first"] += ds[0].sum(0).astype(np.float32)
        ds = ds.astype(np.float32)
        grad["bias"] += ds.sum((0, 1))
        sided = np.stack([ds, ds[::-1]])
        for d in range(2):
            grad["out"][d] = out[d].reshape(-1, h).T @ sided[d].reshape(-1, TAGS)
        from_tags = sided @ w["out"].transpose(0, 2, 1)[:, None]
        # back through time
        d_state = np.zeros((2, n, h), np.float32)
        d_cell = np.zeros((2, n, h), np.float32)
        back = w["again"].transpose(0, 2, 1)
        for k in range(t - 1, -1, -1):
            gates, new, before, bent, state = kept[k]
            put, hold, show = gates[:, :, :h], gates[:, :, h : 2 * h], gates[:, :, 2 * h :]
            d_state = d_state + from_tags[:, k]
            d_cell = d_cell + d_state * show * (1 - bent * bent)
            dz = np.concatenate([d_cell * new, d_cell * before, d_state * bent], 2) * gates * (1 - gates)
            dz = np.concatenate([dz, d_cell * put * (1 - new * new)], 2)
            grad["again"] += state.transpose(0, 2, 1) @ dz
            for d in range(2):
                np.add.at(grad["in"][d], both[d, k], dz[d])
            d_cell = d_cell * hold
            d_state = dz @ back
        return float((total - right).mean()), {k: g / np.float32(n) for k, g in grad.items()}

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest tags (window, place)."""
        w, (n, t) = self.weights, x.shape
        s = self.scores(self.states(x))
        best, came = s[0] + w["first"], np.empty((t, n, TAGS), np.uint8)
        for k in range(1, t):
            ways = best[:, :, None] + w["from"]
            came[k] = ways.argmax(1)
            best = ways.max(1) + s[k]
        tags = np.empty((n, t), np.uint8)
        tags[:, -1] = best.argmax(1)
        for k in range(t - 1, 0, -1):
            tags[:, k - 1] = came[k][np.arange(n), tags[:, k]]
        return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _filled(dice: np.random.Generator, form: str) -> str:
    return "".join(str(dice.integers(10)) if c == "9" else c for c in form)


#: Forms of numbers that are taught; a 9 is any digit.
CARD_FORMS = ["9999999999999999"] * 3 + ["9999 9999 9999 9999", "9999-9999-9999-9999", "999999999999999", "9999 999999 99999", "9999999999999", "9999999999999999999"]
PHONE_FORMS = ["+9 (999) 999-9999"] * 3 + ["+9 999 999 9999", "+99 99 9999 9999", "+99 999 999999", "+9-999-999-9999", "+9.999.999.9999", "+99999999999", "+999 99 999 99 99", "+99 (99) 9999-9999"]
OTHER_FORMS = ["9", "99", "9999", "9.9", "9.9.9", "99999", "99.99", "9999-99-99", "99:99", "9,999.99", "9999999999", "99999999999999999999999", "9-99", "(9)", "9999/99"]


def _item(dice: np.random.Generator) -> tuple[str, str | None]:
    """A piece of text with digits and its kind, None for none."""
    what = dice.integers(7)
    if what < 2:
        return _filled(dice, CARD_FORMS[dice.integers(len(CARD_FORMS))]), "card"
    if what < 4:
        return _filled(dice, PHONE_FORMS[dice.integers(len(PHONE_FORMS))]), "phone"
    if what == 4:
        return ".".join(str(dice.integers(256)) for _ in range(4)), "ip"
    letters = string.ascii_lowercase if dice.random() < 0.8 else string.ascii_uppercase
    word = lambda: "".join(letters[i] for i in dice.integers(26, size=dice.integers(2, 9)))
    if what == 5:
        name = word() + [".", "_", "", "-"][dice.integers(4)] + (word() if dice.random() < 0.5 else _filled(dice, "99"))
        return f"{name}@{word()}{dice.integers(10) if dice.random() < 0.5 else ''}.{word()}" + (".com" if dice.random() < 0.5 else ""), "email"
    if dice.random() < 0.25:
        return "".join("0123456789abcdef"[i] for i in dice.integers(16, size=40)), None
    return _filled(dice, OTHER_FORMS[dice.integers(len(OTHER_FORMS))]), None


def _marked(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(len(text), np.uint8)
    for kind, start, end in spans:
        first = 1 + 2 * KINDS.index(kind)
        tags[start:end] = first + 1
        tags[start] = first
    return tags


def lesson(dice: np.random.Generator, pieces: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and their tags: pieces as they are, and with spans put in alone or side by side."""
    x, y = np.zeros((n, WINDOW), np.uint8), np.zeros((n, WINDOW), np.uint8)
    for i in range(n):
        text = pieces[dice.integers(len(pieces))] if pieces else ""
        spans = base_spans(text)
        if dice.random() < 0.75:
            at = text.find(" ", int(dice.integers(max(1, len(text) - 40)))) + 1 if text else 0
            made, added, last = text[:at], [s for s in spans if s[2] <= at], None
            for _ in range(dice.integers(1, 4)):
                put, kind = _item(dice)
                if made and last:
                    made += [" ", " ", " ", ", ", " | ", "\n", "; ", "!! "][dice.integers(8)]
                if kind:
                    added.append((kind, len(made), len(made) + len(put)))
                made, last = made + put, put
            made += [" ", " ", ". ", "%%% ", "\n", ", "][dice.integers(6)]
            # what follows is marked by its own spans
            spans = added + [(k, s + len(made), e + len(made)) for k, s, e in base_spans(text[at:])]
            text = made + text[at:]
        start = int(dice.integers(max(1, len(text) - WINDOW + 1)))
        if spans and dice.random() < 0.9:  # somewhere over a span
            _, s, e = spans[dice.integers(len(spans))]
            start = min(max(0, int(dice.integers(s - WINDOW + 8, e - 4))), max(0, len(text) - WINDOW))
        got = text[start : start + WINDOW]
        x[i, : len(got)] = classes(got)
        y[i, : len(got)] = _marked(text, spans)[start : start + WINDOW]
    return x, y


def sample(docs: DataFrame, pieces: int = PIECES) -> list[str]:
    """Distinct pieces of texts, about ``pieces`` from anywhere and as many around a digit or an at sign (all, if there are fewer).

    Rows are taken by a hash below the share that is wanted, so only this bounded sample comes to the driver.
    """
    rows = docs.where("text <> ''").select("text", F.xxhash64("doc_id", "text").alias("h"), F.char_length("text").alias("n"), F.expr("text rlike '[0-9@]'").alias("signed"))
    counts = rows.agg(F.count("*").alias("all"), F.count_if("signed").alias("signed")).first()
    chance = F.pmod(F.col("h"), F.lit(1_000_003)) / 1_000_003
    anywhere = rows.where(chance < pieces / max(1, counts["all"])).select(F.substr("text", (F.pmod("h", "n") + 1).cast("int"), F.lit(LENGTH)).alias("piece"))
    at = F.greatest(F.lit(1), F.regexp_instr("text", F.lit("[0-9@]")) - LENGTH // 2)
    around = rows.where("signed").where(chance < pieces / max(1, counts["signed"])).select(F.substr("text", at, F.lit(LENGTH)).alias("piece"))
    return sorted({r["piece"] for r in anywhere.union(around).collect()})


def train(pieces: list[str], steps: int = STEPS, seed: int = 13) -> Network:
    dice = np.random.default_rng(seed)
    network = Network.fresh(dice)
    rates = Adam(network.weights, 0.02)
    for step in range(steps):
        rates.rate = 0.02 * (1 - step / steps) + 0.001
        _, grad = network.loss(*lesson(dice, pieces, BATCH))
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rates.update({k: g * np.float32(min(1.0, 5.0 / max(size, 1e-6))) for k, g in grad.items()})
    return network


def windows(text: str) -> list[int]:
    """Starts of the windows that cover the text and hold a digit or an at sign."""
    step, out = WINDOW - OVERLAP, []
    last = max(0, -(-(len(text) - WINDOW) // step))
    for m in _SIGN.finditer(text):
        for k in range(max(0, (m.start() - WINDOW) // step + 1), min(last, m.start() // step) + 1):
            if not out or out[-1] < k * step:
                out.append(k * step)
    return out


def tagged(row: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (kind, start, end) of one kind's tags; a first tag begins another one."""
    out: list[list[int]] = []
    for p in np.flatnonzero(row).tolist():
        kind, first = (int(row[p]) - 1) // 2, row[p] % 2 == 1
        if out and not first and out[-1][0] == kind and out[-1][2] == p:
            out[-1][2] = p + 1
        else:
            out.append([kind, p, p + 1])
    return [(k, s, e) for k, s, e in out]


def proposals(text: str, starts: list[int], tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of all windows, reconciled: those that a window shows whole, then what is left of cut ones, joined."""
    whole, cuts = set(), []
    for at, row in zip(starts, tags, strict=True):
        n = min(WINDOW, len(text) - at)
        for kind, s, e in tagged(row[:n]):
            span = (kind, at + s, at + e)
            if (s == 0 and at) or (e == n and at + n < len(text)):
                cuts.append(span)
            else:
                whole.add(span)
    joined: list[tuple[int, int, int]] = []
    for kind, start, end in sorted(cuts):
        if joined and joined[-1][0] == kind and joined[-1][2] >= start:
            joined[-1] = (kind, joined[-1][1], max(end, joined[-1][2]))
        else:
            joined.append((kind, start, end))
    apart = _Taken((s, e, k) for k, s, e in whole)
    out = sorted(whole) + [j for j in joined if not apart.touches(j[1], j[2], j[0])]
    return [(KINDS[k], s, e) for k, s, e in out]


class _Taken:
    """Spans by blocks of places, to ask whether a span touches one of them."""

    def __init__(self, spans=()):
        self.blocks: dict[int, list[tuple[int, int, object]]] = {}
        for span in spans:
            self.add(*span)

    def add(self, start: int, end: int, kind: object = None) -> None:
        for b in range(start >> 7, (end >> 7) + 1):
            self.blocks.setdefault(b, []).append((start, end, kind))

    def touches(self, start: int, end: int, kind: object = None) -> bool:
        """``kind`` None: of any kind."""
        return any(s < end and start < e and (kind is None or kind == k) for b in range(start >> 7, (end >> 7) + 1) for s, e, k in self.blocks.get(b, ()))


def fitted(text: str, kind: str, start: int, end: int) -> tuple[int, int] | None:
    """The proposal on borders of runs of digits, if it is a span of its kind by all checks."""
    if kind != "email":
        while start < end and text[start] not in _DIGIT and text[start] != "+":
            start += 1
        while end > start and text[end - 1] not in _DIGIT:
            end -= 1
        if start == end:
            return None
        while start and text[start] in _DIGIT and text[start - 1] in _DIGIT:
            start -= 1
        while end < len(text) and text[end] in _DIGIT:
            end += 1
        if kind == "phone" and start and text[start - 1] == "+":
            start -= 1
    value = text[start:end]
    if not PATTERNS[kind].fullmatch(value) or not CHECKS[kind](value):
        return None
    before, after = text[max(0, start - 1) : start], text[end : end + 2]
    if before.isalnum() or before in ("+", "@", "_") or after[:1].isalnum() or (kind == "ip" and re.match(r"\.[0-9]", after)):
        return None  # part of a longer word or number
    return start, end


def added_spans(text: str, base: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Proposals that pass all checks and touch no span of the rules and none taken before; longer ones are taken first."""
    fits = {(kind, *fit) for kind, s, e in found if (fit := fitted(text, kind, s, e))}
    taken, out = _Taken((s, e) for _, s, e in base), []
    for kind, s, e in sorted(fits, key=lambda x: (x[1] - x[2], x[1], x[0])):
        if not taken.touches(s, e):
            taken.add(s, e)
            out.append((kind, s, e))
    return out


def spans_of(texts: list[str], network: Network) -> list[list[tuple[str, int, int, bool]]]:
    """Spans (kind, start, end, whether by the rules) of each text, by kind and start; windows of all texts are scored together."""
    asked = [(i, at) for i, text in enumerate(texts) for at in windows(text)]
    tags = np.zeros((len(asked), WINDOW), np.uint8)
    for k in range(0, len(asked), SCORED):
        x = np.zeros((len(asked[k : k + SCORED]), WINDOW), np.uint8)
        for row, (i, at) in zip(x, asked[k : k + SCORED], strict=True):
            got = classes(texts[i][at : at + WINDOW])
            row[: len(got)] = got
        tags[k : k + SCORED] = network.decode(x)
    mine: dict[int, list[int]] = {}
    for k, (i, _) in enumerate(asked):
        mine.setdefault(i, []).append(k)
    out: list[list[tuple[str, int, int, bool]]] = []
    for i, text in enumerate(texts):
        if i not in mine:
            out.append([])
            continue
        base = base_spans(text)
        more = added_spans(text, base, proposals(text, [asked[k][1] for k in mine[i]], tags[mine[i]]))
        out.append(sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
    return out


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with ``[kind]`` for each span; of spans that overlap the first and then the longest is named, and all their characters go."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def find(docs: DataFrame, network: Network, keep: list[str] | None = None, mask: bool = False) -> DataFrame:
    """The rows (columns ``keep``, all if None) with ``pii``, the spans of ``text``; with ``mask`` also ``masked``, the text without them."""
    keep = docs.columns if keep is None else keep
    taken = {c.lower() for c in keep}
    name, clean = ((x if x not in taken else next(y for k in range(1, 999) if (y := x + "_" * k) not in taken)) for x in ("pii", "masked"))
    shared = docs.sparkSession.sparkContext.broadcast(network.weights)
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    rows = docs.select(*[f"`{c}`" for c in keep], F.coalesce("text", F.lit("")).alias("_pii_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"`{name}` {SPANS}", *([f"`{clean}` string"] if mask else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(shared.value)
        for batch in chunks(batches, "_pii_text"):
            texts = batch.column("_pii_text").to_pylist()
            spans = spans_of(texts, model)
            columns = [*batch.columns[:-1], pa.array([[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in row] for row in spans], item)]
            if mask:
                columns.append(pa.array([masked(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], name, *([clean] if mask else [])])
        release()

    return rows.mapInArrow(run, schema)


def op13_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of all documents; counts and hash are those of the rules' spans."""
    docs = table(spark, sf_dir, "documents")
    rows = find(docs, train(sample(docs)), ["doc_id"])
    by_rules = F.filter("pii", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(by_rules, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(line(by_rules), 256).alias("base_sha256"), line(F.col("pii")).alias("spans"), F.size(F.filter("pii", lambda s: ~s["base"])).cast("long").alias("n_added"))
