"""Quality by attention-based multiple-instance learning.

A text is a bag of passages. Every passage is encoded: how often each pair of byte classes follows one another, how
well the passage and its text compress, and the text's length. A gated attention network learns from labels of whole
documents which passages matter: each gets a weight, the weighted sum of the passages' hidden representations stands
for the document, and a logistic layer scores it. The network is trained on the driver on a bounded sample of documents
(at most ``PER_CLASS`` of each class and ``PASSAGES`` passages in all: beyond that, further documents are left out whole);
training and scoring take every passage of a document.

Only the text's bytes are features. Defined cases: null and empty texts are one passage without bytes; repeated rows
each get a row; without labels every score is 0.5, with labels of one class it is that class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, labelled

#: Bytes of a passage; most sampled documents of a class, and passages of them all; width of the hidden representation; passes over the sample.
PASSAGE, PER_CLASS, PASSAGES, HIDDEN, EPOCHS = 512, 4000, 1 << 17, 24, 30
#: Passages whose pairs are counted at once.
AT_ONCE = 4096

# Byte classes.
GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!?", ";:", "#$%&*", "|", "'\"-()[]{}", "@/\\_=+<>~^`")
CLASSES = len(GROUPS) + 3  # and control characters, first bytes and further bytes of longer characters


def _class_of() -> np.ndarray:
    out = np.full(256, len(GROUPS), np.int64)
    for i, g in enumerate(GROUPS):
        for c in g:
            out[ord(c)] = i
    out[0x80:0xC0], out[0xC0:] = len(GROUPS) + 1, len(GROUPS) + 2
    return out


CLASS_OF = _class_of()
WIDTH = CLASSES * CLASSES + 4


def _shares(passages: list[bytes]) -> np.ndarray:
    """Square roots of the shares of each pair of byte classes in each passage's neighbours."""
    size = np.array([len(p) for p in passages])
    code = CLASS_OF[np.frombuffer(b"".join(passages), np.uint8)]
    owner = np.repeat(np.arange(len(passages)), size)
    pair = (owner[1:] * CLASSES + code[:-1]) * CLASSES + code[1:]
    pair = pair[owner[1:] == owner[:-1]]
    counts = np.bincount(pair, minlength=len(passages) * CLASSES * CLASSES).reshape(len(passages), -1)
    return np.sqrt(counts / np.maximum(size - 1, 1)[:, None]).astype(np.float32)


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and where each text's begin."""
    passages, ends, rest = [], [0], []
    for t in texts:
        own = [t[s : s + PASSAGE] for s in range(0, max(len(t), 1), PASSAGE)]
        whole = len(zlib.compress(t, 1)) / max(len(t), 1) if len(t) > PASSAGE else None
        for p in own:
            squeezed = len(zlib.compress(p, 1)) / max(len(p), 1)
            rest.append((min(squeezed, 2.0), min(squeezed if whole is None else whole, 2.0), np.log1p(len(t)), float(not p)))
        passages += own
        ends.append(len(passages))
    shares = [_shares(passages[i : i + AT_ONCE]) for i in range(0, len(passages), AT_ONCE)]
    return np.hstack([np.concatenate([np.empty((0, CLASSES * CLASSES), np.float32), *shares]), np.array(rest, np.float32).reshape(-1, 4)]), np.array(ends)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Gated attention over passages, in numpy. Rows of a bag are x[at[i]:at[i + 1]]."""

    def __init__(self, x: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), 1 / np.maximum(x.std(axis=0), 1e-3)

        def start(*shape: int) -> np.ndarray:
            return rng.normal(0, shape[0] ** -0.5, shape)

        self.p = {"w": start(x.shape[1], hidden), "b": np.zeros(hidden), "v": start(hidden, hidden), "u": start(hidden, hidden), "a": start(hidden, 1)[:, 0], "c": start(hidden, 1)[:, 0], "d": np.zeros(1)}

    def forward(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.p
        x = np.clip((x - self.mean) * self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        tv, su = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = np.clip((tv * su) @ p["a"], -30, 30)
        first, owner = at[:-1], np.repeat(np.arange(len(at) - 1), np.diff(at))
        e = np.exp(e - np.maximum.reduceat(e, first)[owner])
        attention = e / np.add.reduceat(e, first)[owner]
        z = np.add.reduceat(attention[:, None] * h, first, axis=0)
        return _sigmoid(z @ p["c"] + p["d"]), {"x": x, "h": h, "tv": tv, "su": su, "attention": attention, "z": z, "owner": owner, "first": first}

    def gradient(self, got: np.ndarray, y: np.ndarray, s: dict) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        dz = (got - y)[:, None] * p["c"] / n
        da = (dz[s["owner"]] * s["h"]).sum(axis=1)
        own = s["attention"] * da
        de = own - s["attention"] * np.add.reduceat(own, s["first"])[s["owner"]]
        dt, ds = de[:, None] * p["a"] * s["su"] * (1 - s["tv"] ** 2), de[:, None] * p["a"] * s["tv"] * s["su"] * (1 - s["su"])
        dh = s["attention"][:, None] * dz[s["owner"]] + dt @ p["v"].T + ds @ p["u"].T
        dx = dh * (1 - s["h"] ** 2)
        return {"w": s["x"].T @ dx, "b": dx.sum(axis=0), "v": s["h"].T @ dt, "u": s["h"].T @ ds, "a": (s["tv"] * s["su"]).T @ de, "c": s["z"].T @ (got - y) / n, "d": np.array([(got - y).mean()])}

    def train(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> None:
        """Adam on the log loss, with a little decay; bags are drawn with the weights' odds, so scores keep the natural class rates."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, bags = 0, len(y)
        for epoch in range(epochs):
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            order = rng.choice(bags, bags, p=weight / weight.sum())
            for begin in range(0, bags, 64):
                part = order[begin : begin + 64]
                size = at[part + 1] - at[part]
                rows = np.arange(size.sum()) + np.repeat(at[part] - np.r_[0, np.cumsum(size)[:-1]], size)
                got, state = self.forward(x[rows], np.r_[0, np.cumsum(size)])
                step += 1
                for k, g in self.gradient(got, y[part], state).items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.forward(*encode(texts))[0]


def fit(documents: DataFrame, labels: DataFrame, usable, label: str = "quality", id_column: str = "doc_id", column: str = "text", per_class: int = PER_CLASS, most: int = PASSAGES) -> Network | float:
    """The trained network, or a constant score where the labels can't tell anything."""
    examples, natural = labelled.sample(documents, labels, label, usable, per_class, id_column, column)
    n_passages = F.greatest(F.ceil(F.coalesce(F.octet_length(column), F.lit(0)) / PASSAGE), F.lit(1))
    sizes = examples.groupBy(F.col(id_column).alias("id")).agg(F.sum(n_passages).alias("n")).orderBy(F.xxhash64("id"), "id").collect()
    left_out = [r.id for r, total in zip(sizes, np.cumsum([r.n for r in sizes]).tolist(), strict=True) if total > most]
    if left_out:
        examples = examples.where(~F.col(id_column).isin(left_out))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1 << 20, column):
            x, at = encode([(t or "").encode() for t in batch.column(column).to_pylist()])
            bags = [x[a:b].astype(np.float16).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_column).cast(pa.string()), batch.column("label"), pa.array(bags, pa.binary())], ["id", "label", "bag"])

    held = examples.mapInArrow(passages, "id string, label int, bag binary").toArrow()
    rows = sorted(zip(*[held.column(c).to_pylist() for c in ("id", "label", "bag")], strict=True))
    y = np.array([float(r[1] > 0) for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    bags = [np.frombuffer(r[2], np.float16).reshape(-1, WIDTH) for r in rows]
    x, at = np.concatenate(bags).astype(np.float32), np.r_[0, np.cumsum([len(b) for b in bags])]
    share = {k: sum(v for c, v in natural.items() if float(c > 0) == k) / max((y == k).sum(), 1) for k in (0.0, 1.0)}
    net = Network(x)
    net.train(x, at, y, np.array([share[v] for v in y.tolist()]))
    return net


def score(documents: DataFrame, model: Network | float, column: str = "text") -> DataFrame:
    """documents with the score; the text is kept, since filters need it."""
    common.small_batches(documents)
    kept = [f for f in documents.schema.fields if f.name != "score"]
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in common.slices(batches, 1 << 20, column):
            texts = [(t or "").encode() for t in batch.column(column).to_pylist()]
            found = np.full(len(texts), m) if isinstance(m, float) else m.score(texts)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(found, pa.float64())], [*[f.name for f in kept], "score"])

    return documents.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(go, T.StructType([*kept, T.StructField("score", T.DoubleType())]))
