"""Quality classifier: a convolutional network over the bytes of a text, in numpy.

A text is cut into chunks of CHUNK bytes that overlap by WIDTH - 1, so that every window of WIDTH bytes of the whole text lies in a chunk.
FILTERS learned filters (a table of 256 bytes by WIDTH places each) run over every window; the largest responses of the filters in a chunk go
through a rectifier and, with the chunk's length, through one hidden layer, and the chunks' log odds are averaged by their lengths into one
probability.

Learning is stochastic gradient descent with Adam on at most TRAIN_ROWS labelled documents, the first by a hash of doc_id, until they have TRAIN_BYTES
together; of a longer one the TRAIN_STRETCH bytes from a place that its hash gives count. Each step takes one random chunk of each document of its
batch, two fifths of them cut short, so that shortness is no sign of a label. These bounds are the only ones: scoring covers whole texts.

Defined results: null and empty texts are scored as an empty chunk; with no labels, or one class only, every score is the share of label 1 (0.5 for none);
labels of rows with a null doc_id or quality are ignored; repeated rows get equal scores; an empty table gives an empty table; other columns
pass through.
"""

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.arrow import batched, only
from vellum.llm.common import named

WIDTH, FILTERS, HIDDEN, CHUNK = 6, 12, 8, 2048
TRAIN_ROWS, TRAIN_BYTES, TRAIN_STRETCH = 4096, 24 << 20, 1 << 18
EPOCHS, BATCH, RATE = 14, 32, 0.015
THRESHOLD = 0.7


class Model:
    """p: tables (WIDTH x 256 x FILTERS), bias (FILTERS), and the layers that combine the pooled responses and the chunk's length."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def responses(self, data: np.ndarray) -> np.ndarray:
        """One row per window of data (bytes)."""
        n, tables = len(data) - WIDTH + 1, self.p["tables"]
        total = tables[0].take(data[:n], 0)
        for j in range(1, WIDTH):
            total += tables[j].take(data[j : n + j], 0)
        return total

    def logits(self, top: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log odds of chunks from their largest responses and their numbers of windows."""
        p = self.p
        x = np.concatenate([np.maximum(top + p["bias"], 0), (np.log1p(sizes) / 4)[:, None].astype(np.float32)], 1)
        return np.tanh(x @ p["first"] + p["first_bias"]) @ p["second"] + p["out"][0]

    def score(self, data: bytes) -> float:
        """Probability of label 1 for a whole text; responses are computed over several chunks at once."""
        a = padded(data)
        n, odds = len(a) - WIDTH + 1, 0.0
        for start in range(0, n, 16 * CHUNK):
            size = min(16 * CHUNK, n - start)
            at = np.arange(0, size, CHUNK)
            sizes = np.diff(np.append(at, size))
            top = np.maximum.reduceat(self.responses(a[start : start + size + WIDTH - 1]), at, 0)
            odds += float(self.logits(top, sizes) @ sizes)
        return float(1 / (1 + np.exp(-np.clip(odds / n, -30, 30))))


def padded(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    return a if len(a) >= WIDTH else np.concatenate([a, np.zeros(WIDTH - len(a), np.uint8)])


def loss_and_gradients(model: Model, a: np.ndarray, y: float, g: dict[str, np.ndarray] | None = None, weight: float = 1.0) -> tuple[float, dict[str, np.ndarray]]:
    """Cross entropy of a chunk's probability and label y, and its gradients times weight, which are added to g."""
    p, every = model.p, np.arange(FILTERS)
    g = {k: np.zeros_like(v) for k, v in p.items()} if g is None else g
    r = model.responses(a)
    at = r.argmax(0)
    top = r[at, every] + p["bias"]
    x = np.append(np.maximum(top, 0), p["bias"].dtype.type(np.log1p(len(r)) / 4))
    hidden = np.tanh(x @ p["first"] + p["first_bias"])
    z = float(hidden @ p["second"] + p["out"][0])
    q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    e = weight * (q - y)
    back = e * p["second"] * (1 - hidden**2)
    down = (p["first"][:FILTERS] @ back) * (top > 0)
    g["out"][0] += e
    g["second"] += e * hidden
    g["first"] += np.outer(x, back)
    g["first_bias"] += back
    g["bias"] += down
    for j in range(WIDTH):
        g["tables"][j, a[at + j], every] += down
    return -float(np.log(q if y > 0.5 else 1 - q)), g


def learn(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """A model from whole texts and 0/1 labels. Deterministic."""
    rng = np.random.default_rng(seed)
    share = float(np.mean(labels)) if labels else 0.5
    one_class = not labels or not 0 < share < 1
    odds = (30.0 if share == 1 else -30.0 if labels else 0.0) if one_class else np.log(share / (1 - share))
    p = {
        "tables": rng.normal(0, 0.1, (WIDTH, 256, FILTERS)),
        "bias": np.zeros(FILTERS),
        "first": rng.normal(0, 0.3, (FILTERS + 1, HIDDEN)),
        "first_bias": np.zeros(HIDDEN),
        "second": np.zeros(HIDDEN) if one_class else rng.normal(0, 0.5, HIDDEN),
        "out": np.array([odds]),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    model = Model(p)
    if one_class:
        return model
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    data, y, step = [padded(t) for t in texts], np.asarray(labels, np.float32), 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            g = {k: np.zeros_like(v) for k, v in p.items()}
            for d in batch:
                a = data[d]
                size = CHUNK if rng.random() < 0.6 else int(np.exp(rng.uniform(np.log(24), np.log(CHUNK))))
                start = int(rng.integers(0, max(1, len(a) - size)))
                loss_and_gradients(model, a[start : start + size + WIDTH - 1], y[d], g, 1 / len(batch))
            step += 1
            rate = RATE * (1 - 0.95 * epoch / epochs)
            for k, v in p.items():
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.001 * (g[k] ** 2 - m2[k])
                v -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(named(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, stretch: int = TRAIN_STRETCH) -> Model:
    """A model from labelled documents that are not held out. Only the ids and lengths of at most rows documents, and then at most size bytes of
    their texts, come to the driver. Of rows with one doc_id the larger label and the smallest stretch count; empty texts teach nothing."""
    known = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null").filter(~held_out())
    order = F.xxhash64("doc_id")
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(order, "doc_id").limit(rows)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).filter("octet_length(text) > 0")
    lengths = chosen.join(texts.select("doc_id", F.octet_length("text").alias("n")), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("q"), F.least(F.max("n"), F.lit(stretch)).alias("n"))
    total, take = 0, {}
    for r in lengths.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").collect():
        total += r["n"]
        if total > size:
            break
        take[r["doc_id"]] = int(r["q"] > 0)
    if not take:
        return learn([], [])
    few = docs.sparkSession.createDataFrame([(k,) for k in take], "doc_id long")
    spare = F.greatest(F.octet_length("text") - stretch, F.lit(0))
    cut = F.substring("text", F.pmod(order, spare + 1).cast("int") + 1, F.lit(stretch))
    read = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(cut).alias("text")).collect()
    read.sort(key=lambda r: r["doc_id"])
    return learn([bytes(r["text"]) for r in read], [take[r["doc_id"]] for r in read])


def scorer(model: Model) -> Callable[[], Callable[[list], list[tuple]]]:
    def make():
        return lambda texts: [(model.score((t or "").encode()),) for t in texts]

    return make


def scored(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """docs with score: the probability of label 1 for each whole text."""
    return batched(docs, scorer(model), column, T.StructType([T.StructField("score", T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(only(docs, "doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches threshold; columns as before."""
    out = scored(docs, train(docs, labels))
    return out.filter(named(out.columns[-1]) >= threshold).select(*[named(c) for c in docs.columns])
