"""Embedding near-dedup by product quantisation.

1. Valid vectors are scaled to length one; equal vectors of a label are one class, whose smallest vec_id stands for it.
2. A bounded sample trains coarse centroids, half the square root of the number of classes, and, on the residuals, a codebook for each of PARTS
   subspaces. Every class is indexed: it goes to its nearest centroid's inverted list with its codes and its exact quantisation error.
3. Every class is a query too. It probes its own list and each list whose border with it (the plane between the two centroids) is nearer than MARGIN.
   Vectors that link are at most REACH = sqrt(2 - 2 * 0.98) = 0.2 apart, so of two in different lists the one nearer to the border is within half of that, and
   probes the other's list: with MARGIN at half of REACH no link is lost, whatever the vectors' dimension. A link that only one side finds counts for both.
4. In a list, distances come from tables of the query's residual against the codebooks (asymmetric). By the triangle inequality a pair whose table
   distance is over 0.2 plus the vector's own quantisation error (and the query's rounding) cannot link. Queries and vectors with a pair left survive;
   only for them vectors are fetched, and their cosines are taken in double precision.
What is shuffled for the search are ids, codes, and queries rounded to a byte a component with their exact rounding errors. Lists are cut into blocks of
queries and of vectors, which are dealt to partitions in turn, so no task holds a whole list. A block gives a count for each query (and vector) and a
spanning forest of its links, never all pairs.

The fit is bounded by SAMPLE_BYTES; where that leaves fewer than eight vectors for a centroid, there are fewer lists, and they are longer.

Defined results: vectors that are null, empty, zero or hold null or non-finite parts, and rows with a null label, link with nothing; vectors of any other
length, tiny or huge, link by their directions; vectors of different dimensions do not link; a null vec_id links with nothing; rows that share a vec_id are
one node with the largest of their counts; an empty table gives an empty table; other columns are dropped.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import keep_out, scope, sieve, sifted, stored
from vellum.llm.components import components
from vellum.llm.groups import Union, runs

COSINE = 0.98
REACH = (2 - 2 * COSINE) ** 0.5
MARGIN = REACH / 2 + 1e-6
SAMPLE, SAMPLE_BYTES, PARTS, CODES = 16_384, 256 << 20, 16, 256
#: Centroids beyond which they are fitted in two levels, and numbers that a worker holds at once for a batch of distances.
FLAT, NUMBERS = 1024, 1 << 22
BLOCK = 2048
TILE = ["label", "dim", "list", "i", "j"]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest parts to about one, which changes no direction and no digit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def _valid(kind: type):
    """kind: numpy's type of the components as they came, in which they are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if i is None or label is None or not v or None in v:
                    continue
                x = np.array(v, kind)
                if not np.isfinite(x).all() or not x.any():
                    continue
                h = xxhash.xxh3_128_intdigest((x + kind(0)).tobytes())
                rows.append((i, label, len(x), (h >> 65), (h & (1 << 63) - 1), x.tobytes()))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["vec_id", "label", "dim", "h1", "h2", "v"])

    return run


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(16, NUMBERS // len(c))
    return np.concatenate([squared(x[i : i + step], c).argmin(1) for i in range(0, len(x), step)])


def lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centroids (fewer if x has fewer rows); beyond FLAT of them, those of each of the groups that the square root of k centroids make."""
    if k > FLAT:
        near = nearest(x, top := lloyd(x, int(k**0.5), rounds, rng))
        return np.concatenate([lloyd(x[near == g], max(1, round(k * n / len(x))), rounds, rng) for g, n in enumerate(np.bincount(near, minlength=len(top))) if n])
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Index:
    """Coarse centroids and codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.coarse = lloyd(sample, lists, 8, rng)
        residual = sample - self.coarse[nearest(sample, self.coarse)]
        self.width = self.dim // PARTS
        self.books = [lloyd(residual[:, p * self.width : (p + 1) * self.width], CODES, 8, rng) for p in range(PARTS)]

    def fit(self, v: np.ndarray) -> np.ndarray:
        """v with zeros up to the index's dimension."""
        return np.pad(v, (0, self.dim - len(v)))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """list, codes, error and the lists to probe (its own too) of each row of x."""
        d = squared(x, self.coarse)
        own = d.argmin(1)
        residual = x - self.coarse[own]
        codes = np.stack([nearest(residual[:, p * self.width : (p + 1) * self.width], b) for p, b in enumerate(self.books)], 1).astype(np.uint8)
        made = np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], 1)
        gap = np.sqrt(squared(self.coarse[own], self.coarse))
        border = (d - d[np.arange(len(x)), own][:, None]) / (2 * np.where(gap > 0, gap, np.inf))
        border[np.arange(len(x)), own] = 0
        return own, codes, np.linalg.norm(residual - made, axis=1), [np.flatnonzero(r <= MARGIN).astype(np.int32) for r in border]

    def tables(self, q: np.ndarray, of: int) -> np.ndarray:
        """Squared distances of each query's residual to each code: queries x PARTS x codes."""
        r = q - self.coarse[of]
        out = np.full((len(q), PARTS, CODES), np.inf)
        for p, b in enumerate(self.books):
            out[:, p, : len(b)] = squared(r[:, p * self.width : (p + 1) * self.width], b)
        return out


def trained(classes: DataFrame, kind: type, sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> Index | None:
    """An index fitted to at least sample vectors, and to eight for each list, but to at most size bytes of them; None if there is no vector."""
    n, dim = classes.agg(F.count("*"), F.max("dim")).first()
    if not n:
        return None
    lists, full = int(n**0.5 / 2), -(-dim // PARTS) * PARTS
    most = max(1, min(max(sample, 8 * lists), size // (8 * full)))
    rows = classes.select("vec_id", "h1", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "h1").limit(most).collect()
    x = np.zeros((len(rows), full))
    for i, r in enumerate(rows):
        v = unit(np.frombuffer(r["v"], kind).astype(np.float64))
        x[i, : len(v)] = v
    return Index(x, max(1, min(lists, len(rows) // 8)))


PLACED = "label string, dim int, list int, kind int, vec_id long, h1 long, own int, codes binary, error double, probes binary"
SURVIVED = "label string, dim int, list int, i int, j int, kind int, vec_id long, h1 long, own int, probes binary"


def placed(index: Index, kind: type):
    """Rows of the index (kind 0: codes, their error, the lists that the vector probes), and of its queries (kind 1, one per list to probe: the vector in
    bytes after its scale, its rounding error, its own list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(16, NUMBERS // len(index.coarse) // 4)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                x = np.stack([index.fit(unit(np.frombuffer(v, kind).astype(np.float64))) for v in column("v").to_pylist()])
                own, codes, error, probes = index.place(x)
                scale = (np.abs(x).max(1) / 127).astype(np.float32)
                small = np.round(x / scale[:, None].astype(np.float64)).astype(np.int8)
                off = np.linalg.norm(x - small * scale[:, None].astype(np.float64), axis=1)
                many = np.array([len(p) for p in probes])
                i = np.concatenate([np.arange(len(x)), np.repeat(np.arange(len(x)), many)])
                asks = np.arange(len(i)) >= len(x)
                packed = [codes[k].tobytes() for k in range(len(x))], [scale[k].tobytes() + small[k].tobytes() for k in range(len(x))]
                take = pa.array(i, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[column(c).take(take) for c in ("label", "dim")],
                        pa.array(np.concatenate([own, *probes]).astype(np.int32)),
                        pa.array(asks.astype(np.int32)),
                        *[column(c).take(take) for c in ("vec_id", "h1")],
                        pa.array(own[i].astype(np.int32)),
                        pa.array([packed[int(a)][k] for k, a in zip(i.tolist(), asks.tolist(), strict=True)], pa.binary()),
                        pa.array(np.where(asks, off[i], error[i])),
                        pa.array([None if a else probes[k].tobytes() for k, a in zip(i.tolist(), asks.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["label", "dim", "list", "kind", "vec_id", "h1", "own", "codes", "error", "probes"],
                )

    return run


def survivors(index: Index):
    """Of blocks of a list: the queries and the rows that have a pair which codes do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, TILE):
            asked = group["kind"].to_numpy() == 1
            rows, asks = np.flatnonzero(~asked), np.flatnonzero(asked)
            if not len(rows) or not len(asks):
                continue
            error, data = group["error"].to_numpy(), group["codes"]
            codes = np.stack([np.frombuffer(c, np.uint8) for c in data.take(rows).to_pylist()])
            raw = data.take(asks).to_pylist()
            x = np.stack([np.frombuffer(b, np.int8, offset=4) for b in raw]) * np.array([np.frombuffer(b, np.float32, 1)[0] for b in raw], np.float64)[:, None]
            of, left = int(group["list"][0].as_py()), np.zeros(group.num_rows, bool)
            step = max(1, min(128, NUMBERS // len(rows)))
            for at in range(0, len(asks), step):
                t = index.tables(x[at : at + step], of)
                d = np.zeros((len(t), len(rows)))
                for p in range(PARTS):
                    d += t[:, p].take(codes[:, p], 1)
                near = d <= (REACH + error[rows][None] + error[asks[at : at + step]][:, None] + 1e-9) ** 2
                same = (group["vec_id"].to_numpy()[asks[at : at + step]][:, None] == group["vec_id"].to_numpy()[rows][None]) & (group["h1"].to_numpy()[asks[at : at + step]][:, None] == group["h1"].to_numpy()[rows][None])
                near &= ~same
                left[asks[at : at + step]] |= near.any(1)
                left[rows] |= near.any(0)
            if left.any():
                yield from group.take(pa.array(np.flatnonzero(left))).select([*TILE, "kind", "vec_id", "h1", "own", "probes"]).combine_chunks().to_batches()

    return run


def compared(kind: type):
    """From blocks of survivors with their vectors: (kind 0, label, dim, vec_id, h1, links) of queries and rows, and (kind 1, -, -, a, -, b) for a spanning
    forest of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, TILE):
            asked = group["kind"].to_numpy() == 1
            rows, asks = np.flatnonzero(~asked), np.flatnonzero(asked)
            if not len(rows) or not len(asks):
                continue
            ids, tie, copies, own = (group[c].to_numpy() for c in ("vec_id", "h1", "copies", "own"))
            of, label, dim = (group[c][0].as_py() for c in ("list", "label", "dim"))
            raw = scaled(np.stack([np.frombuffer(v, kind) for v in group["v"].to_pylist()]).astype(np.float64))
            norm = np.sqrt((raw * raw).sum(1))
            # which lists each row probes, and with that whether a query of another list is found by it as well
            pairs = [(r, int(k)) for r, p in enumerate(group["probes"].take(rows).to_pylist()) for k in np.frombuffer(p, np.int32)]
            lists = {k: n for n, k in enumerate(sorted({int(k) for k in own[asks]}))}
            back = np.zeros((len(rows), len(lists)), bool)
            for r, k in pairs:
                if k in lists:
                    back[r, lists[k]] = True
            place = np.array([lists[int(k)] for k in own[asks]])
            node = {i: k for k, i in enumerate(dict.fromkeys(ids.tolist()))}
            at_node, known, names = np.array([node[i] for i in ids.tolist()]), Union(len(node)), list(node)
            links, a, b = np.zeros(group.num_rows, np.int64), [], []
            step = max(1, min(128, NUMBERS // len(rows)))
            for at in range(0, len(asks), step):
                q = asks[at : at + step]
                cos = (raw[q] @ raw[rows].T) / (norm[q][:, None] * norm[rows][None])
                qs, xs = np.nonzero((cos >= COSINE - 1e-9) & ((ids[q][:, None] != ids[rows][None]) | (tie[q][:, None] != tie[rows][None])))
                u, w = q[qs], rows[xs]
                # a product of matrices may add in another order than a sum of products
                hit = (raw[u] * raw[w]).sum(1) / (norm[u] * norm[w]) >= COSINE
                u, w, one_way = u[hit], w[hit], ~back[xs[hit], place[at + qs[hit]]]
                np.add.at(links, u, copies[w])
                np.add.at(links, w[one_way], copies[u[one_way]])
                x, y = at_node[u], at_node[w]
                roots = known.roots()
                for k in np.flatnonzero(roots[x] != roots[y]).tolist():
                    if known.join(int(x[k]), int(y[k])):
                        a.append(names[x[k]])
                        b.append(names[y[k]])
            some = np.flatnonzero(links)
            n, m = len(some), len(a)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * n + [1] * m, pa.int32()),
                    pa.array([label] * (n + m), pa.string()),
                    pa.array([dim] * (n + m), pa.int32()),
                    pa.array([*ids[some].tolist(), *a], pa.int64()),
                    pa.array([*tie[some].tolist(), *[0] * m], pa.int64()),
                    pa.array([*links[some].tolist(), *b], pa.int64()),
                ],
                names=["kind", "label", "dim", "a", "h1", "b"],
            )

    return run


def dealt(rows: DataFrame, number: str, *order: str) -> DataFrame:
    """rows dealt by tile: the tiles of a list in turn, from a partition that its hash gives."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to = F.pmod(F.pmod(F.xxhash64("label", "dim", "list"), F.lit(n)) + F.expr(number), F.lit(n)).cast("int")
    return rows.repartitionById(n, to).sortWithinPartitions(*TILE, *order)


def searched(classes: DataFrame, index: Index, kind: type, block: int) -> DataFrame:
    """(kind, label, dim, a, h1, b) as compared() gives it, stored in the scope around the present one."""
    at = ["label", "dim", "list"]
    every = stored(classes.mapInArrow(placed(index, kind), PLACED), "placed")
    sizes = every.groupBy(*at).agg(F.count_if(F.col("kind") == 0).alias("n0"), F.count_if(F.col("kind") == 1).alias("n1"))
    # written, so that Spark knows how small it is before it deals out what it is joined to
    sizes = stored(sizes.filter("n0 > 0").select(*at, F.ceil(F.col("n0") / block).cast("int").alias("b0"), F.ceil(F.col("n1") / block).cast("int").alias("b1")), "sizes")
    lot = F.xxhash64("vec_id", "h1", F.lit(3))
    ask = F.col("kind") == 1
    i = F.when(ask, F.sequence(F.lit(0), F.col("b0") - 1)).otherwise(F.array(F.pmod(lot, F.col("b0")).cast("int")))
    j = F.when(ask, F.array(F.pmod(lot, F.col("b1")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("b1") - 1))
    tiles = every.join(sizes, at).withColumn("i", F.explode(i)).withColumn("j", F.explode(j))
    left = stored(dealt(tiles, "cast(i as long) * b1 + j", "kind", "vec_id").drop("b0", "b1").mapInArrow(survivors(index), SURVIVED).hint("rebalance"), "survivors")
    key = ["label", "dim", "vec_id", "h1"]
    few = sifted(classes.select(*key, "copies", "v"), F.col("h1"), sieve(left.select("h1")), True)
    whole = left.join(few, key).join(sizes, at)
    return keep_out(dealt(whole, "cast(i as long) * b1 + j", "kind", "vec_id").drop("b0", "b1").mapInArrow(compared(kind), "kind int, label string, dim int, a long, h1 long, b long").hint("rebalance"), "found")


def linked(vectors: DataFrame, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, label, embedding)."""
    kind, parts = (np.float32, "float") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else (np.float64, "double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{parts}>").alias("embedding"))
    valid = stored(rows.mapInArrow(_valid(kind), "vec_id long, label string, dim int, h1 long, h2 long, v binary"), "vectors")
    key = ["label", "dim", "h1", "h2"]
    same = valid.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    with scope(vectors.sparkSession):
        classes = stored(valid.groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.min("v").alias("v")), "classes")
        index = trained(classes, kind, sample)
        found = searched(classes, index, kind, block) if index else keep_out(classes.limit(0).select(F.lit(0).alias("kind"), "label", "dim", F.col("vec_id").alias("a"), "h1", F.col("vec_id").alias("b")), "found")
    every = valid.select("vec_id", *key).join(same, key)
    copied = every.filter("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    roots = components(found.filter("kind = 1").select("a", "b").unionByName(copied))
    links = found.filter("kind = 0").groupBy("label", "dim", F.col("a").alias("rep"), "h1").agg(F.sum("b").alias("links"))
    counts = every.join(links, ["label", "dim", "rep", "h1"], "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    done = counts.groupBy("vec_id").agg(F.max("n_links").alias("n_links")).join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = rows.select("vec_id").join(done, "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def report(vectors: DataFrame) -> DataFrame:
    return linked(vectors)
