"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Every text becomes its set of hashed five-word shingles; the SKETCH smallest hashes are its sketch. Texts with one set are one class, whose
   smallest doc_id stands for it.
2. Inverted lists of the KEYS smallest hashes of each class generate overlaps: two sets with similarity s lack a shared one with a chance of about
   (1 - s)^KEYS, 3e-6 at 0.8. No list is capped: see links_within() for those of more than BLOCK classes.
3. In a list the union sketch estimates similarity; pairs that may reach the threshold (five standard errors of slack) link candidates. Only
   a spanning forest is emitted, so a group of many copies gives as many rows as it has members.
4. Within the components of these links the full sets are built again from the texts and intersected exactly; a pair whose ends are connected
   by verified links already is left out, as it cannot change a component. Components of more than BLOCK_SHINGLES are cut likewise. Texts outside these
   components are left out by a sieve before anything is shuffled, and keep() shuffles only what a sieve of the dropped ids holds back.

Words are [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased. Defined results: fewer than five words are one shingle; a null text or one without words has no
shingle and is linked with nothing; a null doc_id is linked with nothing and kept; rows with one doc_id are one document, linked by any of its texts, of
which keep() keeps the row whose text comes first (by code point, null last; rows of one text by their JSON); an empty table gives an empty table;
other columns pass through keep().
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.arrow import only, small_batches
from vellum.llm.common import fresh, keep_out, named, scope, sieve, sifted, stored
from vellum.llm.components import components
from vellum.llm.groups import Union, runs

WORDS, SKETCH, KEYS = 5, 64, 8
#: Least similarity as a fraction, so that sizes are compared in whole numbers.
SIMILARITY = (4, 5)
#: Members of a list, and shingles of a component, that are compared with each other at once.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Graphs of at most so many links, 4 MiB of them, are solved in one task.
AT_ONCE = 1 << 18
#: What rows are grouped by: a list's key, whether the tile is of a block, of two blocks of one side, or of blocks of two sides, and the blocks.
TILE, OWN, WITHIN, ACROSS = ["key", "kind", "i", "j"], 0, 1, 2
NONE = np.uint32(0xFFFFFFFF)
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Words(dict):
    """Hashes of words, made when first asked for; forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit number."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: Words) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    said = (text or "").encode().lower().split()
    if not said:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, said), np.uint64, len(said))
    with np.errstate(over="ignore"):
        if len(w) < WORDS:
            return mixed((w * FACTORS[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
        h = w[: len(w) - WORDS + 1] * FACTORS[0]
        for j in range(1, WORDS):
            h += w[j : len(w) - WORDS + 1 + j] * FACTORS[j]
        return np.unique(mixed(h))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(t, words) for t in part.column(1).to_pylist()]
            digest = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signed(d & (1 << 64) - 1) for d in digest], pa.int64()),
                    pa.array([signed(d >> 64) for d in digest], pa.int64()),
                    pa.array([s[:KEYS].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([(s[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "n", "h1", "h2", "keys", "sketch"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), h1, h2 (the set's digest), keys, sketch."""
    small_batches(docs)
    ids = docs.select(named("doc_id").cast("long").alias("doc_id"), named("text").alias("text"))
    return ids.mapInArrow(_sketches, "doc_id long, n long, h1 long, h2 long, keys array<long>, sketch binary")


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity of one sketch to each of others, from the sketches of their unions."""
    x = np.sort(np.concatenate([others, np.broadcast_to(one, others.shape)], 1), 1)
    twice = np.zeros(x.shape, bool)
    twice[:, 1:] = (x[:, 1:] == x[:, :-1]) & (x[:, 1:] != NONE)
    rank = np.cumsum(~twice & (x != NONE), 1)
    size = np.minimum(rank[:, -1], SKETCH)
    return (twice & (rank <= size[:, None])).sum(1) / np.maximum(size, 1)


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _forest(ids: np.ndarray, sizes: np.ndarray, similarity: tuple[int, int], compare, link, seed: np.ndarray, side: np.ndarray | None) -> None:
    """Links pairs of a block: compare(i, js) says which of js go with i. Pairs that are connected already, as those of one seed are, are not
    compared, nor are those of one side, if sides are given.
    """
    n, known = len(ids), Union(len(ids))
    _, first, of = np.unique(seed, return_index=True, return_inverse=True)
    known.up = np.minimum(first[of], np.arange(n))
    least, most = sizes * similarity[0], sizes * similarity[1]
    for i in range(n - 1):
        js = np.arange(i + 1, n)
        roots = known.roots()
        js = js[(roots[js] != roots[i]) & (least[js] <= most[i]) & (least[i] <= most[js])]
        if side is not None:
            js = js[side[js] != side[i]]
        if len(js):
            for j in js[compare(i, js)].tolist():
                if known.join(i, j):
                    link(int(ids[i]), int(ids[j]))


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
    """The seeds of a tile's rows, and their sides where only pairs across matter."""
    return group["seed"].to_numpy(), group["side"].to_numpy() if group["kind"][0].as_py() == ACROSS else None


def _candidates(similarity: tuple[int, int]):
    wanted = similarity[0] / similarity[1]
    enough = wanted - 5 * (wanted * (1 - wanted) / SKETCH) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for group in runs(batches, TILE):
            if group.num_rows > 1:
                ids = group["node"].to_numpy()
                sizes = group["n"].to_numpy()
                sk = np.full((len(ids), SKETCH), NONE, np.uint32)
                for r, s in enumerate(group["sketch"].to_pylist()):
                    v = np.frombuffer(s, np.uint32)
                    sk[r, : len(v)] = v
                _forest(ids, sizes, similarity, lambda i, js: estimates(sk[i], sk[js]) >= enough, lambda x, y: (a.append(x), b.append(y)), *_sides(group))  # noqa: B023
            if len(a) > 10_000:
                yield _edges(a, b)
                a.clear(), b.clear()
        yield _edges(a, b)

    return run


def _verified(similarity: tuple[int, int]):
    over, under = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        a: list[int] = []
        b: list[int] = []
        for group in runs(batches, TILE):
            if group.num_rows > 1:
                ids = group["node"].to_numpy()
                sets = [shingles(t, words) for t in group["text"].to_pylist()]
                sizes = np.array([len(s) for s in sets])
                starts = np.concatenate([[0], np.cumsum(sizes)])
                values, place = np.unique(np.concatenate(sets), return_inverse=True)
                mark = np.zeros(len(values), bool)

                def same(i: int, js: np.ndarray) -> np.ndarray:
                    mark[place[starts[i] : starts[i + 1]]] = True  # noqa: B023
                    first = int(js[0])
                    hits = np.add.reduceat(mark[place[starts[first] :]].astype(np.int64), starts[first:-1] - starts[first])[js - first]  # noqa: B023
                    mark[place[starts[i] : starts[i + 1]]] = False  # noqa: B023
                    return under * hits >= over * (sizes[i] + sizes[js] - hits)  # noqa: B023

                _forest(ids, sizes, similarity, same, lambda x, y: (a.append(x), b.append(y)), *_sides(group))
            if len(a) > 10_000:
                yield _edges(a, b)
                a.clear(), b.clear()
        yield _edges(a, b)

    return run


def dealt(rows: DataFrame, payload: DataFrame) -> DataFrame:
    """rows (key, node, seed, side, tile) with their payload, by tile. The tiles of a key are dealt to partitions in turn, from a start that its hash gives, so that
    no two of them meet by chance."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to = F.pmod(F.pmod(F.xxhash64("key"), F.lit(n)) + F.col("tile.number"), F.lit(n)).cast("int").alias("to")
    flat = rows.join(payload, "node").select("key", "tile.kind", "tile.i", "tile.j", "node", "seed", "side", *[c for c in payload.columns if c != "node"], to)
    return flat.repartitionById(n, F.col("to")).drop("to").sortWithinPartitions(*TILE, "node")


def links_within(light: DataFrame, payload: DataFrame, block: int, compare) -> DataFrame:
    """(a, b): enough links among the members of each key for the components that all pairs would give. light: (key, node, weight, seed), nodes of one seed being
    connected already; payload: (node, ...), what compare, a function of Arrow batches, needs of a node.

    First, a key's members are cut into blocks of about block weight, and each block is compared within; four members, chosen by their ids, are in every
    block of their key. Where a key is one group of near copies, however large, these tie its blocks together, and the work is in proportion to its
    members. Then, for keys of several blocks whose members are not all connected, what is left is compared: members outside the key's largest
    component among each other and with that component's, in tiles of two blocks. So no key is capped, and no task holds more than two blocks; only
    members that are not alike cost more than in proportion.
    """
    tile = lambda kind, i, j, number: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"), number.cast("long").alias("number"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    zero, h = F.lit(0).cast("long"), F.xxhash64("node")
    sized = light.groupBy("key").agg(F.min("seed").alias("low"), F.max("seed").alias("high"), F.sum("weight").alias("w")).filter("low < high")
    lists = stored(sized.select("key", F.ceil(F.col("w") / block).cast("long").alias("blocks")), "lists")
    # light is made from every class, so it is read twice and no more: for the lists' sizes and for their members
    members = stored(light.join(lists, "key"), "members")
    large = members.filter("blocks > 1")
    any_large = not lists.filter("blocks > 1").isEmpty()
    rows, at = members, F.array(F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
    if any_large:
        pivots = large.groupBy("key").agg(F.array(F.min("node"), F.max("node"), F.min_by("node", h), F.max_by("node", h)).alias("pivots"))
        rows = members.join(stored(pivots, "pivots"), "key", "left")
        at = F.when(F.array_contains("pivots", F.col("node")), upto(F.col("blocks"))).otherwise(at)
    first = rows.select("key", "node", "seed", F.lit(0).alias("side"), F.explode(F.transform(at, lambda i: tile(OWN, i, zero, i))).alias("tile"))
    edges = stored(dealt(first, payload).mapInArrow(compare, "a long, b long").hint("rebalance"), "links")
    if not any_large:
        return edges
    roots = components(edges, AT_ONCE).select("node", F.col("root").alias("by_root"))
    mine = large.join(roots, "node", "left").select("key", "node", "weight", F.coalesce("by_root", "seed").alias("seed"))
    shares = mine.groupBy("key", "seed").agg(F.sum("weight").alias("w"))
    count = lambda w: F.ceil(w / block).cast("long")
    sides = shares.groupBy("key").agg(F.max_by("seed", F.struct("w", "seed")).alias("most"), count(F.max("w")).alias("bm"), count(F.sum("w") - F.max("w")).alias("bo"), F.count("*").alias("k"))
    rest = mine.join(sides.filter("k > 1"), "key").withColumn("side", (F.col("seed") != F.col("most")).cast("int"))
    rest = rest.withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("side") == 1, F.col("bo")).otherwise(F.col("bm"))))
    own, bo, bm = F.col("own"), F.col("bo"), F.col("bm")
    number = lambda i, j: (bo * (bo + 1) / 2).cast("long") + i * bm + j
    among = F.transform(upto(bo), lambda o: tile(WITHIN, F.least(o, own), F.greatest(o, own), F.greatest(o, own) * (F.greatest(o, own) + 1) / 2 + F.least(o, own)))
    other = F.concat(among, F.transform(upto(bm), lambda m: tile(ACROSS, own, m, number(own, m))))
    largest = F.transform(upto(bo), lambda o: tile(ACROSS, o, own, number(o, own)))
    second = rest.select("key", "node", "seed", "side", F.explode(F.when(F.col("side") == 1, other).otherwise(largest)).alias("tile"))
    return edges.unionByName(stored(dealt(second, payload).mapInArrow(compare, "a long, b long").hint("rebalance"), "links"))


def candidates(classes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): links between classes (rep, n, keys, sketch) whose sketches come near the threshold.

    Unequal sets are linked at n / (n + 1) at best, so sets with fewer shingles than reach that are left out.
    """
    over, under = similarity
    node = F.col("rep").alias("node")
    keyed = classes.filter(F.col("n") * (under - over) >= over).select(node, F.explode("keys").alias("key")).select("key", "node", F.lit(1).alias("weight"), F.col("node").alias("seed"))
    return links_within(keyed, classes.select(node, "n", "sketch"), BLOCK, _candidates(similarity))


def verified(docs: DataFrame, classes: DataFrame, groups: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): links between documents of one group (node, root) whose full sets reach the threshold."""
    every = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    sized = stored(every.join(classes.select(F.col("rep").alias("node"), F.col("n").alias("weight")), "node").select(F.col("root").alias("key"), "node", "weight", F.col("node").alias("seed")), "sized")
    texts = docs.select(named("doc_id").cast("long").alias("node"), named("text").alias("text"))
    return links_within(sized, sifted(texts, F.col("node"), sieve(sized.select("node")), True), BLOCK_SHINGLES, _verified(similarity))


def linked(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    if not 4 * similarity[1] <= 5 * similarity[0] <= 5 * similarity[1]:
        raise ValueError("similarity lies between 0.8, for which the keys suffice, and 1")
    s = stored(sketches(docs), "sketches")
    real = s.filter("n > 0 and doc_id is not null")
    keys = real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    classes = stored(real.join(keys.withColumnsRenamed({"h1": "k1", "h2": "k2"}), F.expr("h1 = k1 and h2 = k2 and doc_id = rep")).dropDuplicates(["h1", "h2"]).select("rep", "h1", "h2", "n", "keys", "sketch"), "classes")
    with scope(docs.sparkSession):
        near = components(candidates(classes, similarity), AT_ONCE)
        roots = keep_out(components(verified(docs, classes, near, similarity).unionByName(_shared_ids(real, keys)), AT_ONCE), "roots")
    named_classes = classes.select("h1", "h2", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("root", "rep").alias("component_id"))
    out = s.select("doc_id", "n", "h1", "h2").join(named_classes, ["h1", "h2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _shared_ids(real: DataFrame, keys: DataFrame) -> DataFrame:
    """Links between classes that hold rows of one doc_id."""
    ids = real.select("doc_id", "h1", "h2").distinct().groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id")
    return real.join(ids, "doc_id", "left_semi").select("doc_id", "h1", "h2").join(keys, ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def report(docs: DataFrame) -> DataFrame:
    return linked(only(docs, "doc_id", "text"), (85, 100))


def keep(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id. Columns as before."""
    with scope(docs.sparkSession):
        out = keep_out(linked(only(docs, "doc_id", "text"), similarity), "linked")
    (gone,) = fresh(docs, "gone_id")
    rows = _without(docs, out.filter("not kept").select(F.col("doc_id").alias(gone)).distinct())
    again = out.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias(gone)).agg(F.count("*").alias("c")).filter("c > 1").select(gone)
    if again.isEmpty():
        return rows
    key = named("doc_id").cast("long")
    many = sifted(rows, key, sieve(again), True).join(again, key == named(gone), "left_semi")
    whole = F.struct(*[named(c) for c in docs.columns])
    first = F.struct(named("text").isNull(), named("text"), F.to_json(whole))
    one = many.groupBy(key).agg(F.min_by(whole, first).alias("row")).select("row.*")
    return _without(rows, again).unionByName(one)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the doc_ids of ids (one column, of a name that docs has not). Only the rows that a sieve of ids holds back are shuffled."""
    key, marks = named("doc_id").cast("long"), sieve(ids)
    left = sifted(docs, key, marks, True).join(ids, key == named(ids.columns[0]), "left_anti")
    return sifted(docs, key, marks, False).unionByName(left)
