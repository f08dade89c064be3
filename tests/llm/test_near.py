"""Near-duplicate operators against plain Python over all pairs."""

import itertools
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import components as graphs
from vellum.llm import dedup, embeddings
from vellum.llm.common import sieve, sifted


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def shingle_set(text):
    said = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        said = said.replace(c, " ")
    words = [w for w in said.split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def texts_of(rng, n=160):
    """Texts with copies, edits of every size, shared passages, short ones and empty ones."""
    words = [f"w{i}" for i in range(400)] + ["É", "naïve", "ſ"]
    base = [list(rng.choice(words, rng.integers(3, 120))) for _ in range(n // 4)]
    passage = list(rng.choice(words, 60))
    out = []
    for i in range(n):
        t = list(base[rng.integers(len(base))])
        for _ in range(int(rng.integers(0, 4))):
            t[int(rng.integers(len(t)))] = "edit" + str(rng.integers(1000))
        if i % 5 == 0:
            t = t + passage
        out.append(" ".join(t) if i % 3 else "\t".join(t).upper() + "\n")
    return [*out, None, "", " \n ", "one two", "One TWO", "one two three four five"]


def expected(rows, over, under):
    sets = [(i, shingle_set(t)) for i, t in rows]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if s and t and under * len(s & t) >= over * len(s | t)]
    root = components([i for i, _ in rows], links)
    return sorted((i, len(s), root[i], root[i] == i) for i, s in sets)


@pytest.mark.parametrize("similarity", [(85, 100), (4, 5), (1, 1)])
def test_minhash_equals_all_pairs(spark, similarity):
    rows = list(enumerate(texts_of(np.random.default_rng(similarity[0]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in dedup.linked(docs, similarity).collect())
    assert got == expected(rows, *similarity)
    assert sum(r[3] for r in got) < len(got)


@pytest.mark.parametrize("similarity", [(4, 5), (85, 100), (9, 10)])
def test_minhash_links_short_texts_that_differ_by_a_word(spark, similarity):
    said = [[f"{c}{i}" for i in range(24)] for c in "abcdefghijklmnop"]
    rows = list(enumerate(" ".join(t[:n]) for n, t in enumerate(said, 4) for n in (n, n + 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in dedup.linked(docs, similarity).collect())
    assert got == expected(rows, *similarity)
    # the shortest linked pair has over / (under - over) shingles: 8 words against 9 at 0.8, 10 against 11 at 0.85
    least = min(r[1] for r in got if not r[3])
    assert least - 1 == -(-similarity[0] // (similarity[1] - similarity[0]))


@pytest.mark.parametrize("similarity", [(4, 5), (85, 100)])
def test_minhash_equals_all_pairs_of_every_small_size(spark, similarity):
    """For each two set sizes from 1 to 12, two texts of their own words that share all shingles of the smaller set."""
    rows = [" ".join(f"s{m}x{n}w{i}" for i in range(size + 4)) for m in range(1, 13) for n in range(m, 13) for size in (m, n)]
    rows = list(enumerate(rows))
    got = sorted(tuple(r) for r in dedup.linked(spark.createDataFrame(rows, "doc_id long, text string"), similarity).collect())
    assert got == expected(rows, *similarity)


def shared_shingles(sets):
    """{(a, b): how many} of all pairs of sets that share a shingle, by counting."""
    held, out = defaultdict(list), Counter()
    for i, s in sets:
        for x in s:
            held[x].append(i)
    for ids in held.values():
        out.update(itertools.combinations(ids, 2))
    return out


@pytest.mark.parametrize("similarity", [(4, 5), (85, 100)])
def test_minhash_over_a_thousand_documents_equals_all_pairs(spark, sf_dir, similarity):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sets = [(r.doc_id, shingle_set(r.text)) for r in docs.collect()]
    size, (over, under) = {i: len(s) for i, s in sets}, similarity
    root = components(list(size), [p for p, n in shared_shingles(sets).items() if under * n >= over * (size[p[0]] + size[p[1]] - n)])
    got = sorted(tuple(r) for r in dedup.linked(docs, similarity).collect())
    assert got == sorted((i, n, root[i], root[i] == i) for i, n in size.items())
    assert sum(not r[3] for r in got) > 10
    assert sorted(r.doc_id for r in dedup.keep(docs, similarity).collect()) == [r[0] for r in got if r[3]]


def test_of_rows_with_one_doc_id_the_first_text_stays(spark):
    rows = [(1, "b c d e f g", 1), (1, "a b c d e f", 2), (1, None, 3), (1, "a b c d e f", 1), (2, "z y x w v u", 1), (3, "a b c d e f", 9), (None, "a b c d e f", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id int").repartition(4)
    assert sorted(map(tuple, dedup.keep(docs).collect()), key=str) == sorted([(1, "a b c d e f", 1), (2, "z y x w v u", 1), (None, "a b c d e f", 4)], key=str)


def test_a_sieve_loses_nothing_and_holds_little_back(spark):
    ids = spark.range(0, 20_000, 2).withColumnRenamed("id", "x")
    rows = spark.range(20_000).withColumn("word", F.lit(1)).unionByName(spark.createDataFrame([(None, 1)], "id long, word int"))
    inside, outside = (sifted(rows, F.col("id"), sieve(ids), side) for side in (True, False))
    assert inside.count() + outside.count() == 20_001 and outside.columns == rows.columns
    assert outside.filter("id % 2 = 0").count() == 0 and inside.count() < 10_500
    assert outside.filter("id is null").count() == 1 and sieve(ids.limit(0)).count() == 0


def test_stored_tables_go_when_they_are_done_with(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir()) if shared.exists() else set()
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}") for i in range(20)], "doc_id long, text string")
    assert dedup.keep(docs).count() == 10
    assert [p.name.partition("-")[0] for p in set(shared.iterdir()) - before] == ["linked"]


def test_minhash_blocks_give_the_same(spark, monkeypatch):
    rows = list(enumerate(texts_of(np.random.default_rng(3))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(dedup, "BLOCK", 4)
    monkeypatch.setattr(dedup, "BLOCK_SHINGLES", 200)
    assert sorted(tuple(r) for r in dedup.linked(docs, (85, 100)).collect()) == expected(rows, 85, 100)


def test_a_large_group_of_near_copies_costs_in_proportion(spark, monkeypatch):
    """1,500 different copies of one text among others: rows that meet in tiles are about as many as list members, not their square by blocks."""
    rng = np.random.default_rng(9)
    text = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(1500):
        t = list(text)
        for at in rng.integers(400, size=int(rng.integers(1, 4))):
            t[at] = f"edit{i}"
        rows.append((i, " ".join(t)))
    rows += [(5000 + i, " ".join([*text[:60], *(f"x{i}y{j}" for j in range(200))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    monkeypatch.setattr(dedup, "BLOCK", 50)
    monkeypatch.setattr(dedup, "BLOCK_SHINGLES", 20_000)
    met, dealt = [], dedup.dealt
    monkeypatch.setattr(dedup, "dealt", lambda rows, payload: met.append(rows.count()) or dealt(rows, payload))
    got = {r.doc_id: r.component_id for r in dedup.linked(docs).collect()}
    assert all(got[i] == (0 if i < 5000 else i) for i in got)
    assert sum(met) < 2 * (dedup.KEYS + 1) * len(rows)


def test_members_of_lists_are_made_twice_at_most(spark):
    """Once for the lists' sizes, once for their members, also where lists have several blocks: 300 sets of one key, ten of each alike, and of a key of their own."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(2)
    kinds = [np.sort(rng.integers(1 << 32, size=dedup.SKETCH, dtype=np.uint32)).tobytes() for _ in range(30)]
    light = spark.createDataFrame([(key, i, 1, i) for i in range(300) for key in (-1, i // 2)], "key long, node long, weight int, seed long")
    payload = spark.createDataFrame([(i, 100, kinds[i // 10]) for i in range(300)], "node long, n long, sketch binary")
    links = dedup.links_within(light.mapInArrow(counted, light.schema), payload, 40, dedup._candidates((4, 5))).collect()
    assert components(range(300), links) == {i: i // 10 * 10 for i in range(300)}
    assert made.value <= 2 * 600


def test_a_small_graph_takes_no_rounds(spark, monkeypatch):
    """A chain, a star, a loop and random links: their components are written twice at most, and are those of rounds."""
    rng = np.random.default_rng(6)
    links = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 100)] + [(-7, -7)] + [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(400, size=(250, 2))]
    edges = spark.createDataFrame(links, "a long, b long").repartition(5)
    root = components({i for p in links for i in p}, links)
    want = sorted((i, r) for i, r in root.items() if i != r)
    assert sorted(map(tuple, graphs.components(edges).collect())) == want
    written, stored = [], graphs.stored
    monkeypatch.setattr(graphs, "stored", lambda df, name: written.append(name) or stored(df, name))
    assert sorted(map(tuple, graphs.components(edges, len(links)).collect())) == want and len(written) == 2
    assert graphs.components(edges.limit(0), 10).count() == graphs.components(edges.filter("a = b"), 10).count() == 0


def test_minhash_solves_small_graphs_in_one_task(spark, monkeypatch):
    written, stored = [], graphs.stored
    monkeypatch.setattr(graphs, "stored", lambda df, name: written.append(name) or stored(df, name))
    said = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*said, *(f"x{j}" for j in range(i))])) for i in range(12)]
    got = sorted(tuple(r) for r in dedup.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == expected(rows, 4, 5) and {r[2] for r in got} == {0}
    # links between sketches, then those between full sets: what there is, and its components
    assert len(written) <= 4


def test_texts_with_one_passage_lose_no_link(spark, monkeypatch):
    """900 texts with one passage, every tenth followed by near copies, and texts that are little but the passage: no link is lost."""
    rng = np.random.default_rng(11)
    passage, rows = [f"p{j}" for j in range(40)], []
    for i in range(900):
        body = [f"t{i}w{j}" for j in range(260)]
        for k in range(3 if i % 10 == 0 else 1):
            t = list(body)
            for at in rng.integers(260, size=3 * (k > 0)):
                t[at] = f"e{i}x{k}"
            rows.append(" ".join(t[:100] + passage + t[100:]))
    rows += [" ".join([*passage, *(f"s{i}w{j}" for j in range(n))]) for n in (0, 1, 4, 8, 20) for i in range(12)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    monkeypatch.setattr(dedup, "BLOCK", 30)
    sets = [(i, shingle_set(t)) for i, t in rows]
    size = {i: len(s) for i, s in sets}
    root = components(list(size), [p for p, n in shared_shingles(sets).items() if 5 * n >= 4 * (size[p[0]] + size[p[1]] - n)])
    got = {r.doc_id: r.component_id for r in dedup.linked(docs).collect()}
    assert got == root and sum(root[i] != i for i in root) >= 180


def test_minhash_edges(spark):
    long = " ".join(f"w{i % 9973}" for i in range(200_000))
    rows = [(1, long, "x"), (2, long + " tail", "y"), (None, long, "z"), (None, None, None), (3, "a b c d e f", "q"), (3, "g h i j k l", "q"), (4, "g h i j k l", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT_ string").withColumnRenamed("TEXT_", "root")
    got = {(r.doc_id, r.component_id, r.kept) for r in dedup.report(docs).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (4, 3, False)}
    kept = dedup.keep(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (True, 0), (True, 0)]
    none = docs.limit(0)
    assert dedup.report(none).count() == dedup.keep(none).count() == 0


def test_minhash_refuses_what_its_keys_do_not_cover(spark):
    with pytest.raises(ValueError):
        dedup.linked(spark.createDataFrame([(1, "a")], "doc_id long, text string"), (1, 2))


def vectors_of(rng, n=700, dim=64):
    centres = rng.normal(size=(n // 10, dim))
    v = centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, dim)) * rng.choice([0.0, 0.05, 0.12, 0.16, 0.4], size=(n, 1))
    return v * rng.uniform(0.1, 9, (n, 1))


def brute(rows):
    ok = []
    for i, v, label in rows:
        x = None if v is None or label is None or None in v else np.array(v, np.float64)
        if i is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            ok.append((i, label, x))
    links = [(a, b) for k, (a, la, x) in enumerate(ok) for b, lb, y in ok[:k] if la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98]
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, components([r[0] for r in rows], links)


@pytest.mark.parametrize("block", [embeddings.BLOCK, 40])
def test_embeddings_against_all_pairs(spark, block):
    rng = np.random.default_rng(11)
    rows = [(i, [float(np.float32(x)) for x in v], int(rng.integers(2))) for i, v in enumerate(vectors_of(rng))]
    rows += [(i + len(rows), v, 1) for i, v in enumerate([None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] * 64, [None] * 64, [1.0], [1.0, 2.0]])]
    rows += [(len(rows), rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r.vec_id: r for r in embeddings.linked(df, block=block).collect()}
    n, root = brute(rows)
    assert len(got) == len(rows) and sum(n.values()) > 500
    assert {i: r.n_links for i, r in got.items()} == n
    assert all(r.component_id == root[i] and r.kept == (root[i] == i) for i, r in got.items())


@pytest.mark.parametrize("dims", [2, 3, 20])
def test_embeddings_of_few_dimensions_lose_no_link(spark, dims):
    """64 components that vary in a few directions only, so that many links cross the borders of lists; small blocks, many lists."""
    rng = np.random.default_rng(dims)
    n = 6000
    v = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, 64))
    v = v[: n // 2] if dims == 2 else v
    near = v[::3] + rng.normal(size=(len(v[::3]), dims)) @ rng.normal(size=(dims, 64)) * 0.08
    v = np.concatenate([v, near])
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embeddings.linked(df, block=500).collect()}
    x = v / np.linalg.norm(v, axis=1)[:, None]
    want = [int((x[i] @ x.T >= 0.98).sum()) - 1 for i in range(len(x))]
    off = sum(got[i] != w for i, w in enumerate(want))
    # a cosine of 0.98 to the last digit may fall to either side
    assert off <= len(want) // 1000 and sum(want) > 1000, (off, sum(want))


def test_embeddings_link_by_direction_whatever_their_length(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1e-200, 2e-200]), (3, [1e200, 2e200]), (4, [5e-324, 0.0]), (5, [1.0, 0.0]), (6, [1e308, 1e308]), (7, [1.0, 1.0]), (8, [-1.0, -2.0]), (9, [-0.0, 3.0]), (10, [0.0, 3.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.report(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (0, 8), 9: (1, 9), 10: (1, 9)}


def test_embeddings_with_a_large_group_of_near_copies(spark):
    """A third of all vectors lie together, many of them equal: counts are whole and blocks stay small."""
    rng = np.random.default_rng(5)
    one = rng.normal(size=64)
    v = [*(one + rng.normal(size=(1500, 64)) * 0.05), *[one] * 500, *rng.normal(size=(4000, 64))]
    df = spark.createDataFrame([(i, [float(np.float32(c)) for c in x], i % 7 == 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label boolean")
    got = {r.vec_id: r for r in embeddings.linked(df, block=100).collect()}
    x = np.array([[float(np.float32(c)) for c in y] for y in v])
    x /= np.linalg.norm(x, axis=1)[:, None]
    for label in (True, False):
        ids = np.array([i for i in range(len(x)) if (i % 7 == 0) == label])
        want = (x[ids] @ x[ids].T >= 0.98).sum(1) - 1
        assert [got[i].n_links for i in ids.tolist()] == want.tolist() and want.max() > 200


def test_lists_grow_with_the_table(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 16))
    monkeypatch.setattr(embeddings, "FLAT", 50)
    c = embeddings.lloyd(x, 300, 4, rng)
    assert 250 <= len(c) <= 350
    flat = embeddings.squared(x, embeddings.lloyd(x, 50, 4, rng)).min(1).mean()
    assert embeddings.squared(x, c).min(1).mean() < flat


def test_embeddings_recall_over_a_table(spark, sf_dir):
    """The table and, as it has few links of its own, a near copy of each of its vectors at a cosine of about 0.98 to 1."""
    rng = np.random.default_rng(4)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    for i, v, label in rows[:]:
        x = np.array(v)
        noise = rng.normal(size=len(x))
        y = x + noise * np.linalg.norm(x) / np.linalg.norm(noise) * rng.uniform(0, 0.21)
        rows.append((100_000 + i, [float(np.float32(c)) for c in y], label))
    n, root = brute(rows)
    got = embeddings.report(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert all(r.n_links <= n[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) == sum(n.values()) > len(rows) / 3
    assert all(r.component_id == root[r.vec_id] for r in got)


def test_embeddings_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0, "a"), (2, v, 0, "b"), (2, v, 0, "b"), (None, v, 0, "c"), (7, None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, h1 string")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embeddings.report(df).collect())
    assert got == [(0, 0, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (7, 0, 7, True)]
    assert embeddings.report(df.limit(0)).count() == 0
