"""corpus_pipeline.run against plain Python, stage by stage."""

import hashlib
from collections import Counter
from pathlib import Path

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.test_near import expected
from vellum.llm import dedup, mixing, pieces, quality, secrets
from vellum.llm.common import stored

pipeline = pytest.importorskip("corpus_pipeline")


def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "test")
        out.append(docs)
    return out


def test_each_stage_equals_plain_python(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.01", "sf0.001")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good, alone, clean, mixed, ids = stages(spark, sf_dir)
    assert [x.columns for x in (good, alone, clean, mixed)] == [docs.columns] * 4

    model = quality.train(docs, labels)
    want = {r.doc_id for r in docs.collect() if model.score((r.text or "").encode()) >= quality.THRESHOLD}
    rows = {r.doc_id: r for r in good.collect()}
    assert set(rows) == want and 0 < len(want) < docs.count()

    first = {i for i, _, _, kept in expected([(i, r.text) for i, r in rows.items()], 4, 5) if kept}
    assert {r.doc_id for r in alone.collect()} == first and len(first) < len(rows)

    after = {r.doc_id: r for r in clean.collect()}
    assert set(after) == first
    enc = secrets.encoding(secrets.VOCABULARY)
    for i, r in after.items():
        base = secrets.base_spans(rows[i].text)
        assert r.text == secrets.redacted_text(rows[i].text, base + secrets.random_spans(rows[i].text, base, enc))
        assert r.n_chars == (len(r.text) if r.text != rows[i].text else rows[i].n_chars)

    taken = {r.doc_id: r.copies for r in mixing.report(clean, fitted=False).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in taken.items() if n})

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = ids.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in mixed.collect())
    assert all(list(r.ids) == sp.encode(after[r.doc_id].text) and r.round_trip for r in rows)


def test_run_is_its_stages_and_reruns_agree(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.01", "sf0.001")

    def digest(df):
        return sorted((r.doc_id, hashlib.sha256(str(list(r.ids)).encode()).hexdigest()) for r in df.select("doc_id", "ids").collect())

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir()) if shared.exists() else set()
    once = pipeline.run(spark, sf_dir)
    assert [p.name.partition("-")[0] for p in set(shared.iterdir()) - before] == ["stage"]
    assert digest(once) == digest(stages(spark, sf_dir)[-1])


def test_rows_of_odd_documents(spark, sf_dir):
    """Null ids, texts and sources, repeated rows and a very long text, stage by stage; a good text keeps what the classifier does to the rest apart."""
    sf_dir = sf_dir.replace("sf0.01", "sf0.001")
    good = max((r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), key=len)
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, good, "en", "a", 5), (1, good, "en", "a", 5), (2, good, None, None, None), (None, good, "en", "a", 5), (3, None, "en", "a", 0), (4, "", "en", None, 0), (4, "b", "en", None, 1), (5, long, "en", "b", 7), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    alone = stored(dedup.keep(docs), "odd")
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in alone.collect()) == sorted([(1, len(good)), (0, len(good)), (3, 0), (4, 0), (5, len(long)), (0, 0)])
    clean = stored(secrets.redact(alone), "odd")
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in alone.collect())
    mixed = stored(mixing.mix(clean), "odd")
    n = Counter((r.doc_id, r.source) for r in mixed.collect())
    taken = Counter({(r.doc_id, r.source): 0 for r in clean.collect()})
    for r in mixing.report(clean, fitted=False).collect():
        taken[(r.doc_id, r.source)] += r.copies
    assert n == +taken
    ids = pieces.encoded(mixed).collect()
    assert Counter((r.doc_id, r.source) for r in ids) == n and all(r.round_trip and (len(r.ids) > 0) == bool(r.text) for r in ids)
    for stage in (pipeline.near_dedup, pipeline.redact_secrets, pipeline.mix_sources, pipeline.encode, pipeline.quality_filter):
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_an_empty_table_and_odd_columns_pass(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.01", "sf0.001")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).withColumns({"Score": F.lit(1), "copies": F.lit("c"), "a.b": F.lit(2)})
    for rows in (docs.limit(0), docs.withColumns({"text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}), docs):
        for _, stage in pipeline.STAGES:
            rows = stored(stage(spark, rows, sf_dir), "test")
        assert set(docs.columns) <= set(rows.columns)


def test_near_dedup_makes_the_members_of_lists_twice_at_most(spark, monkeypatch):
    """40 texts with one passage and little else, so that lists have several blocks."""
    made, within, keyed = spark.sparkContext.accumulator(0), dedup.links_within, []

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    def links_within(light, payload, block, compare):
        if block != dedup.BLOCK:
            return within(light, payload, block, compare)
        keyed.append(light.count())
        return within(light.mapInArrow(counted, light.schema), payload, block, compare)

    monkeypatch.setattr(dedup, "BLOCK", 10)
    monkeypatch.setattr(dedup, "links_within", links_within)
    rows = [(i, " ".join([*(f"p{j}" for j in range(20)), *(f"t{i}w{j}" for j in range(12))])) for i in range(40)]
    docs = spark.createDataFrame([*rows, (99, rows[0][1] + " end")], "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == list(range(40))
    assert keyed[0] < made.value <= 2 * keyed[0]
