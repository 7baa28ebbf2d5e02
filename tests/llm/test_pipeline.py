import math
from collections import defaultdict

import numpy as np

import corpus_pipeline
from canopy.llm import lines, quality, repeats, store
from canopy.llm.store import save
from tests.llm.test_group_operators import _near_brute, _windows
from tests.llm.test_text_operators import _brute_repeats

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [{r.doc_id: r for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = save(stage(spark, docs, SF), f"test-{k}")
        if k < 4:
            assert docs.columns == COLUMNS, name
            tables.append({r.doc_id: r for r in docs.collect()})
    before, scored, ruled, cut, kept = tables

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [i for i in before if i in labels]
    assert sum((i in scored) == (labels[i] == 1) for i in known) >= 0.95 * len(known)
    source = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(source, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.score(np.array([quality.features_of(before[i].text or "") for i in before]))
    assert set(scored) == {i for i, s in zip(before, scores, strict=True) if s >= quality.THRESHOLD}

    for i, r in scored.items():
        n, five, covered, longest = _brute_repeats(r.text, repeats.MIN_REPEAT) if len(r.text.split()) < 400 else (None,) * 4
        if n is not None:
            assert (i in ruled) == (n >= 10 and 100 * five <= 20 * n and covered <= repeats.MAX_COVERED and longest <= repeats.MAX_LONGEST)
    assert all(ruled[i] == scored[i] for i in ruled)

    seen, must = set(), defaultdict(set)
    for i in sorted(ruled):
        for a, b, key in _windows(ruled[i].text, lines.RUN_WORDS):
            if key in seen:
                must[i].update(range(a, b + 1))
            seen.add(key)
    for i, r in ruled.items():
        have = [x for x in r.text.split("\n") if x.split()]
        if not must[i]:
            assert cut[i] == r
        else:
            left = [x for x in (cut[i].text if i in cut else "").split("\n") if x.split()]
            assert len(left) <= len(have) - len(must[i])
            assert i not in cut or cut[i].n_chars == len(cut[i].text)

    groups = _near_brute([(i, r.text) for i, r in cut.items()], 5, 80)
    assert set(kept) == {i for i, _, c in groups if i == c} and all(kept[i] == cut[i] for i in kept)

    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(kept)
    fill = defaultdict(int)
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) <= math.ceil(sum(fill.values()) / 4096) + 2


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_verdicts_hold_for_rows(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in source.collect()]
    free = max(i for i, _ in rows) + 1  # an id without a label
    for stage in (corpus_pipeline.quality_classifier, corpus_pipeline.quality_rules):
        good = {r.text or "" for r in stage(spark, source, SF).collect()}
        texts = sorted({t for _, t in rows})
        assert good and len(good) < len(texts)
        for id_ in (None, free):  # all texts once more without an id, or under one id
            out = stage(spark, _frame(spark, [*rows, *((id_, t) for t in texts)]), SF).collect()
            assert sorted(r.text for r in out if r.doc_id == id_) == sorted(good)


def test_near_dedup_keeps_one_row_of_a_component(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near = a.replace("a59", "z")
    rows = [(7, a), (7, a), (7, b), (3, near), (None, b), (None, c), (None, c), (None, ""), (None, ""), (9, "")]
    out = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, _frame(spark, rows).repartition(3), SF).collect()))
    assert out == sorted([(3, near), (7, b), (0, c), (0, ""), (0, ""), (9, "")])


def test_row_numbers_are_found_again(spark, tmp_path):
    spark.range(1000).selectExpr("id as doc_id", "repeat('x', 1000) as text").repartition(7).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    rows = corpus_pipeline._numbered(docs)
    assert rows.columns == ["doc_id", "text", corpus_pipeline.ROW]
    first = {r.doc_id: r[corpus_pipeline.ROW] for r in rows.drop("text").collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    again = {r.doc_id: r[corpus_pipeline.ROW] for r in rows.repartition(3).select("doc_id", corpus_pipeline.ROW).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert first == again and len(set(first.values())) == 1000


def _through(spark, docs):
    """The documents after each stage."""
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = save(stage(spark, docs, SF), f"through-{k}")
        out.append(docs)
    return out


def test_odd_rows_go_through_every_stage(spark):
    """Nulls in every column, empty and very long texts, exact repeats, repeated ids, clashing columns."""
    source = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and 60 < len(r.text.split()) < 300]
    quality_model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    good = [t for t in sorted(set(source)) if quality_model.score(np.array([quality.features_of(t)]))[0] > 0.9 and repeats.measure([t])[0][5] == 0 and repeats.measure([t])[0][4] == 0]
    assert len(good) > 30
    long = "\n".join(good[20:])  # all lines of many documents
    rows = [(900, good[0]), (900, good[0]), (901, good[0]), (None, good[0]), (902, good[1]), (902, good[2]), (None, good[3]), (None, None), (903, None), (904, ""), (905, "\n \n"), (906, long), (907, "short")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, n_deleted long, keys string, uid long, piece string"
    docs = spark.createDataFrame([(i, t, None, None, None, "r", 1, 5, "k", 2, "p") for i, t in rows], columns)
    stages = _through(spark, docs)
    assert all(d.columns == docs.columns for d in stages[:-1])
    kept = stages[3].collect()
    assert sorted(r.text for r in kept if r.doc_id != 906) == sorted(good[:4])
    by_text = {r.text: r for r in kept}
    assert by_text[good[0]].doc_id == 900 and by_text[good[1]].doc_id == by_text[good[2]].doc_id == 902 and by_text[good[3]].doc_id is None
    assert all(r.n_deleted == 5 and r.n_chars is None for r in kept if r.doc_id != 906)
    packed = stages[4].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept}


def test_empty_and_narrow_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [d.count() for d in _through(spark, docs.limit(0))] == [0] * 5
    narrow = _through(spark, docs.select("text", "doc_id"))
    full = _through(spark, docs)
    assert [d.count() for d in narrow] == [d.count() for d in full] and narrow[3].columns == ["text", "doc_id"]


def test_saved_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda _: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and [x.name.rpartition("-")[0] for x in (tmp_path / "canopy").iterdir()] == ["best-fit-packing"]


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "line dedup", "MinHash near-dedup", "best-fit packing"]
