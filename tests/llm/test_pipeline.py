"""The pipeline on a fixture, each stage against a plain decision on its input."""

import corpus_pipeline
from tarnwell.sources.scratch import stored

from . import cases
from .test_near_dup import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF), "stage"))
        if len(kept) < 6:
            assert kept[-1].columns == columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in kept]
    assert all(b <= a for a, b in zip(ids[:-1], ids[1:], strict=True))
    assert len(ids[1]) >= 0.98 * len(ids[0])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    wrong = [d for d in ids[1] if d in labels and (labels[d] == 1) != (d in ids[2])]
    assert len(wrong) <= 2
    parts = brute([(r.doc_id, r.text) for r in kept[2].collect()])
    assert ids[3] == {d for d, (_, c) in parts.items() if d == c}
    from .test_decontaminate import brute as hits

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids[4] == {r.doc_id for r in kept[3].collect() if not hits(r.text, items)[1]}
    last = {r.doc_id: r.n_tokens for r in kept[5].collect()}
    assert set(last) == ids[4]
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()} == last


def test_stages_stand_odd_rows_and_none(spark):
    """Nulls, empty and very long texts, repeated ids with equal and different
    texts, a group of many copies, clashing columns; and no rows at all."""
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    hot = [(5000 + k, real[0][1], real[0][2], real[0][3], 1) for k in range(150)]
    again = [(real[1][0], real[2][1], real[1][2], real[1][3], 1)] * 2
    odd = cases.docs(spark, [*cases.DOCS, *real, *hot, *again])
    for rows in (odd, odd.limit(0)):
        kept = stored(rows, "stage")
        for name, stage in corpus_pipeline.STAGES:
            before, kept = kept, stored(stage(spark, kept, SF), "stage")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert kept.columns == rows.columns
                assert kept.exceptAll(before).isEmpty()
        if rows is odd:
            ids = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
            assert ids and len(ids) == len(set(ids)) and len([d for d in ids if d >= 5000]) == 0
        else:
            assert kept.isEmpty()
