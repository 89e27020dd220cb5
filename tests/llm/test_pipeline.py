"""The pipeline's stages on the smallest documents, each judged on its own input."""

import corpus_pipeline as C
from tests.llm.test_operators import brute_components, brute_templates


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(C.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        if i < len(C.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = {r.doc_id: r.text for r in docs.collect()} if i < len(C.STAGES) - 1 else None
        if name == "quality classifier":
            assert set(after) < set(before) and all(after[d] == before[d] for d in after)
        elif name == "line dedup":
            want = {d: (t, n) for (d, t, n), _ in brute_templates(list(before.items())).items()}
            emptied = {d for d, (t, n) in want.items() if n and not t.split()}
            assert emptied and after == {d: t for d, (t, _) in want.items() if d not in emptied}
        elif name == "near dedup":
            want = brute_components(list(before.items()))
            assert set(after) == {d for d, c in want.items() if d == c}
        elif name == "mixture":
            assert set(after) <= set(before) and sum(len(t.split()) for t in after.values()) <= 0.9 * sum(len(t.split()) for t in before.values())
        else:
            assert {r.doc_id for r in docs.select("doc_id").collect()} == set(before)
    assert docs.count() == C.run(spark, sf).count()
