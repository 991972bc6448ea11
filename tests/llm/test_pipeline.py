"""The pipeline's stages on the smallest tables; each is judged on its own input."""

import corpus_pipeline as P
from compare import DATA
from tarmac.session import materialize

SF = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        seen[name] = docs
    ids = {n: [r.doc_id for r in df.select("doc_id").collect()] for n, df in seen.items()}
    assert all(df.columns == first.columns for df in list(seen.values())[:-1])
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    assert toxic & {r.doc_id for r in first.collect()} <= set(ids["toxicity"])
    want = {}
    for r in seen["toxicity"].collect():
        want[r.text or ""] = max(r.doc_id, want.get(r.text or "", r.doc_id))
    assert sorted(ids["exact_dedup"]) == sorted(want.values())
    from test_against_brute_force import exact_components

    texts = {r.doc_id: r.text or "" for r in seen["exact_dedup"].collect()}
    assert sorted(ids["near_dedup"]) == sorted({c for _, c in exact_components(texts, 5, 80).values()})
    assert set(ids["mixing"]) <= set(ids["near_dedup"])
    assert len({(r.sequence_id, r.offset) for r in seen["packing"].collect()}) == seen["packing"].count()
    assert sorted(r.doc_id for r in seen["packing"].filter("piece = 0").collect()) == sorted(ids["mixing"])
    assert P.run(spark, SF).count() == seen["packing"].count()
