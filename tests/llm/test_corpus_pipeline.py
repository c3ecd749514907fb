"""The pipeline, stage by stage, against what each stage must do."""

import corpus_pipeline
import pyarrow.parquet as pq
from public_tokenizers import path as tokenizer_path
from test_llm_contracts import components, shingles
from test_llm_edges import brute
from tokenizers import Tokenizer


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        kept.append({r.doc_id: r.text for r in docs.collect()})
    good, single, cut, clean = kept
    labels = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    wanted = {x["doc_id"] for x in labels if x["quality"] == 1 and not x["toxic"]}
    assert len(wanted - set(good)) <= max(1, len(wanted) // 50)
    assert set(single) == {d for d, (n, c) in components(good).items() if c == d or not n}
    ids = sorted(single)
    left = dict(zip(ids, brute([single[d].encode() for d in ids]), strict=True))
    assert {d: t.encode() for d, t in cut.items()} == {d: t.decode("utf-8", "ignore").encode() for d, t in left.items()}
    items = [shingles(x["text"]) for x in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()]
    dirty = {d for d, t in cut.items() if any(s and 5 * len(s & shingles(t)) >= 4 * len(s) for s in items)}
    assert set(clean) == set(cut) - dirty
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.ids for r in rows} == {d: library.encode(t, add_special_tokens=False).ids for d, t in clean.items()}
    assert all(r.n_tokens == len(r.ids) for r in rows)
