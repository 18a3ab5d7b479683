"""The pipeline against a plain replay with the brute-force forms of its stages."""

import corpus_pipeline as C
import edge
import pyarrow.parquet as pq
from filelens.llm import language_id, piece_lattice
from test_near_dedup import brute as near
from test_personal_data import base


def test_stages_match_a_replay(spark, rows, docs_dir, tmp_path):
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    columns = docs.columns
    out, held = docs, []
    for i, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, out, docs_dir)
        if i < 4:
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out.write.parquet(f"{tmp_path}/{i}")
            out = spark.read.parquet(f"{tmp_path}/{i}")
            held.append([(d["doc_id"], d["text"], d["lang"], d["source"]) for d in pq.read_table(f"{tmp_path}/{i}").to_pylist()])
    got = out.collect()
    letters = {r[0] for r in rows if language_id.has_letter(language_id.words_of(r[1] or ""))}
    assert {r[0] for r in held[0]} <= letters and len(held[0]) > 0.95 * len(letters)
    keep = {i for i, _, c in near(held[0], 5) if i == c}
    assert {r[0] for r in held[1]} == keep and len(held[1]) == len(keep)
    assert {r[0] for r in held[2]} == keep and not any(base(r[1]) for r in held[2])
    assert {r[0] for r in held[3]} == keep and len(held[3]) >= len(keep)
    lat = piece_lattice.Lattice(piece_lattice.vocabulary_path())
    text = {r[0]: r[1] for r in held[2]}
    assert len(got) == len(held[3])
    for r in got[:60]:
        assert r["round_trip"] and r["n_pieces"] == len(lat.encode(text[r["doc_id"]])[0]) // 4


def test_run_and_cases(spark, docs_dir):
    assert C.run(spark, docs_dir).count() > 0
    for docs in (edge.empty(spark), edge.cases(spark)):
        columns = docs.columns
        for i, (_, stage) in enumerate(C.STAGES):
            docs = stage(spark, docs, docs_dir)
            if i < 4:
                assert docs.columns == columns
        docs.collect()
