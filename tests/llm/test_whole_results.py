"""The training-data queries return results, not only digests of them."""

import hashlib

import numpy as np

import corpus_pipeline
from partloom.llm.queries import QUERIES
from partloom.llm.sentencepiece_sampling import MODEL, load_pieces


def same(rows, texts):
    pieces = load_pieces(MODEL, 0.5)
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        codes = np.array(r["ids"], np.int32)
        assert len(codes) == r["n_pieces"] and hashlib.sha256(codes.astype("<i4").tobytes()).hexdigest() == r["ids_sha256"]
        assert pieces.decode(codes) == texts[r["doc_id"]].encode()


def test_op10_and_last_stage_return_ids(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    same(QUERIES["op10_sentencepiece"](spark, data).collect(), texts)
    few = docs.where("doc_id % 20 = 1")
    same(corpus_pipeline.segmentation(spark, few, data).collect(), {r["doc_id"]: r["text"] or "" for r in few.collect()})


def test_op4_returns_rendered_turns(spark, data):
    rows = QUERIES["op4_chat_format"](spark, data).collect()
    assert rows and all(hashlib.sha256(r["rendered"].encode()).hexdigest() == r["rendered_sha256"] for r in rows)


def test_jaccard_groups_meet_as_texts():
    """What is moved to a group is its texts, and the links are those of their sets."""
    import pyarrow as pa
    from partloom.llm import jaccard

    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, 0, 5, base), (1, 0, 7, base + " more"), (1, 0, 9, "other words altogether"), (2, 0, 5, "a b c"), (2, 0, 8, "A  B\nc")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 2])], ["pivot", "block", "id", "_text"]) for i in (0, 2, 4)]
    got = [tuple(r.values()) for b in jaccard._within(90, 3)(iter(batches)) for r in b.to_pylist()]
    assert got == [(5, 7), (5, 8)]
