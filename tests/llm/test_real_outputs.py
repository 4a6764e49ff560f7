"""The registered jobs return, or take their digests of, the operators' real outputs."""

import zlib

import corpus_pipeline
import numpy as np
from memlake.llm import packing, registry, warc


def test_op10_returns_content_and_records(spark, sf):
    for r in registry.op10_warc_derivatives(spark, sf).limit(50).collect():
        headers, block = warc.parse_record(bytes(r.record))
        assert block.decode() == r.content and headers["WARC-Record-ID"] == r.record_id


def test_op7_packs_the_ids(spark, sf, monkeypatch):
    seen, pack = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda pieces, size: seen.append(pieces.columns) or pack(pieces, size))
    got = registry.op7_packing(spark, sf)
    assert "ids" in seen[0] and got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_the_pipeline_ends_with_token_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 100")
    rows = corpus_pipeline.pack_sequences(spark, docs, sf).collect()
    assert rows
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        assert (ids[-1] == registry.END) == (r.start + r.length == r.doc_tokens)


def test_the_pipeline_keeps_only_its_last_stage(spark, sf, monkeypatch):
    from memlake.llm import tables

    before = tables.written()
    got = corpus_pipeline.run(spark, sf)
    left = tables.written() - before
    assert left == {got._scratch} and got.count() > 0
    tables.release(got)
    assert tables.written() == before
