import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe, token_files
from millrace.llm.common import work_dir

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "<|endoftext|>", "'s", "'", "1", "½", "😀", "\u3000", "\x1c", "\x85", "don't", "e\u0301", "中文", "...", "\r\n", "İ", "Σ", "ΑΣ "]


def fuzz(n: int) -> list[str]:
    rng = random.Random(3)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(n)] + ["a" * 3000, "th" * 400, "é" * 500]


def test_bpe_equals_the_library():
    own, lib = bpe.load(BYTE), Tokenizer.from_file(BYTE)
    for t in fuzz(3000):
        ids = lib.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert got.tolist() == ids
        assert own.decode(got) == lib.decode(ids, skip_special_tokens=False)


def test_compiled_and_own_merges_agree():
    own = bpe.load(BYTE)
    for t in fuzz(300):
        for f in own.fragments(t.encode()):
            if f:
                assert own.merge(f) == list(own._single(f))


def test_cuts_lie_inside_no_token():
    own = bpe.load(BYTE)
    assert b"".join(own.fragments("naïve中文x".encode())) == "naïve中文x".encode()
    assert all(own.joinable[a << 8 | b] for t in own.token_bytes[:5000] for a, b in zip(t, t[1:]) if t != b"<|endoftext|>")


def test_ill_formed_ids_decode_like_the_library():
    own, lib = bpe.load(BYTE), Tokenizer.from_file(BYTE)
    rng = np.random.default_rng(1)
    for _ in range(200):
        ids = rng.integers(0, 50257, 6).astype(np.int32)
        assert own.decode(ids) == lib.decode(ids.tolist(), skip_special_tokens=False)


def test_bpe_query_rows(odd_docs, no_docs):
    lib = Tokenizer.from_file(BYTE)
    got = {r["doc_id"]: r for r in bpe.encode_documents(odd_docs, BYTE, digests_only=True).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(no_docs, BYTE).count() == 0
    full = bpe.encode_documents(odd_docs.filter("doc_id = 7"), BYTE).first()
    assert full["decoded"] == texts[7] and full["n_tokens"] == len(full["ids"])


def test_word_chunks_equal_whole_texts():
    own, lib = token_files.ChunkEncoder(WORD), Tokenizer.from_file(WORD)
    assert own.chunkable
    texts = fuzz(3000) + [None]
    for t, raw in zip(texts, own.encode_batch(texts)):
        assert np.frombuffer(raw, "<i4").tolist() == lib.encode(t or "", add_special_tokens=False).ids
    assert not token_files.ChunkEncoder(BYTE).chunkable


def test_token_files_round_trip(spark, odd_docs, no_docs):
    lib = Tokenizer.from_file(WORD)
    path = work_dir(spark, "t")
    token_files.write_tokens(odd_docs.union(odd_docs.filter("doc_id = 7")), path, WORD, metadata=("source",))
    rows = token_files.crc32_of_ids(token_files.read_tokens(spark, path)).orderBy("doc_id", "start").collect()
    texts = sorted([(r["doc_id"], r["text"] or "") for r in odd_docs.collect()] + [(7, [r["text"] for r in odd_docs.collect() if r["doc_id"] == 7][0])])
    at = 0
    for r, (i, t) in zip(rows, texts, strict=True):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    plan = token_files.read_tokens(spark, path, ["doc_id", "meta_source"]).filter("doc_id = 9")
    shown = plan._jdf.queryExecution().explainString(plan._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ids" not in shown.split("ReadSchema")[1].split("\n")[0] and "EqualTo(doc_id,9)" in shown
    assert plan.first()["meta_source"] == "b"
    empty = work_dir(spark, "t")
    token_files.write_tokens(no_docs, empty, WORD)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_token_files_have_indexes_and_encodings(spark, odd_docs):
    import glob

    import pyarrow.parquet as pq

    path = work_dir(spark, "t")
    token_files.write_tokens(odd_docs, path, WORD)
    meta = pq.ParquetFile(glob.glob(path.removeprefix("file:") + "/tokens/*.parquet")[0]).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)


@pytest.mark.parametrize("text,n", [("", 0), ("a", 1)])
def test_sizes(text, n):
    assert len(bpe.load(BYTE).encode(text)) == n
