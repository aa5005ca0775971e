import random
import zlib

import numpy as np
import pytest

from seqloom.llm import packing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return packing.default_vocabulary()


def test_encoder_equals_tokenizer(vocabulary):
    plain, fast = tokenizers.Tokenizer.from_file(vocabulary), packing.Encoder(vocabulary)
    r = random.Random(4)
    letters = "aAbZé'ÉßΣς.,!?<|>*#1 2\n\t 3İK…don't I'LL we're x.y,z..-_`~{}[]\\/@^世界한국 "
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(1500)]
    texts += ["<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>", "x" * 300, "", None, "word. word, Word!"]
    for t, ids in zip(texts, fast.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


def test_table_of_words_can_be_cut(vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 4)
    fast = packing.Encoder(vocabulary)
    texts = ["one two three four five six", "seven one two eight"]
    plain = tokenizers.Tokenizer.from_file(vocabulary)
    assert [np.frombuffer(x, "<u2").tolist() for x in fast.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces(spark, docs, prose, vocabulary):
    rows = [(i, prose(i, i * 7 % 90)) for i in range(60)] + [(None, None), (5, prose(5, 35)), (100, prose(1, 3000)), (101, "")]
    plain = tokenizers.Tokenizer.from_file(vocabulary)
    pieces = packing.pack(docs(rows).repartition(5), length=64).collect()
    ids = [plain.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows]
    assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    windows = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == windows.get(p["sequence_id"], 0) and len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        windows[p["sequence_id"]] = p["offset"] + p["length"]
    assert sorted(windows) == list(range(len(windows))) and all(windows[k] == 64 for k in list(windows)[:-1])
    whole = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"] or -1, p["sequence_id"], p["offset"])):
        whole.setdefault(p["doc_id"], b"")
        whole[p["doc_id"]] += bytes(p["ids"])
    assert whole[100] == np.array(ids[62], "<u4").tobytes()
    assert zlib.crc32(whole[101]) == zlib.crc32(np.array([1], "<u4").tobytes())


def test_sequences(spark, docs, prose, vocabulary):
    pieces = packing.pack(docs([(i, prose(i, 50)) for i in range(6)]), length=64)
    s = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert all(len(r["ids"]) == 4 * 64 for r in s[:-1])


def test_empty(docs, vocabulary):
    assert packing.pack(docs([])).count() == 0


def test_op4_against_the_plain_tokenizer(spark, docs, prose, vocabulary, tmp_path):
    from seqloom.llm.queries import QUERIES

    rows = [(i, prose(i, i * 37 % 400)) for i in range(50)] + [(None, None), (90, ""), (91, "w\u00f6rter und <|x|> " * 9000)]
    docs(rows).repartition(4).selectExpr("*", "doc_id as part", "text as ids", "text as before").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op4_packing"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 7
    plain = tokenizers.Tokenizer.from_file(vocabulary)
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    out = sorted(got.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    at, seen = 0, {}
    for r in out:
        assert (r["sequence_id"], r["offset"]) == divmod(at, 2048) and r["start"] == seen.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids[r["doc_id"]])
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == r["length"] > 0
        at, seen[r["doc_id"]] = at + r["length"], r["start"] + r["length"]
    assert seen == {i: len(x) for i, x in ids.items()}
