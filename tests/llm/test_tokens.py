import hashlib
import random
import zlib

import numpy as np
import pytest

from zenithal.llm import packing, queries, sentencepiece_bpe, token_counts

TEXTS = ["hello world", "  hello  world ", "a\nb\tc", "", None, "▁x ▁ ▁", "é è ﬁ ａｂｃ", "日本語 😀", " " * 100 + "x", "a" * 3000, "ab" * 2000, "x <|endoftext|> y", "=-" * 500, " \n \n", "The cat sat. " * 400, "\u0000a", "٣ ३", "don't I'll we've"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice("ab theinrso  ▁\nég日.0123,!😀") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS + made)] + [(0, TEXTS[0], "again")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(5)


def test_sentencepiece_is_the_library(spark, docs):
    import sentencepiece

    path = queries.tokenizer_path(queries.PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows, df = docs
    got = sentencepiece_bpe.digest(df, path).toPandas()
    assert len(got) == len(rows)
    want = {}
    for i, t, _ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    for r in got.itertuples():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id], rows[r.doc_id][1]
    full = {r.doc_id: r for r in sentencepiece_bpe.encode_decode(df, path).collect()}
    assert bytes(full[0].decoded) == b"hello world"


def test_library_tokenizer_is_read_when_a_text_needs_it():
    bpe = packing.ByteBpe(queries.tokenizer_path(queries.BPE))
    plain = bpe.encode("hello world").tolist()
    assert "slow" not in vars(bpe)
    special = bpe.encode(f"hello world{packing.SPECIAL}").tolist()
    assert special == [*plain, bpe.slow.token_to_id(packing.SPECIAL)]


def test_sentencepiece_forgets(monkeypatch):
    m = sentencepiece_bpe.MergeModel(queries.tokenizer_path(queries.PIECES))
    texts = [f"word{i} other{i % 7}" for i in range(300)]
    want = m.batch(texts)
    monkeypatch.setattr(sentencepiece_bpe, "REMEMBERED", 20)
    assert [m.ids(t) for t in texts] == want


@pytest.mark.parametrize("limit", [4096, 16])
def test_long_words_are_those_of_the_library(monkeypatch, limit):
    import sentencepiece

    monkeypatch.setattr(sentencepiece_bpe, "LONG", limit)
    path = queries.tokenizer_path(queries.PIECES)
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.MergeModel(path)
    rng = random.Random(3)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ab", "0123456789", "日本語é😀a", "=-"]
    for alphabet in alphabets:
        for size in (17, 300, 6000):
            text = "".join(rng.choice(alphabet) for _ in range(size))
            assert m.ids(text) == np.array(sp.encode(text, add_bos=True, add_eos=True), "<u4").tobytes(), (alphabet, size)


def test_a_megabyte_without_spaces():
    import time

    import sentencepiece

    path = queries.tokenizer_path(queries.PIECES)
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.model(path)
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    began = time.time()
    assert m.ids(text) == np.array(sp.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()
    assert time.time() - began < 90


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.BPE)
    t = Tokenizer.from_file(path)
    rows, df = docs
    out = packing.digest(packing.pack(df, path, 0, 64)).toPandas()
    by_seq = out.sort_values(["sequence_id", "offset"])
    ends = by_seq.offset + by_seq.length
    for s, g in by_seq.groupby("sequence_id"):
        assert list(g.offset) == [0, *list((g.offset + g.length)[:-1])] and g.length.sum() == 64 or s == out.sequence_id.max()
    assert ends.max() <= 64 and set(out.sequence_id) == set(range(out.sequence_id.max() + 1))
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x, _ in rows}
    for r in out.itertuples():
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
    for i, g in out[out.doc_id > 0].groupby("doc_id"):
        g = g.sort_values("start")
        assert list(g.start) == [0, *list((g.start + g.length)[:-1])] and g.length.sum() == len(want[i])


def test_packing_nothing(spark, docs):
    assert packing.pack(docs[1].limit(0), queries.tokenizer_path(queries.BPE)).count() == 0


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_token_counts_round_trip(spark, docs, block):
    rows, df = docs
    path = queries.tokenizer_path(queries.BPE)
    files, order = token_counts.write_token_files(df, path, queries.EOD, block)
    got = order.join(token_counts.count_tokens(files.df.where("block is not null"), queries.EOD), ["file", "ordinal"]).toPandas()
    bpe = packing.byte_bpe(path, True)
    want = sorted((i, len(bpe.encode(t)) if t else 0) for i, t, _ in rows)
    assert sorted(zip(got.doc_id, got.n_tokens)) == want and got.ended.all()


def test_token_counts_of_files(spark):
    e = 9
    files = {0: [1, 2, e, e, 3], 1: [e], 2: [4, 4, 4, 4, 4, 4, 4], 3: [], 4: [1, 1, 1, e, 2, 2, e]}
    rows = [(f, k // 2, np.array(ids[k : k + 2], "<u4").tobytes()) for f, ids in files.items() for k in range(0, max(len(ids), 1), 2)] + [(5, 0, None)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "file long, block long, payload binary"), e, 4).toPandas()
    found = sorted(zip(got.file, got.ordinal, got.n_tokens, got.ended))
    assert found == [(0, 0, 2, True), (0, 1, 0, True), (0, 2, 1, False), (1, 0, 0, True), (2, 0, 7, False), (4, 0, 3, True), (4, 1, 2, True)]


@pytest.mark.parametrize("block", [1, 5, 1 << 20])
def test_token_counts_of_flat_files(spark, tmp_path, block):
    e = 7
    files = {"a": [1, 2, e, e, 3, 3], "b": [e] * 12, "c": [], "d": [5] * 40 + [e]}
    for name, ids in files.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    blocks, named = token_counts.file_blocks(spark, str(tmp_path), 2, block)
    got = token_counts.count_tokens(blocks, e).join(named, "file").toPandas()
    found = {n: [(r.n_tokens, r.ended) for r in got[got.path.str.endswith(f"{n}.bin")].sort_values("ordinal").itertuples()] for n in files}
    assert found == {"a": [(2, True), (0, True), (2, False)], "b": [(0, True)] * 12, "c": [], "d": [(40, True)]}
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        token_counts.file_blocks(spark, str(tmp_path / "odd.bin"))[0].count()


def test_token_counts_of_nothing(spark, docs):
    path = queries.tokenizer_path(queries.BPE)
    files, order = token_counts.write_token_files(docs[1].limit(0), path, queries.EOD)
    assert order.count() == 0 and token_counts.count_tokens(files.df.where("block is not null"), queries.EOD).count() == 0
