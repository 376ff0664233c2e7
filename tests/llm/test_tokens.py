"""Token files: the exact ids of whole texts, in order, and selective reads."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from opsledger.llm.common import scratch
from opsledger.llm.tokens import Encoder, encode_documents, read_tokens, token_digests
from tests.llm.conftest import frame

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n", "Don't WON'T it's, x's", "a<|endoftext|>b <|startoftext|>", "İstanbul ΑΣΣ ß ﬁ é é", "\x1c\x85  tab\tx\r\n", "1234 5,6.7 !!! ?!x", "日本語 テキスト", "w" * 3000, "#$% . , a.,!? 'll", "́lead", "a|b | c", "ÀÉÎ àéî"]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_tokenizer(file):
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(public_tokenizers.path(file)), Encoder(public_tokenizers.path(file))
    for texts in (ODD, ODD[::-1], [" ".join(ODD)]):
        for text in texts:
            assert np.frombuffer(encoder.ids(text), dtype="<i4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]


def test_marks_and_capitals_of_latin_texts_take_no_runs_of_their_own():
    """word, Word. and WORD,. are one run; any order of letters, digits, marks and other signs gives the tokenizer's ids."""
    import random

    encoder, rng = Encoder(PATH), random.Random(4)
    encoder.ids("häuser Häuser. HÄUSER,. (häuser) word Word. été. Été;")
    assert {"häuser", "word", "été", ".", ",.", ";"} <= set(encoder) and not {"Häuser.", "häuser.", "HÄUSER,.", "été.", "Été;"} & set(encoder)
    signs = [*".,!?;:%&*#$'()-_<|>~ \n\t", *"abSZ09", *"äÉßÿµªº²\xa0\xad\xd7\xf7", "\u0301", "\u0338", "\u037e", "İ", "ſ", "日", "'s", "...", "\U0001f600"]
    for n in range(3000):
        text = "".join(rng.choices(signs[: rng.choice([30, 42, len(signs)])], k=rng.choice([3, 12, 40])))
        assert encoder.ids(text) == tokens_of(encoder, text), text


def tokens_of(encoder, text):
    return np.array([*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<i4").tobytes()


def test_files(spark, docs, rows, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    folder = scratch(spark, "t")
    encode_documents(docs, PATH, folder)
    want = []
    for k, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((k is not None, k or 0, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    got = sorted(map(tuple, token_digests(spark, folder).collect()), key=lambda r: r[1])
    assert sorted((k is not None, k or 0, n, crc) for k, _, n, crc in got) == sorted(want)
    assert [k for k, *_ in got] == sorted((k for k, *_ in rows), key=lambda k: (k is not None, k or 0))
    assert [start for _, start, *_ in got] == [0, *np.cumsum([n for _, _, n, _ in got])[:-1]]
    back = read_tokens(spark, folder)
    assert {(r.doc_id, r.start, len(r.ids)) for r in back.collect()} == {x[:3] for x in got}
    plan = read_tokens(spark, folder).where("doc_id = 5").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan and "ids" not in plan.split("ReadSchema")[-1].split("\n")[0]
    empty = scratch(spark, "e")
    encode_documents(none, PATH, empty)
    assert token_digests(spark, empty).count() == 0


def test_a_repeated_id_and_repeated_rows_fill_several_shards(spark):
    from opsledger.llm.tokens import write_tokens

    rows = [(7, f"text number {i}", None, None) for i in range(200)] + [(8, "the same", None, None)] * 200 + [(None, "x", None, None)] * 100
    folder = scratch(spark, "t")
    write_tokens(frame(spark, rows), folder, PATH, shard_docs=50)
    got = sorted(read_tokens(spark, folder).select("start", "doc_id", "n_tokens", "shard").collect())
    assert [r.doc_id for r in got] == [None] * 100 + [7] * 200 + [8] * 200
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert min(len({r.shard for r in got if r.doc_id == k}) for k in (7, 8, None)) > 1


def test_runs_that_differ_from_the_whole_are_told(monkeypatch):
    from opsledger.llm import tokens

    monkeypatch.setattr(tokens, "PROOF", 1)
    encoder = Encoder(PATH)
    assert encoder.ids("some words here") == encoder.ids("some words here")
    encoder.whole = lambda text: [5]
    with pytest.raises(ValueError, match="not those of its runs"):
        encoder.ids("some words here")


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    from opsledger.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 20_000)
    encoder, plain_one = Encoder(PATH), Encoder(PATH)
    texts = [f"run{i} w{i % 7} {'x' * (i % 900)}" for i in range(3000)]
    for text in texts:
        assert encoder.ids(text) == tokens.packed([*plain_one.whole(text), 1])
        assert sum(tokens.RUN_BYTES + len(k) + len(v) for k, v in encoder.items()) <= 20_000 and len(encoder.old) < 200


def test_layout(spark, docs):
    folder = scratch(spark, "t")
    encode_documents(docs, PATH, folder)
    for file in glob.glob(folder.removeprefix("file:") + "/*.parquet"):
        for c in range(pq.ParquetFile(file).metadata.num_columns):
            column = pq.ParquetFile(file).metadata.row_group(0).column(c)
            assert column.has_column_index and column.has_offset_index
            assert column.path_in_schema != "doc_id" or "DELTA_BINARY_PACKED" in column.encodings
