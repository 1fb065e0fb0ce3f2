import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelark.llm import tokens
from sievelark.llm.queries import vocabulary
from sievelark.plans.shared import new_path
from tests.llm.common import clashing, documents, odd_rows


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.floats(0, 1))
@settings(max_examples=60, deadline=None)
def test_block_round_trip(ids, percentile):
    values = np.array(ids, np.uint32)
    block = tokens.encode_block(values, percentile)
    assert np.array_equal(tokens.decode_block(b"head" + block, 4), values)


def test_block_widths():
    for values in ([7] * 50, [0], [0, 2**32 - 1], list(range(1000)), [5] * 99 + [50_000]):
        assert tokens.decode_block(tokens.encode_block(np.array(values, np.uint32))).tolist() == values
    assert len(tokens.encode_block(np.full(4096, 9, np.uint32))) < 20  # equal ids need no bits


@given(st.lists(st.text(alphabet="ab'sé中 \n\t\r .,1! 😀", max_size=40), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_encoder_is_the_library(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    texts = [*texts, "a  <|endoftext|> b", " lead", "end  ", "", "don't  we'll\n\n x"]
    for encoder in (tokens.Encoder(vocabulary()), tokens.Encoder(vocabulary("word_bpe_49k.json"))):
        if not encoder.by_piece:
            plain = encoder.tokenizer
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts) + encoder.encode(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts] * 2


PIECES = [" ", "  ", "a", "The", "é", "ÿ", "×", "÷", "中", "ɏ", "ɐ", "\n", "\n\n", "\r\n", "\t", "'s", "'", "'re", "12", "!", "...", "¡", "\x85", "\xa0", "_",
          "-", ",", "(", '"', "ß", "\U0001f600", "x" * 70, "²", "\x00", "<|endoftext|>"]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_pieces_change_no_id(values):
    found = encoder_of_tests().encode(values)
    plain = encoder_of_tests().tokenizer
    assert [np.frombuffer(b, "<u4").tolist() for b in found] == [plain.encode(t, add_special_tokens=False).ids for t in values]


def encoder_of_tests():
    return tokens.encoder_for(vocabulary())


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_CACHED", 10)
    own = tokens.Encoder(vocabulary())
    values = [" ".join(f"w{k}x{n}" for k in range(8)) + " " + "long" * 40 for n in range(30)]
    for low in range(0, 30, 3):
        part = values[low : low + 3]
        assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(part)] == [
            own.tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        assert len(own.known) <= 10 + 3 * 9 and all(len(p) <= tokens.LONGEST_CACHED for p in own.known)


def expected(rows):
    from tokenizers import Tokenizer

    plain, start, out = Tokenizer.from_file(vocabulary()), 0, []
    for key, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, tokens.END_ID], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT_IDS", 500)
    rows = odd_rows()
    got = tokens.token_table(clashing(documents(spark, rows), "shard", "start", "payload"), vocabulary()).collect()
    assert sorted(r.n_tokens for r in got) == sorted(n for _, _, n, _ in expected([r[:2] for r in rows]))
    unique = {r[0]: r for r in rows if r[0] is not None}
    pairs = sorted((k, r[1]) for k, r in unique.items())
    got = tokens.token_table(documents(spark, [unique[k] for k, _ in pairs][::-1]), vocabulary())
    assert [tuple(r) for r in sorted(got.collect())] == expected(pairs)


def test_ids_come_back(spark):
    path = new_path(spark, "ids")
    tokens.write_tokens(documents(spark, [(2, "b c", None, None), (1, "a", None, None)]), path, vocabulary())
    rows = sorted(tokens.read_documents(spark, path, ids=True).collect())
    assert [len(r.ids) for r in rows] == [r.n_tokens for r in rows] and all(r.ids[-1] == tokens.END_ID for r in rows)


def test_empty_table(spark):
    assert tokens.token_table(documents(spark, []), vocabulary()).count() == 0


def test_reads_need_no_payload(spark):
    path = new_path(spark, "index")
    tokens.write_tokens(documents(spark, [(1, "a", None, None)]), path, vocabulary())
    plan = spark.read.schema(tokens.SEGMENTS).parquet(path).select("start")._jdf.queryExecution().toString()
    assert "payload" not in plan.split("ReadSchema")[-1]


@pytest.mark.parametrize("percentile", [0.5, 1.0])
def test_percentile_keeps_ids(spark, percentile):
    path = new_path(spark, "p")
    tokens.write_tokens(documents(spark, odd_rows()[:20]), path, vocabulary(), percentile=percentile)
    assert tokens.read_documents(spark, path).count() == 20
