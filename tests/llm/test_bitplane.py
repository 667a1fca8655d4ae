import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import bitplane

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", " x", "x ", "it's we'll I'd 's", "a b c", "\x1c a", "Ünï 123 4th ½ ²", "a\tb c", "x\r\ny", "\n\n a", "日本 語", "'ll'd 'RE", "a\n\nb c", "é'", "¡a  "]


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(0)
    for n, top in [(0, 1), (1, 1), (7, 2), (1000, 50_000), (999, 1 << 20), (64, 1 << 32)]:
        ids = rng.integers(0, top, n).astype("<u4")
        assert (bitplane.from_planes(bitplane.to_planes(ids, bits), n, bits) == ids).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_ids_are_the_librarys(name, corpus):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    tool = bitplane.Encoder(public_tokenizers.path(name))
    for t in [*ODD, *(r[1] for r in corpus[1] if r[1])] * 2:
        assert tool.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_files_match_brute_force(spark, corpus, empty):
    docs, rows = corpus
    plain, start, want = Tokenizer.from_file(PATH), 0, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, text, *_ in order:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for bits in (False, True):
        got = bitplane.read_ids(bitplane.write_ids(docs, PATH, block=500, bits=bits)).collect()
        assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert bitplane.read_ids(bitplane.write_ids(empty, PATH)).count() == 0


def test_one_document_by_itself(spark, corpus):
    files = bitplane.write_ids(corpus[0], PATH, block=300).collect()
    reader = bitplane.Reader(files[0].uri)
    for i, (_, _, raw) in enumerate(reader.documents()):
        assert reader.document(i).tobytes() == raw


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_the_librarys(name):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    tool = bitplane.Encoder(public_tokenizers.path(name))
    for token in [t.content for t in plain.get_added_tokens_decoder().values()]:
        for t in (f"one {token} two", f"one{token}two", token, f"{token[:-1]} a"):
            assert tool.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
