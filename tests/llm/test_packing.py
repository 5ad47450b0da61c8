import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rasterloom.llm import packing

SCHEMA = "doc_id long, text string, length string, ids_crc32 string"


def test_tree_finds_the_tightest_window():
    tree, open_ = packing.CapacityTree(64), {}
    rng = random.Random(1)
    for w in range(500):
        if open_ and rng.random() < 0.5:
            least = rng.randint(1, 64)
            fit = min((c for c in open_.values() if c >= least), default=0)
            assert tree.tightest(least) == fit
            if fit:
                assert open_.pop(tree.take(fit)) == fit
        else:
            open_[w] = rng.randint(1, 64)
            tree.add(open_[w], w)


@pytest.mark.parametrize("seed", range(6))
def test_pack_places_each_token_once_without_padding(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 63) for _ in range(rng.choice([0, 1, 2, 50, 400]))]
    seen = [[] for _ in lengths]
    for sequence in packing.pack(lengths, 64):
        total = sum(n for _, _, n in sequence)
        assert 0 < total <= 64 and total & (total - 1) == 0
        for i, start, n in sequence:
            assert n > 0
            seen[i] += range(start, start + n)
    assert [sorted(s) for s in seen] == [list(range(n)) for n in lengths]


def test_documents_round_trip(spark):
    texts = ["", None, "a", "  two  blanks \n\n x", "end.\nNext line here", "é ñ ß Łódź 漢字 ᏣᎳᎩ 😀", "x " * 5000, "<|endoftext|> kept", " lead", "trail ", "tab\tand\r\nline", "it's we'll 'd", "same", "same", "n\n m"]
    rows = [(i if i != 3 else None, t, "clash", "clash") for i, t in enumerate(texts)]
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(2), ids=True).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, sequences = {}, {}
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        got.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(got[key])
        assert np.frombuffer(b"".join(p[1] for p in pieces), "<u4").tolist() == ids
        assert {p[2] for p in pieces} == {len(ids)}
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0


def test_ids_match_the_tokenizer_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encode, t = packing.Encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in docs.collect():
        assert np.frombuffer(encode(r.text), "<u4").tolist() == t.encode(r.text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_match_the_tokenizer_on_odd_strings():
    rng = random.Random(3)
    encode, t = packing.Encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = [" ", "  ", "\n", "\t", "'s", "é", "—", "ß", "1", "22", "abc", "A", "…", "'", " \n", "漢", "я", "\r\n", " ", " ", "ꬰ", "𞤀", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(5000)] + ["x" * 100_000, " " * 300_000 + "a"]
    texts += [f"a{c}b 1{c}2 {c}{c} x{c}\n{c}" for c in map(chr, range(0x250, 0x3100, 7))]
    assert all(np.frombuffer(encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids for x in texts)
