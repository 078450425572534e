"""Token files against the library's own encoding, read back from disk."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from subdrift.llm.token_files import Encoder, Format, pack, read_tokens, unpack, write_tokens
from tests.llm.helpers import awkward, frame

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("form", [Format(), Format(kind="bit", block_ids=64, segment_ids=500, part_bytes=40_000)])
def test_round_trip(spark, scratch, form):
    rows = [(d, (t or "")[:20000]) for d, t in awkward(spark)]
    write_tokens(frame(spark, rows), f"{scratch}/tokens", VOCABULARY, form)
    got = sorted((tuple(r) for r in read_tokens(spark, f"{scratch}/tokens").collect()), key=lambda r: r[1])
    tokenizer, start, want = Tokenizer.from_file(VOCABULARY), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_encoder_on_odd_characters():
    random.seed(1)
    encoder, tokenizer = Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    alphabet = [*"abAB É é é ß İ ſ K Å ́ \n\t\x1c\x85 　''s.,!?_-#12٣ Σς ﬁ漢😀", "<|endoftext|>", "'ll", " "]
    for _ in range(500):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 40)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 63, 64, 65, 1000])
def test_planes(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n).astype("<u4")
    form = Format(block_ids=64, kind=kind)
    sizes, planes = pack(ids, form)
    assert unpack(n, 64, kind, sizes, planes).tolist() == ids.tolist()


def test_empty_table(spark, scratch):
    write_tokens(frame(spark, awkward(spark)).limit(0), f"{scratch}/tokens", VOCABULARY)
    assert read_tokens(spark, f"{scratch}/tokens").count() == 0
