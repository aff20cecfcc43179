"""Token counts of long pieces, and what a worker keeps of them."""

import random
import sys

import pytest

from sonoplan.llm import tokens


@pytest.fixture()
def own():
    import public_tokenizers

    return tokens.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))


def test_totals_by_blocks_equal_the_prefix_counts(own, monkeypatch):
    rng = random.Random(4)
    for block in (1, 2, 7, 100, 1 << 16):
        monkeypatch.setattr(tokens, "BLOCK", block)
        for text in ("", "a", "".join(rng.choice("etaoins") for _ in range(3000)), "漢字É" * 200, "=" * 1000, bytes(range(128, 256)).decode("latin-1")):
            raw = text.encode()
            assert own.piece_total(raw) == (own.piece_counts(raw) or [0])[-1]


def test_long_pieces_equal_the_library_and_are_not_kept(own, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(tokens, "BLOCK", 1000)
    monkeypatch.setattr(tokens, "KEPT", 40)
    monkeypatch.setattr(tokens, "KEPT_PAIRS", 300)
    rng = random.Random(8)
    for _ in range(20):
        text = " ".join("".join(rng.choice("abcdefghij-_") for _ in range(rng.choice([3, 8, 70, 4000]))) for _ in range(30))
        assert own.summary(text, 1024)[0] == len(library.encode(text, add_special_tokens=False).ids)
        assert len(own.totals) <= 40 and len(own.apart) <= 300
        assert max(map(len, own.totals.keys() - own.marks)) <= tokens.KEPT_CHARS


def test_a_piece_of_megabytes_is_counted_in_a_block(own):
    import tracemalloc

    raw = b"abcdefgh" * 125_000
    own.piece_total(raw[:4000])
    tracemalloc.start()
    total = own.piece_total(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total > 0 and peak < 16 * tokens.BLOCK * sys.getsizeof(0)
