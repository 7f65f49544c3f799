"""Learning pieces takes a number of Python calls that doesn't grow with the pieces; ids stay those of the library."""

import cProfile
import pstats
import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from weftline.llm import tokens
from weftline.llm.queries import tokenizer_path

ODD = ["", " ", "\n", "\n\n", "a\tb", "don't", "dogs'", "word***", "***", "_x_", "x_", "3.14", "½", "é", "ét", "naïve,", "中文。", "ⅷ", "a\0b", "\0", "\x85", "a\xa0b", " ", "\x1c", "\r\n", "🙂", "ªº", "x​", "<|endoftext|>", "end<|endoftext|>.", "ǅ"]


def name(i: int) -> str:
    return "".join(chr(97 + i // 26**k % 26) for k in range(5))


def calls(n: int) -> int:
    tool = tokens.Encoder(tokenizer_path())
    texts = [" ".join(name(i) + mark for i in range(at, at + 100)) for at in range(0, n, 100) for mark in ("", ",", "***")]
    with cProfile.Profile() as profile:
        tool.encode(texts)
    return pstats.Stats(profile).total_calls


def test_calls_do_not_grow_with_pieces():
    assert calls(20_000) - calls(2_000) < 5_000


@pytest.mark.parametrize("seed", range(3))
def test_ids_of_odd_texts(seed):
    draw, tool, library = random.Random(seed), tokens.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for _ in range(20):
        texts = ["".join(draw.choice([*ODD, name(draw.randrange(50))]) + draw.choice(["", " ", " ", " ", "\n"]) for _ in range(draw.randrange(12))) for _ in range(30)]
        ids, ends = tool.encode(draw.choice([texts, pa.array(texts), pa.array(["x", *texts, "y"]).slice(1, 30)]))
        assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_letters_are_those_of_the_library():
    """What Arrow takes for a letter stands in one pre-token with the letters beside it."""
    points = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    library = Tokenizer.from_file(tokenizer_path()).pre_tokenizer
    letters = pa.compute.match_substring_regex(pa.array(points), r"\A\p{L}\z").to_pylist()
    assert sum(letters) > 100_000
    found = "".join(c for c, is_letter in zip(points, letters, strict=True) if is_letter)
    assert len(library.pre_tokenize_str(found)) == 1


def test_small_batches_are_gathered():
    batches = [pa.record_batch({"doc_id": [i], "text": ["x" * n]}) for i, n in enumerate([3, 3, 3, 20, 0, 1])]
    got = [b.to_pydict()["doc_id"] for b in tokens.gathered(iter([*batches, batches[0].slice(0, 0)]), 1, 7)]
    assert got == [[0, 1], [2], [3], [4, 5]]
    assert list(tokens.gathered(iter([]), 1)) == []
