"""Ids are those of the library's default call, also where a text holds the literal of an added token."""

import json

import pytest
from tokenizers import Tokenizer

from weftline.llm.queries import tokenizer_path
from weftline.llm.tokens import encoder

TEXTS = [
    "end of text <|endoftext|> next",
    "<|endoftext|>",
    "a<|endoftext|>b, <|endoftext|>. c\n<|endoftext|>\nd  <|endoftext|>  e \n<|endoftext|>",
    " <|endoftext|> x <|endoftext|",
    "no literal here, only words.\n\nAnd <|some|> marks",
    "",
]


def check(path):
    tool = Tokenizer.from_file(path)
    want = [tool.encode(t, add_special_tokens=False).ids for t in TEXTS]
    ids, ends = encoder(path).encode(TEXTS)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == want
    return want


def test_default_call():
    assert check(tokenizer_path())[0] == [437, 286, 2420, 220, 50256, 1306]


@pytest.mark.parametrize("change", [{"rstrip": True}, {"lstrip": True}, {"content": "only words"}, {"content": "words."}, {"content": "text"}])
def test_tokens_that_cross_pieces(tmp_path, change):
    said = json.load(open(tokenizer_path()))
    said["added_tokens"] = [said["added_tokens"][0] | change | ({"id": 50257} if "content" in change else {})]
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(said))
    check(str(path))
