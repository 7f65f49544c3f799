"""An idle worker's encoder forgets its pieces and returns their memory; ids stay those of the library."""

import shutil
import subprocess
import sys
import time

from tokenizers import Tokenizer

from weftline.llm import tokens
from weftline.llm.queries import tokenizer_path

TEXTS = ["one two, three\nfour  five", "two six", ""]

MEASURE = """
import re, sys, time
from weftline.llm import tokens

def anonymous():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(5))
list(tokens.encoded(["warm up"], sys.argv[1], 0))
first = anonymous()
for at in range(0, 300_000, 20_000):
    list(tokens.encoded([" ".join(map(name, range(at, at + 20_000)))], sys.argv[1], 0, 1_000_000))
full = anonymous()
time.sleep(3 * tokens.IDLE_S)
print(full - first, anonymous() - first)
"""


def test_forgets_when_idle(tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "IDLE_S", 0.2)
    path = shutil.copy(tokenizer_path(), tmp_path / "tokenizer.json")
    tool, library = tokens.encoder(str(path)), Tokenizer.from_file(str(path))
    want = [i for t in TEXTS for i in library.encode(t, add_special_tokens=False).ids]
    for _ in range(2):
        assert tool.encode(TEXTS)[0].tolist() == want
        assert tool.pieces
        time.sleep(1)
        assert not tool.pieces


def test_idle_memory_is_returned():
    out = subprocess.run([sys.executable, "-c", MEASURE, tokenizer_path()], capture_output=True, text=True, check=True, timeout=120).stdout
    full, idle = map(float, out.split())
    assert full > 50
    assert idle < full / 2, out


def test_small_portions_give_the_same_ids():
    texts = TEXTS * 5 + ["long " * 50]
    whole, parts = ([x.tolist() for _, each in tokens.encoded(texts, tokenizer_path(), 0, n) for x in each] for n in (10**6, 20))
    assert whole == parts
