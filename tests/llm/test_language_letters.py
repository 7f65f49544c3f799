"""Every letter counts in every script, and any number of languages takes part."""

import math
import random

import pytest

from weftline.llm import language


def spread(text):
    """A text's signs by the plain rule: letters in lower case, other runs as one blank."""
    out = ""
    for c in text:
        c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
        out += "" if c == " " and out.endswith(" ") else c
    return out


def bits(text, sample):
    found, known, count = spread(text), spread(sample), 0
    for first in range(0, len(found), language.SEGMENT):
        part, at = found[first : first + language.SEGMENT], 0
        while at < len(part):
            n = 1
            while at + n < len(part) and part[at : at + n + 1] in known:
                n += 1
            at, count = at + n, count + 1
    return count * math.log2(max(len(known), 2)) / max(len(found), 1)


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(4)

    def text(low, high, n):
        words = ["".join(chr(rng.randrange(low, high)) for _ in range(rng.randrange(1, 6))) for _ in range(n // 6)]
        return " ".join(rng.choice(words) for _ in range(n // 3))

    return {"han": text(0x4E00, 0x5E00, 6000), "hangul": text(0xAC00, 0xB200, 5000), "latin": text(0x61, 0x7B, 20000), "ge'ez": text(0x1200, 0x1249, 3000)}


def test_rare_letters_are_told_apart(samples):
    texts = [s[900:1900] for s in samples.values()] + [s[40:60].upper() + " 12 " + s[2:20] for s in samples.values()] + ["", "123", None, "ԱԲ"]
    parse = language.Parse(texts)
    for name in sorted(samples):
        parse.against(language.Language(language.train(name, samples[name])))
    names, scores, least = parse.verdicts()
    assert names[:8] == [*samples, *samples] and min(scores[:8]) > 0.2 and names[8:11] == ["und"] * 3
    for i, t in enumerate(texts[:8]):
        each = sorted(bits(t, s) for s in samples.values())
        assert least[i] == pytest.approx(each[0]) and scores[i] == pytest.approx(1 - each[0] / each[1])


def test_scripts_and_many_languages(spark, samples, monkeypatch):
    monkeypatch.setattr(language, "STATES_AT_ONCE", 20_000)
    rows = [(i, samples[n][k : k + 700], n) for i, (n, k) in enumerate((n, 700 * k) for n in samples for k in range(12)) if samples[n][k : k + 700]]
    rows += [(1000 + i, f"noise {i} of a large column", f"n{i:03}") for i in range(400)]
    got = language.train_and_identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert len(got) == len(rows)
    want = {d: n for d, _, n in rows if n in ("han", "hangul", "ge'ez")}
    assert all(r["lang_pred"] == want[r["doc_id"]] for r in got if r["doc_id"] in want and not r["held_out"])
