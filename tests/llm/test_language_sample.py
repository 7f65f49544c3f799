"""The training sample comes from all of a text, and equal texts count once."""

from weftline.llm import language


def test_pieces_lie_anywhere_and_copies_count_once(spark):
    head = "licence " * 500
    rows = [(i, head + f" body{i} " * 4000, "aa") for i in range(40)] + [(100 + i, "the same copy", "bb") for i in range(60)]
    rows += [(200 + i, f"another text {i}", "bb") for i in range(9)]
    got = language.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    long = [r["piece"] for r in got if r["lang"] == "aa"]
    assert long and all(len(p) == language.SAMPLE_CHARS // 20 for p in long) and sum("body" in p for p in long) > len(long) / 2
    short = [r["piece"] for r in got if r["lang"] == "bb"]
    assert short.count("the same copy") == 1 and len(set(short)) == len(short) > 1
