"""The text that op4's query leaves."""

import random

from trackloom.llm import substring_dedup


def words(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def test_query_gives_the_text_that_is_left(spark, tmp_path):
    passage = words(70, 1)  # 51 words or more, of 400 bytes or more
    own = [f"{c}{words(30, k)}" for k, c in enumerate("ABCD", 2)]
    wide = "é" + "x" * 399, "è" + "x" * 399  # é and è share their first byte, so a cut of what follows leaves both whole
    half = "a" * 399 + "é", "a" * 399 + "è"  # 400 equal bytes end inside a character
    texts = [f"{own[0]} {passage} {own[1]}", f"{passage} {own[2]}", own[3], None, *wide, *half]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in substring_dedup.op4_substring_dedup(spark, f"file://{tmp_path}").collect()}
    assert passage not in got[0]["text"] and got[0]["text"].startswith(own[0]) and got[0]["text"].endswith(own[1])
    assert got[1]["text"] == own[2] and got[2]["text"] == own[3] and got[3]["text"] == ""
    assert (got[4]["text"], got[5]["text"]) == wide and got[6]["text"] == "�" and got[6]["n_kept"] == 1
    assert got[0]["n_kept"] == len(got[0]["text"])
