from pyspark.sql import functions as F

from nymora.operators.windows import nominated


def test_windows_are_those_that_equal_a_value(spark):
    texts = {1: "a🙂bc a🙂b", 2: None, 3: "", 4: "abc" * 50, 5: "é" * 9, 6: "x"}
    values = ["a🙂b", "abc", "cab", "é", "éé", "absent", "", "x" * 40]
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    given = spark.createDataFrame([(v,) for v in values], "value string")
    want = sorted((i, at, v) for i, t in texts.items() for v in values if v for at in range(len(t or "")) if t[at : at + len(v)] == v)
    for bits in (15, 27):
        got = nominated(df, "t", ["id"], given, "value", bits)
        assert want and sorted(map(tuple, got.join(given, F.col("piece") == F.col("value"), "left_semi").collect())) == want
    assert nominated(df, "t", ["id"], given, "value").count() == len(want)
    assert nominated(df, "t", ["id"], given.where("false"), "value").count() == 0


def test_texts_together_are_as_texts_alone():
    import numpy as np

    from nymora.operators import windows

    values, bits = ["ab", "b c", "é𝒳", "abab"], 20
    held = np.zeros((1 << bits) // 8, "uint8")
    for b in windows.whole_buckets(values, bits).tolist():
        held[b >> 3] |= 1 << (b & 7)
    own = windows.Nominator(held, sorted({len(v) for v in values}), "abé", bits)
    texts = ["", "abab c", "a", "b", "xé𝒳 ab", "é" * windows.TOGETHER, "𝒳ab", "b", " c"]
    assert [(i, *x) for i, t in enumerate(texts) for x in own.find(t)] == sorted(own.find_all(texts), key=lambda h: (h[0], h[2] - h[1], h[1]))
    assert {(i, texts[i][a:b]) for i, a, b in own.find_all(texts)} == {(1, "ab"), (1, "abab"), (1, "b c"), (4, "é𝒳"), (4, "ab"), (6, "ab")}


def test_a_worker_keeps_few_lookups(spark, monkeypatch):
    from nymora.operators import restore

    made = []
    monkeypatch.setattr(restore, "KEPT", 2)
    monkeypatch.setattr(restore, "Lookup", lambda pairs: made.append(pairs) or len(made))
    lookup = restore._broadcast(spark.createDataFrame([(v, "s", v) for v in "abc"], "v string, s string, o string"))
    assert [lookup(v) for v in "aabcba"] == [1, 1, 2, 3, 2, 4] and lookup("d") is None
