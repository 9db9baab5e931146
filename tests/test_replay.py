import pytest

from nymora.operators import replay
from nymora.sources.vault import VaultError

ROWS = "conv string, turn int, role string, text string, original string, at int"


def test_occurrences_contents_and_edits(spark):
    said = spark.createDataFrame([("a", 1, "assistant", "Yes.", "⟨A⟩", 1), ("a", 2, "assistant", "Yes.", "⟨B⟩", 2), ("a", 3, "assistant", "No.", "⟨C⟩", 3), ("b", 1, "assistant", "Yes.", "⟨D⟩", 1), ("b", 2, "assistant", None, "x", 4)], ROWS)
    cache = replay.remember(replay.empty(spark), said, "text", "original", "at", "conv", "turn")
    turns = spark.createDataFrame([("a", 1, "assistant", "Yes."), ("a", 2, "assistant", "Yes."), ("a", 3, "assistant", "No, edited."), ("a", 9, "assistant", "No."), ("b", 7, "assistant", "Yes."), ("b", 1, "user", "Yes."), ("c", 1, "assistant", "Yes."), (None, None, "assistant", None)], "conv string, turn int, role string, text string")
    got = {(r.conv, r.turn): r.replay for r in replay.replay(turns, cache, scope="conv", occurrence="turn").collect()}
    assert got == {("a", 1): "⟨A⟩", ("a", 2): "⟨B⟩", ("a", 3): None, ("a", 9): "⟨C⟩", ("b", 7): "⟨D⟩", ("b", 1): None, ("c", 1): None, (None, None): None}
    with pytest.raises(VaultError):  # the same content under two originals, and no occurrence
        replay.replay(turns.where("conv = 'a'"), cache, scope="conv")
    again = replay.remember(cache, spark.createDataFrame([("a", 1, "assistant", "Yes.", "⟨E⟩", 9)], ROWS), "text", "original", "at", "conv", "turn")
    assert {r.replay for r in replay.replay(turns.where("conv = 'a' and turn = 1"), again, scope="conv", occurrence="turn").collect()} == {"⟨E⟩"}


def test_the_bound_holds_in_one_scope(spark):
    many = spark.range(50_000).selectExpr("cast(id as string) as turn", "concat('text ', id) as text", "concat('original ', id) as original", "id as at")
    cache = replay.remember(replay.empty(spark), many.where("at < 20000"), "text", "original", "at", occurrence="turn")
    cache = replay.remember(cache, many.where("at >= 20000"), "text", "original", "at", occurrence="turn")
    assert cache.entries.count() == 10_000 and cache.entries.agg({"used": "min"}).head()[0] == 40_000 and cache.forgotten.count() == 1
    kept = replay.replay(many.where("at >= 49990"), cache, occurrence="turn", role=None).collect()
    assert all(r.replay == r.original for r in kept) and len(kept) == 10
    with pytest.raises(VaultError):  # what was forgotten might have held the same content
        replay.replay(many.where("at >= 49990"), cache, role=None)
    with pytest.raises(ValueError):
        replay.remember(cache, many, "text", "original", "at", bound=0)
