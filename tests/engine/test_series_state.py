"""Frame series with keyed state: over two runs the same pairs as from all descriptors; late frames, repeats, bounded state."""

import random

import pytest

from strainlake.streaming import frames


def _all(rows, pairing):
    """The pairs of frames that come in one by one, from all that came before."""
    seen, out = {}, []
    for t, p in rows:
        if t in seen:
            continue
        seen[t] = p
        order = sorted(seen)
        i = order.index(t)
        if i:
            out.append((t, seen[order[0] if pairing == frames.ANCHORED else order[i - 1]], p))
    return out


@pytest.mark.parametrize("pairing", [frames.ANCHORED, frames.SEQUENTIAL])
def test_state_equals_all_descriptors(pairing):
    rng = random.Random(4)
    rows = [(t, f"f{t}") for t in rng.choices(range(40), k=60)]
    known, got = None, []
    for row in rows:
        known, out = frames._meet(known, [row], pairing, 64)
        got += [r[:3] for r in out]
    assert got == _all(rows, pairing) and not known[4]


@pytest.mark.parametrize("pairing", [frames.ANCHORED, frames.SEQUENTIAL])
def test_state_is_bounded_and_says_what_is_late(pairing):
    known, out = frames._meet(None, [(t, f"f{t}") for t in range(0, 100, 2)], pairing, 4)
    assert len(out) == 49 and known[:2] == (0, "f0") and known[2] == [92, 94, 96, 98] and known[4]
    known, out = frames._meet(known, [(95, "f95"), (3, "f3"), (96, "again"), (0, "f0")], pairing, 4)
    by = {r[0]: r[1:] for r in out}
    assert set(by) == {3, 95} and len(known[2]) == 4
    assert by[95][0] == ("f0" if pairing == frames.ANCHORED else "f94") and not by[95][2]
    again, out = frames._meet(known, [(-3, "g3"), (-5, "g5")], pairing, 4)
    assert out == [(-3, "g5", "g3", False)] and again[:2] == (-5, "g5") and again[2] == known[2]
    assert by[3] == (("f0", "f3", True) if pairing == frames.ANCHORED else (None, "f3", True))


def test_two_runs_over_growing_input(spark, tmp_path):
    place = {k: str(tmp_path / k) for k in ("in", "cp", "out")}
    parts = ([("a", 2, "a2"), ("a", 0, "a0"), ("b", 5, "b5"), (None, 1, "n1")], [("a", 1, "a1"), ("a", 3, "a3"), ("a", 2, "a2"), ("b", None, "b"), ("b", 7, None), (None, 2, "n2")])
    seen = []
    for part in parts:
        spark.createDataFrame(part, frames.FRAME).coalesce(1).write.mode("append").parquet(place["in"])
        for _ in range(2):  # a second start without new input adds nothing
            frames.stream_pairs(spark, place["in"], place["cp"], place["out"], frames.SEQUENTIAL).awaitTermination(120)
            seen.append(sorted((str(r.series), r.t, r.reference, r.deformed, r.late) for r in spark.read.schema(frames.PAIR).parquet(place["out"]).collect()))
    assert seen[0] == seen[1] == [("a", 2, "a0", "a2", False)]
    assert seen[2] == seen[3] == [("None", 2, "n1", "n2", False), ("a", 1, "a0", "a1", False), ("a", 2, "a0", "a2", False), ("a", 3, "a2", "a3", False)]
    with pytest.raises(ValueError):
        frames.paired(spark.createDataFrame([], frames.FRAME), "other")
