"""Versioned updates against a fold, and long chains in few rounds."""

import random

from vitalake.operators import sessions


def _fold(state, updates):
    now, out = dict(state), []
    for session, seq, expected in sorted(updates, key=lambda u: u[1]):
        if session not in now:
            out.append((session, seq, "not_found", None))
        elif now[session] == expected:
            now[session] += 1
            out.append((session, seq, "accepted", now[session]))
        else:
            out.append((session, seq, "conflict", None))
    return sorted(out)


def _check(spark, state, updates):
    got = sessions.optimistic_lock_check(
        spark.createDataFrame(state, "session_id string, version long"), spark.createDataFrame(updates, "session_id string, seq long, expected_version long"))
    return sorted((r["session_id"], r["seq"], r["outcome"], r["new_version"]) for r in got.collect())


def test_random_updates_match_a_fold(spark):
    rng = random.Random(4)
    updates = [(rng.choice("abcdx"), seq, rng.randint(1, 12)) for seq in range(600)]
    state = [("a", 1), ("b", 3), ("c", 20), ("d", 1), ("unused", 1)]
    assert _check(spark, state, updates) == _fold(state, updates)


def test_no_updates_and_no_state(spark):
    assert _check(spark, [("a", 1)], []) == []
    assert _check(spark, [], [("a", 1, 1)]) == [("a", 1, "not_found", None)]


def test_a_chain_of_ten_thousand_takes_at_most_sixteen_rounds(spark, monkeypatch):
    cuts = []
    stored = sessions.stored
    monkeypatch.setattr(sessions, "stored", lambda df, label: cuts.append(1) or stored(df, label))
    updates = [("a", 2 * i, i + 1) for i in range(10_000)] + [("a", 2 * i + 1, i + 1) for i in range(10_000)]
    got = _check(spark, [("a", 1)], updates)
    assert sum(r[2] == "accepted" for r in got) == 10_000 and all((r[2] == "accepted") == (r[1] % 2 == 0) for r in got)
    assert len(cuts) <= 3 + 2 * 16
