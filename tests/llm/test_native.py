"""Mixing, chat perspectives and fingerprints on small inputs, against plain Python."""

import random
import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from vitalake.llm import chat, mix, sketch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "clash") for i, t, s in rows], DOCS)


def _mixed(spark, rows, **options):
    return [r.asDict() for r in mix.per_document(mix.mix(_docs(spark, rows), **options)).collect()]


def test_mix_targets_and_caps(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 4}") for i in range(400)]
    got = _mixed(spark, rows)
    assert len(got) == 400
    size = {s: sum(i % 7 + 1 for i in range(400) if i % 4 == s) for s in range(4)}
    # brute force: reshare until no source is above its cap
    weight, cap, fixed = {0: 3, 1: 1, 2: 2, 3: 3}, {s: 2 * n for s, n in size.items()}, {}
    budget = 1.5 * sum(size.values())
    while True:
        free = [s for s in size if s not in fixed]
        level = (budget - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap[s]]
        if not over:
            break
        fixed |= {s: cap[s] for s in over}
    target = {s: fixed.get(s, level * weight[s]) for s in size}
    for r in got:
        s = r["doc_id"] % 4
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
    for s in size:
        assert abs(sum(r["taken"] for r in got if r["doc_id"] % 4 == s) - target[s]) <= 7
    assert sum(r["taken"] for r in got) == int(budget)
    assert sum(r["taken"] % r["size"] > 0 for r in got) <= 1
    assert sorted(map(str, got)) == sorted(map(str, _mixed(spark, list(reversed(rows)))))


def test_mix_order_serves_all_sources_alike(spark):
    rows = [(i, "w " * 5, "ab"[i % 2]) for i in range(200)]
    draws = mix.mix(_docs(spark, rows), weights=(1, 1), budget_share=1.0).where("taken > 0").orderBy("offset").collect()
    half = draws[: len(draws) // 2]
    assert abs(sum(r["source"] == "a" for r in half) - len(half) / 2) <= 1
    ends = [r["offset"] + r["taken"] for r in draws]
    assert [r["offset"] for r in draws] == [0, *ends[:-1]] and ends[-1] == 1000


def test_mix_takes_by_order_of_finish_times(spark):
    """Brute force: serve by finish time until the budget is used; another order takes other words."""
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", None])) for i in range(300)]
    draws = mix.mix(_docs(spark, rows)).collect()
    budget = int(1.5 * sum(r["size"] for r in draws) / 2)

    def served(key):
        left, out = budget, {}
        for r in sorted(draws, key=key):
            out[r["doc_id"], r["epoch"]] = min(r["size"], left)
            left -= out[r["doc_id"], r["epoch"]]
        return out

    taken = {(r["doc_id"], r["epoch"]): r["taken"] for r in draws}
    assert len(taken) == 600 and taken == served(lambda r: (r["finish"], r["source"] is None, r["source"] or "", r["epoch"]))
    assert taken != served(lambda r: (r["epoch"], r["doc_id"]))


def test_mix_odd_rows(spark):
    rows = [(1, None, None), (1, "a b", None), (1, "a b", None), (None, "c", "x"), (2, "", "x"), (3, "d\x0be\x1cf", "x")]
    got = _mixed(spark, rows)
    assert len(got) == 6 and sum(r["size"] for r in got) == 2 + 2 + 1 + 2
    assert _mixed(spark, []) == []
    assert [(r["target"], r["taken"]) for r in _mixed(spark, [(1, None, "x")])] == [(0.0, 0)]


def test_chat_views(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_start|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, 0, "system", "alone"),
            (3, None, None, "x"), (3, 0, "bob", "y"), (3, 0, "bob", "y")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    views = {(r["conv_id"], r["perspective"], r["part"]): r for r in got}
    assert set(views) == {(1, "ann", 0), (1, "bob", 0), (3, "unknown", -1), (3, "unknown", 0), (3, "bob", -1), (3, "bob", 0)}
    ann = views[1, "ann", 0]
    assert ann["text"] == (
        "<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nhi <\\|im_start|><|im_end|>\n"
        "<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n")
    assert [ann["text"][m["start"]:m["end"]] for m in ann["mask"]] == ["hi <\\|im_start|><|im_end|>\n", "bye<|im_end|>\n"]
    assert [views[1, "bob", 0]["text"][m["start"]:m["end"]] for m in views[1, "bob", 0]["mask"]] == ["<|im_end|>\n"]
    assert views[3, "bob", 0]["n_turns"] == 2


def test_chat_parts_join_to_the_dialogue(spark):
    rows = [(1, i, "ab"[i % 2], f"t{i}") for i in range(25)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    whole = {r["perspective"]: r for r in chat.rotate(turns).collect()}
    cut = chat.rotate(turns, part_turns=10).orderBy("part").collect()
    for who, row in whole.items():
        parts = [r for r in cut if r["perspective"] == who]
        assert [r["n_turns"] for r in parts] == [10, 10, 5] and "".join(r["text"] for r in parts) == row["text"]
    assert chat.digest(chat.rotate(turns.limit(0))).count() == 0


def _brute(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    lines = lambda t: {x for x in t.split("\n") if x.strip(" ")}
    like = lambda a, b: len(lines(a) & lines(b)) / len(lines(a) | lines(b)) if lines(a) | lines(b) else 1.0
    for k, (i, t) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + other[:half]
        yield i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(t, e), 9), round(like(t, other), 9)


def test_fingerprints_against_brute_force(spark):
    line = lambda i, n: "\n".join(f"line {(i * 7 + k) % 90} é" for k in range(n))
    rows = [(i * 3, line(i, i % 60)) for i in range(150)] + [(5000, "x" * 50_000), (5001, "\n".join(map(str, range(3000)))), (5002, None), (5003, "\n \n"),
                                                            (5004, "a\nb"), (5004, "a\nb"), (None, "n"), (5005, "\n".join(map(str, range(1500, 4500))))]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = sketch.fingerprints(docs).collect()
    flat = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got)
    assert flat == sorted((str(a), b, c, d, e) for a, b, c, d, e in _brute(rows))
    same = [r["fingerprint"] for r in got if r["doc_id"] == 5004]
    assert same[0] == same[1] and len({r["fingerprint"] for r in got if r["doc_id"] in (5000, 5001, 5005)}) == 3
    assert sketch.fingerprints(docs.limit(0)).count() == 0


def test_next_over_many_buckets(spark):
    rows = [(i * i, f"t{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["text"]: r["next_text"] for r in sketch.with_next(docs, "doc_id", "text", ranges=5, rows_per_bucket=7).collect()}
    assert got == {f"t{i}": f"t{(i - 1) % 300}" for i in range(300)}


def test_peeling_recovers_the_difference(spark):
    a, b = list(range(0, 40)), list(range(8, 52))
    row = spark.range(1).select(sketch.paragraphs(F.lit("\n".join(map(str, a)))).alias("a"), sketch.paragraphs(F.lit("\n".join(map(str, b)))).alias("b"))
    got = row.select("a", "b", sketch.peel(sketch.subtract(sketch.build(F.col("a")), sketch.build(F.col("b")))).alias("r")).first()
    assert got["r"]["ok"] and set(got["r"]["plus"]) == set(got["a"]) - set(got["b"]) and set(got["r"]["minus"]) == set(got["b"]) - set(got["a"])


def test_no_python_in_native_plans(spark, capsys):
    docs = _docs(spark, [(1, "a b", "x")])
    turns = spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn int, role string, text string")
    for df in (mix.per_document(mix.mix(docs)), chat.rotate(turns), sketch.fingerprints(docs)):
        df.explain()
        plan = capsys.readouterr().out
        assert not any(w in plan for w in itertools.chain(("Python", "Pandas", "Arrow")))


def test_mix_reads_the_texts_once(spark, tmp_path):
    """Each use of the sizes scanned the documents and counted their words again: four scans in one plan."""
    path = str(tmp_path / "documents")
    spark.range(50).selectExpr("id AS doc_id", "repeat('word ', int(id % 7)) AS text", "concat('s', id % 3) AS source").write.parquet(path)
    draws = mix.mix(spark.read.parquet(path))
    plan = draws._jdf.queryExecution().executedPlan().toString()
    assert path not in plan and "text" not in plan
    assert draws.agg({"size": "sum"}).first()[0] == 2 * sum(i % 7 for i in range(50))
