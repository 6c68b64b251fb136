"""Work that must not be repeated inside a plan."""

import re

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _optimized(df) -> str:
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_projects_are_matched_once(spark):
    """A plain explode matched the projects of a record again for each of its items, in a filter below it."""
    plan = _optimized(entry.queries()["merge_project_lists"](spark, SF))
    assert len(re.findall(r"aggregate\(", plan)) == 1


def test_layer_checks_lower_each_text_once(spark):
    """The lower text was computed again for each weak verb, and every skill was looked for in every text."""
    plan = _optimized(entry.queries()["validate_layers"](spark, SF))
    assert not re.search(r"Contains\(lower\(lambda", plan)
    assert "array_except(" in plan


def test_upserted_payloads_are_taken_apart_once(spark):
    """The halves of the batch were told apart above the Python step, which therefore read all payloads for each half."""
    steps = re.findall(r"Filter|MapIn\w+", _optimized(entry.queries()["unmapped_upsert"](spark, SF)))
    assert steps == ["MapInArrow", "Filter", "MapInArrow", "Filter"]


def test_profile_lines_are_not_taken_apart_for_their_first_words(spark):
    from vitalake.plans import profiles

    lines = ["one two three", "  one", "1 - Zwei", "", "a1b2c3", "x" * 50 + "é y", "...", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "cv_id long, text string")
    got = {r["cv_id"]: r for r in profiles._build(rows).collect()}
    for i, text in enumerate(lines):
        if text is None or not text.strip():
            assert not got[i]["work"]
            continue
        found = re.findall("[A-Za-z]+", text)
        w = got[i]["work"][0]
        assert (w["organization"], w["designation"]) == ((found or [""])[0].upper(), (found + ["", ""])[1] if len(found) > 1 else "")
        assert got[i]["projects"][0]["name"] == " ".join(found[:2]).lower()
    assert profiles._build(rows)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") <= 2
