import json

from strandline.operators import nested


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_reports_in_all_shapes(spark):
    whole = {"student": {"subject_scores": {"a": 1, "b": None}}, "analysis": {"major_directions": [{"title": "x"}, "y", {"icon": 1}]}}
    data = [
        (1, json.dumps(whole), "clash"), (1, json.dumps(whole), "clash"),
        (2, json.dumps({"data": whole, "version": 2}), None),
        (3, json.dumps({"student": json.dumps({"subject_scores": [{"subject": "a", "score": 2}]}), "analysis": {"major_directions": {"title": "lone"}}}), None),
        (4, json.dumps({"student": {"subject_scores": json.dumps({"q": 1})}, "analysis": {"major_directions": {"1": {"title": "second"}, "0": "first"}}}), None),
        (5, json.dumps(whole)[:-9], None), (6, None, None), (7, "", None), (8, "null", None), (9, "[]", None),
        (None, json.dumps(whole), None), (10, json.dumps({"student": None, "analysis": {"major_directions": None}}), None),
    ]
    df = spark.createDataFrame(data, "report_id long, payload string, pos string")
    got = rows(nested.report_children(df))
    base = [("score", -1, -1, "a"), ("score", -1, -1, "b"), ("direction", -1, 0, "x"), ("direction", -1, 1, "y"), ("direction", -1, 2, "")]
    want = [("reports", i, *b) for i in (1, 2) for b in base]
    want += [("reports", 3, "score", -1, -1, "a"), ("reports", 3, "direction", -1, 0, "lone")]
    want += [("reports", 4, "score", -1, -1, "q"), ("reports", 4, "direction", -1, 0, "first"), ("reports", 4, "direction", -1, 1, "second")]
    assert got == sorted(want)


def test_schools_and_majors(spark):
    body = {"code": 200, "body": {"schoolList": [
        {"universityCode": 17, "majorList": [{"majorCode": "0012"}, {"majorName": "none"}]},
        {"universityName": "no code", "majorList": json.dumps([{"majorCode": 5}])},
        {"universityCode": "U9", "majorList": None}]}}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, json.dumps({"status": 3})), (3, json.dumps({"result": {"schoolList": {"universityCode": "z"}}}))], "response_id long, body string")
    assert rows(nested.volunteer_children(df)) == sorted([
        ("volunteers", 1, "school", -1, 0, "17"), ("volunteers", 1, "school", -1, 1, ""), ("volunteers", 1, "school", -1, 2, "U9"),
        ("volunteers", 1, "major", 0, 0, "0012"), ("volunteers", 1, "major", 0, 1, ""), ("volunteers", 1, "major", 1, 0, "5"),
        ("volunteers", 3, "school", -1, 0, "z")])


def test_long_and_empty_tables(spark):
    wide = {"student": {"subject_scores": {f"s{i}": i for i in range(5000)}}, "analysis": {}}
    df = spark.createDataFrame([(1, json.dumps(wide))], "report_id long, payload string")
    assert nested.report_children(df).count() == 5000
    assert nested.report_children(df.limit(0)).count() == 0
