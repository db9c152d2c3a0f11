"""What review does to large sheets: how often rows are moved and held."""

from trialframe.operators import review


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_id_differences_meet_in_one_grouping(spark):
    kind = "job_id string, row_id string"
    expected = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", None), (None, "3")], kind)
    reviewed = spark.createDataFrame([("a", "2"), ("a", "4"), ("b", None), ("b", None)], kind)
    found = review.id_differences(reviewed, expected)
    assert "Join" not in _plan(found)
    rows = sorted(tuple(map(str, r)) for r in found.collect())
    assert rows == [("None", "3", "missing"), ("a", "1", "missing"), ("a", "4", "unexpected"), ("b", "None", "missing"), ("b", "None", "unexpected")]


def test_group_faults_move_each_row_once(spark):
    kind = "job_id long, parent_statement_id string, parent_atom_count int, atom_index int, logical_operator string"
    rows = [(1, "p", 2, 1, "and"), (1, "p", 2, 2, "and"), (1, "q", 2, 1, "and"), (1, "q", 2, 2, "or"), (1, "r", 2, 1, "and"), (1, "r", 2, 1, "and"), (1, "s", 2, 1, None), (1, "s", 2, 2, None), (1, "t", 2, 1, "and"), (1, "t", 2, 2, None), (1, "u", 1, 1, None)]
    found = review.group_faults(spark.createDataFrame(rows, kind))
    assert "Expand" not in _plan(found)
    faults = {r.parent_statement_id: (r.bad_members, r.bad_operator) for r in found.collect()}
    assert faults == {"p": (False, False), "q": (False, True), "r": (True, False), "s": (False, True), "t": (False, False), "u": (False, False)}


def test_windows_of_the_gate_share_one_sort(spark):
    import re

    from trialframe.plans import queries

    for rows in review.apply_review(*queries._reviewed(spark, "/root/testdata/sf0.001")):
        plan = _plan(rows)
        assert len(re.findall(r"Sort \[job_id#\w+ ASC NULLS FIRST, parent_statement_id", plan)) == 1
