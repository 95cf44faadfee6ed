"""Reloaded children: no task is sent all keys, and tasks grow in number with the rows."""

from tessera.operators import changes as C


def test_keys_are_sent_to_no_task_whole(spark, monkeypatch):
    """Before, both joins sent all loaded keys to every task, so a task's memory grew with the table."""
    monkeypatch.setattr(C, "CHILD_ROWS", 10)
    old = spark.createDataFrame([(k if k else None, i, float(i)) for k in range(40) for i in range(3)], "k long, i int, v double")
    new = spark.createDataFrame([(k, 9, -1.0) for k in range(0, 60, 2)] + [(None, 8, -2.0)], "k long, i int, v double")
    entries = spark.createDataFrame([(k,) for k in [4, 4, 6, 39, 50, 70]] + [(None,)], "k long")
    found = C.reloaded_children(old, new, entries, ["k"])
    held = {4, 6, 39, 50, 70}
    want = [tuple(r) for r in old.collect() if r.k not in held] + [tuple(r) for r in new.collect() if r.k in held]
    plain = lambda rows: sorted(map(str, rows))
    assert plain(tuple(r) for r in found.collect()) == plain(want) and found.columns == old.columns
    assert found.rdd.getNumPartitions() == 12
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
