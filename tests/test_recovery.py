"""The point of recovery follows the log."""

import pytest

from rewind.queries import QUERIES


def test_snapshot_grows_with_the_log(spark):
    for name in ("recover_table_before_delete", "recover_rows_before_delete", "recover_column_before_delete"):
        small, large = (QUERIES[name](spark, f"/root/testdata/sf{sf}").filter("v is not null").count() for sf in ("0.001", "0.01"))
        assert large > 5 * small > 0, name


@pytest.mark.parametrize("deleted,kept", [(3, {(1, 1): 1.0, (1, 2): 2.0, (2, 1): 4.0}), (None, {(1, 1): 1.0, (1, 2): 2.0, (2, 1): 4.0})])
def test_a_table_without_a_delete_is_whole(spark, deleted, kept):
    from rewind.operators import timetravel, undo

    rows = [(1, "a", "I", 1, 1, 1.0), (2, "a", "I", 1, 2, 2.0), (4, "b", "I", 2, 1, 4.0)] + [(deleted, "a", "D", 1, 1, None)] * (deleted is not None)
    log = spark.createDataFrame(rows, "id long, table_name string, op string, user_id long, k long, v_after double")
    before, past = timetravel.split_at(log, timetravel.newest_deletes(log))
    assert {(r.user_id, r.k): r.v for r in undo.live_state(before).collect()} == kept
    assert past.count() == (deleted is not None)
