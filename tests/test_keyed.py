"""Keyed tables: buckets are pruned, overlapping writers store each key once."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickertide.sources import keyed

SCHEMA = "k string, part string, v int"
KEYS = ("k", "part")


def frame(spark, names, v=0):
    return spark.createDataFrame([(*n, v) if isinstance(n, tuple) else (n, "p", v) for n in names], SCHEMA)


def stored(spark, path):
    rows = keyed.read_keyed(spark, path, StructType.fromDDL(SCHEMA)).collect()
    return sorted(((r.k, r.part, r.v) for r in rows), key=repr)


def test_second_insert_adds_new_keys_only(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored(spark, path) == []
    assert keyed.insert_new(spark, path, frame(spark, "abc"), KEYS) == 3
    assert keyed.insert_new(spark, path, frame(spark, "bcd", 1), KEYS) == 1
    assert keyed.insert_new(spark, path, frame(spark, "abcd", 2), KEYS) == 0
    assert keyed.insert_new(spark, path, frame(spark, []), KEYS) == 0
    assert stored(spark, path) == [("a", "p", 0), ("b", "p", 0), ("c", "p", 0), ("d", "p", 1)]


def test_null_is_a_key_and_differs_from_blank(spark, tmp_path):
    path = str(tmp_path / "t")
    names = [(None, "p"), ("", "p"), ("x", None), ("x", "")]
    assert keyed.insert_new(spark, path, frame(spark, names), KEYS) == 4
    assert keyed.insert_new(spark, path, frame(spark, names, 1), KEYS) == 0
    assert len(stored(spark, path)) == 4


def test_only_touched_buckets_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.insert_new(spark, path, frame(spark, [f"n{i}" for i in range(400)]), KEYS, buckets=16)
    state = keyed.table_state(spark, path)
    schema = StructType.fromDDL(SCHEMA)
    part = keyed.stored_keys(spark, path, schema, state, [3])
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = {f.split("bucket=")[1].split("/")[0] for f in part.inputFiles()}
    read = {r.f.split("bucket=")[1].split("/")[0] for r in part.selectExpr("input_file_name() f").distinct().collect()}
    assert read == {"3"} and len(files) > 1
    scanned = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "k:string" in scanned and "v:int" not in scanned


def test_a_writer_in_between_is_noticed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    keyed.insert_new(spark, path, frame(spark, "a"), KEYS)
    commit, done = keyed._commit, []

    def overtaken(session, where, state):
        if not done:
            done.append(1)
            keyed.insert_new(session, where, frame(session, "bx", 9), KEYS)
        return commit(session, where, state)

    monkeypatch.setattr(keyed, "_commit", overtaken)
    assert keyed.insert_new(spark, path, frame(spark, "abc", 1), KEYS) == 1
    assert stored(spark, path) == [("a", "p", 0), ("b", "p", 9), ("c", "p", 1), ("x", "p", 9)]
    assert keyed.table_state(spark, path).version == 3


def test_overlapping_writers_store_each_key_once(spark, tmp_path):
    path = str(tmp_path / "t")
    added, errors = [], []

    def write(k):
        try:
            names = [f"n{i}" for i in range(20 * k, 20 * k + 60)]
            added.append(keyed.insert_new(spark, path, frame(spark, names, k), KEYS, buckets=4))
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = stored(spark, path)
    assert not errors and sum(added) == len(rows) == len({r[:2] for r in rows}) == 120


def test_batches_are_merged_and_old_ones_removed(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(4):
        keyed.insert_new(spark, path, frame(spark, [f"n{k}"], k), KEYS, buckets=2, merge_at=3)
    assert len(keyed.table_state(spark, path).batches) == 2
    before = stored(spark, path)
    assert keyed.remove_unlisted(spark, path) == []
    assert len(keyed.remove_unlisted(spark, path, older_than_hours=0)) == 3
    assert stored(spark, path) == before == [(f"n{k}", "p", k) for k in range(4)]


def test_an_unlisted_batch_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    keyed.insert_new(spark, path, frame(spark, "a"), KEYS)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(keyed, "_commit", dies)
        keyed.insert_new(spark, path, frame(spark, "b"), KEYS)
    assert stored(spark, path) == [("a", "p", 0)]
    assert keyed.insert_new(spark, path, frame(spark, "b", 2), KEYS) == 1


def test_other_keys_than_the_tables_are_not_mixed(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.insert_new(spark, path, frame(spark, "a"), KEYS)
    keyed.insert_new(spark, path, frame(spark, ["a", ("a", "q")], 5), ("k",))
    assert stored(spark, path) == [("a", "p", 0), ("a", "q", 5)]


def test_plain_files_are_not_taken_for_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, "a").write.parquet(path)
    with pytest.raises(ValueError, match="without a log"):
        keyed.insert_new(spark, path, frame(spark, "a"), KEYS)


def test_an_insert_moves_digests_and_new_rows_only(spark, tmp_path):
    """Stored and repeated rows stay where they are, however long their keys; older batches have no digests."""
    path = str(tmp_path / "t")
    names = [(f"{'long text ' * 200}{i}", "p") for i in range(40)] + [(None, "p"), ("", "p"), ("1:a", None), ("1:a", "-")]
    assert keyed.insert_new(spark, path, frame(spark, names), KEYS) == 44
    state = keyed.table_state(spark, path)
    found = keyed._stored_digests(spark, path, StructType.fromDDL(SCHEMA), state, list(range(16)))
    scanned = found._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]
    assert "k:string" not in scanned and found.distinct().count() == 44
    older = state.batches[0].split("-")[1]
    spark.read.parquet(f"{path}/batch={state.batches[0]}").drop(keyed.DIGEST).write.partitionBy("bucket").parquet(
        f"{path}/batch={older}"
    )
    assert keyed._commit(spark, path, keyed.State(2, state.buckets, state.keys, (older,)))
    twice = frame(spark, [*names, ("new", "p"), ("new", "p")], 3).withColumn("ord", F.monotonically_increasing_id())
    twice = twice.withColumn("v", F.when(F.col("k") == "new", F.col("ord") % 2).otherwise(F.col("v")).cast("int"))
    first = twice.where("k = 'new'").orderBy("ord").first()
    assert keyed.insert_new(spark, path, twice, KEYS, order="ord") == 1
    assert ("new", "p", first.v) in stored(spark, path) and len(stored(spark, path)) == 45


def test_a_merge_writes_the_batches_of_one_level(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(6):
        keyed.insert_new(spark, path, frame(spark, [f"n{k}"], k), KEYS, buckets=2, merge_at=2)
    # Six inserts: four rows merged twice, two merged once; the four aren't written by the last merge.
    names = keyed.table_state(spark, path).batches
    assert sorted(keyed._level(n) for n in names) == [1, 2]
    assert stored(spark, path) == [(f"n{k}", "p", k) for k in range(6)]


def test_few_digests_go_to_few_tasks(spark, tmp_path, monkeypatch):
    """A shuffle of a small batch to all tasks of the session costs a file for each; keys are kept all the same."""
    digests = spark.range(10).selectExpr(f"unhex(sha2(cast(id as string), 256)) as {keyed.DIGEST}")
    assert keyed._dealt(digests, 10).rdd.getNumPartitions() == 1
    assert keyed._dealt(digests, keyed.TASK_ROWS + 1).rdd.getNumPartitions() == 2
    assert keyed._dealt(digests, keyed.SENT_ROWS + 1) is digests
    path = str(tmp_path / "t")
    monkeypatch.setattr(keyed, "TASK_ROWS", 3)
    for sent in (1000, 5):
        monkeypatch.setattr(keyed, "SENT_ROWS", sent)
        names = [f"n{i % 20}{sent % 3}" for i in range(50)] + [None, None]
        rows = frame(spark, names, sent).withColumn("ord", F.monotonically_increasing_id())
        assert keyed.insert_new(spark, path, rows, KEYS, order="ord") == (21 if sent == 1000 else 20)
        assert keyed.insert_new(spark, path, rows, KEYS, order="ord") == 0
    assert len(stored(spark, path)) == 41


def test_a_merge_moves_no_row(spark, tmp_path, monkeypatch):
    """Each bucket's files are read by tasks of their own, as many as their bytes ask for."""
    path = str(tmp_path / "t")
    for k in range(3):
        keyed.insert_new(spark, path, frame(spark, [f"n{i}" for i in range(40 * k, 40 * k + 40)], k), KEYS, buckets=5, merge_at=9)
    before, plans = stored(spark, path), []
    kind = type(spark.range(0))
    writer = kind.write.fget

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return writer(df)

    monkeypatch.setattr(kind, "write", property(seen))
    monkeypatch.setattr(keyed, "MERGED_BUCKETS", 2)
    monkeypatch.setattr(keyed, "MERGED_BYTES", 2000)
    assert keyed.merge_batches(spark, path, StructType.fromDDL(SCHEMA))
    monkeypatch.undo()
    assert len(plans) == 3 and not any("Exchange" in p for p in plans)
    assert stored(spark, path) == before and len(keyed.table_state(spark, path).batches) == 1
    again = frame(spark, [f"n{i}" for i in range(130)], 9)
    assert keyed.insert_new(spark, path, again, KEYS) == 10
