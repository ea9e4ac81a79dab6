"""Publishing versions: a log that two writers can't both extend, and imports on top of it; mentions grouped by keys that many share."""

import threading

import pytest
from pyspark.sql import functions as F

from graphloom.operators import resolve
from graphloom.operators.apply import empty_graph, import_batch
from graphloom.sources.snapshots import CommitConflict, SnapshotStore
from graphloom.streaming.ingest import current_graph, import_run

from .test_graph import FIRST, batch, frame


def small(spark, *ids):
    return {"nodes": spark.createDataFrame([(i,) for i in ids], "id string")}


def test_a_version_from_an_old_parent_is_refused(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert store.head() == 0 and store.latest() == []
    assert store.publish("a", small(spark, "1")) == 1
    assert store.publish("b", small(spark, "1", "2"), parent=1) == 2
    with pytest.raises(CommitConflict):
        store.publish("c", small(spark, "9"), parent=1)
    with pytest.raises(ValueError):
        store.publish("a", small(spark, "9"))
    assert store.publish("d", small(spark, "3"), branch="draft") == 3  # another branch doesn't conflict
    assert store.publish("e", small(spark, "4"), parent=2) == 4
    assert store.latest(9) == ["e", "b", "a"] and [r.parent for r in store.runs().orderBy("seq").collect()] == [0, 1, 2]
    assert sorted(r.id for r in store.load("nodes", "b").collect()) == ["1", "2"]


def test_of_two_writers_at_once_one_fails_and_leaves_nothing(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path))
    store.publish("base", small(spark, "0"))
    barrier, told = threading.Barrier(2), {}
    create = SnapshotStore._create

    def together(self, path, text):
        barrier.wait(60)  # both have checked the head and written their tables
        return create(self, path, text)

    monkeypatch.setattr(SnapshotStore, "_create", together)

    def write(name):
        try:
            told[name] = store.publish(name, small(spark, name))
        except CommitConflict as e:
            told[name] = e

    writers = [threading.Thread(target=write, args=(n,)) for n in ("x", "y")]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    won = [n for n, r in told.items() if r == 2]
    assert len(won) == 1 and sum(isinstance(r, CommitConflict) for r in told.values()) == 1
    assert store.latest() == [won[0], "base"] and [r.id for r in store.load("nodes", won[0]).collect()] == won


def test_imports_conflict_or_are_made_again(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path))
    import_run(store, frame(spark, FIRST), "r1")
    other = batch("r2", [("Otro", "entity", "Otro")], [])
    publish, once = SnapshotStore.publish, []

    def late(self, name, *args, **kw):
        if name == "r2" and not once:
            once.append(publish(self, "between", current_graph(store).tables()))
        return publish(self, name, *args, **kw)

    monkeypatch.setattr(SnapshotStore, "publish", late)
    with pytest.raises(CommitConflict):
        import_run(store, frame(spark, other), "r2")
    assert store.latest() == ["between", "r1"]
    once.clear()
    store = SnapshotStore(spark, str(tmp_path / "again"))
    import_run(store, frame(spark, FIRST), "r1")
    import_run(store, frame(spark, other), "r2", retries=1)
    assert store.latest(9) == ["r2", "between", "r1"]
    names = {r.name for r in current_graph(store).nodes.collect()}
    assert {"Otro", "Cliente"} <= names
    before = store.head()
    assert import_run(store, frame(spark, other), "r3").noop and store.head() == before


def test_a_branch_starts_from_main_and_leaves_it(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    import_run(store, frame(spark, FIRST), "r1")
    import_run(store, frame(spark, batch("r2", [("Otro", "entity", "Otro")], [])), "r2", branch="draft")
    assert store.latest() == ["r1"] and store.latest(2, "draft") == ["r2"]
    assert current_graph(store, "draft").nodes.count() == current_graph(store).nodes.count() + 1


def one_by_one(rows, keys, stored):
    made, out = [], {}
    for m in rows:
        hit = next((c for c in made if keys[c] & keys[m]), None)
        if hit:
            out[m] = ("joined", hit)
        elif m in stored:
            out[m] = ("stored", None)
        else:
            made.append(m)
            out[m] = ("created", m)
    return out


def test_a_key_that_all_mentions_share_takes_few_rounds(spark, monkeypatch):
    rounds, cut = [], resolve.cut
    monkeypatch.setattr(resolve, "cut", lambda df, name="": rounds.append(name) or cut(df, name))
    rows = [("r", f"{k:05d}", k, "entity", "caso") for k in range(3000)]
    df = spark.createDataFrame(rows, "run_id string, mention_id string, pos int, type string, mention string")
    fuzzy = df.where("pos < 1000 or pos % 3 = 0").select("mention_id", F.lit("node").alias("node_id"), F.lit(0.95).alias("score"))
    stored = {r.mention_id for r in fuzzy.collect()}
    got = {r.mention_id: (r.outcome, r.creator) for r in resolve.group_in_batch(df, fuzzy).collect()}
    assert got == one_by_one([r[1] for r in rows], {r[1]: {"caso"} for r in rows}, stored)
    assert rounds.count("state") <= 4


def test_importing_keeps_the_pieces_apart(spark):
    """Two runs in one import, with one mention each of the same name, make one node each in their runs' order."""
    one = batch("a", [("Cliente", "entity", "Cliente")], [])
    g = import_batch(empty_graph(spark), frame(spark, one, {**one, "run_id": "b"})).graph
    assert g.nodes.count() == len({r.id for r in g.nodes.collect()})
