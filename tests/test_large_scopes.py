"""Queries that compare all rows of a project, over one project that holds everything: right, and without moving pairs that merely share a word."""

import glob
import os
import shutil

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import overlaps

OTHER = os.path.join(os.path.dirname(SF.rstrip("/")), "sf0.01")


@pytest.fixture(scope="module")
def one_project(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("one-project"))
    for f in glob.glob(f"{OTHER}/*.parquet"):
        name = os.path.basename(f)
        if name in ("sources.parquet", "claim_fields.parquet"):
            spark.read.parquet(f).withColumn("project_id", F.lit("p")).write.parquet(f"{d}/{name}")
        else:
            shutil.copy(f, d)
    return d


def shuffled(spark, run):
    """(result of run, rows that its jobs wrote to shuffles)."""
    sc = spark.sparkContext
    sc.setJobGroup(group := f"shuffled-{id(run)}", "")
    got = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker, rows = sc.statusTracker(), 0
    for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
        rows += sc._jsc.sc().statusStore().lastStageAttempt(stage).shuffleWriteRecords()
    return got, rows


@pytest.mark.parametrize("name", ["agg16_weighted_scores", "joi11_potential_evidence", "srt6_suggested", "sco12_claim_confidence_loose", "joi10_assess_loose"])
def test_only_sets_are_shuffled(spark, one_project, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("sources", "evidence_units", "claim_fields", "citations"):
        con.execute(f"create view {t} as select * from read_parquet('{one_project}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{one_project}/{t}.parquet') else ''}')")
    got, rows = shuffled(spark, lambda: catalog.QUERIES[name](spark, one_project).toPandas())
    want = con.execute(catalog.SQL[name]).df()
    assert rows_of(got) == rows_of(want[list(got.columns)])
    units, = con.execute("select count(*) from evidence_units").fetchone()
    assert 0 < rows < 10 * units


@pytest.mark.parametrize("name", ["joi11_potential_evidence", "srt6_suggested", "sco12_claim_confidence_loose", "joi10_assess_loose"])
def test_many_blocks_shuffle_packs(spark, one_project, monkeypatch, name):
    """A set that is sent to many blocks isn't a row for each of them."""
    monkeypatch.setattr(overlaps, "LEFT_ROWS", 64)
    monkeypatch.setattr(overlaps, "RIGHT_ROWS", 128)
    test_only_sets_are_shuffled(spark, one_project, name)


def test_packs_keep_rows():
    sets = [["b", "a"], None, [], ["a"], ["c", "a"]]
    t = pa.table({"k": ["x", "y", "x", "y", "x"], "part": [0, 1, 0, 0, 0], "set": pa.array(sets, pa.list_(pa.string())), "id": list(range(5))})
    out = pa.Table.from_batches(overlaps.pack(iter(t.to_batches(max_chunksize=2)), ["k", "part"]))
    packs = overlaps.unpacked(out["pack"])
    assert {(k, p): x["id"].to_pylist() for k, p, x in zip(out["k"].to_pylist(), out["part"].to_pylist(), packs)} == {("x", 0): [0, 2, 4], ("y", 0): [3], ("y", 1): [1]}
    s, ids = overlaps.Sets(packs), [i for x in packs for i in x["id"].to_pylist()]
    assert s.sizes.tolist() == [len(sets[i] or []) for i in ids] and s.n_codes == 3
    at = lambda i: np.array([ids.index(i)])
    assert [s.shared(at(i), at(j))[0] for i, j in ((0, 3), (0, 4), (1, 3), (2, 0), (4, 4))] == [1, 1, 0, 0, 2]
