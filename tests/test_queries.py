"""Every core query against its SQL on the smallest tables; those without SQL by their own bounds."""

import pytest
from conftest import SF, same_as_sql

from tessera import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    same_as_sql(spark, duck, catalog.QUERIES[name], catalog.SQL[name])


def rows(spark, name):
    got = catalog.QUERIES[name](spark, SF).collect()
    assert got, name
    return got


def test_queries_without_sql_are_those_tested_here():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"stm1_client_limit_stream", "stm3_first_requests_stream", "top4_elbow", "top5_kmeans", "top10_batch"}


def test_streams_agree_with_their_batches(spark, duck):
    got = sorted((r.client, r.ts, r.blocked) for r in rows(spark, "stm1_client_limit_stream"))
    batch = catalog.QUERIES["stm1_client_limit"](spark, SF).join(spark.read.parquet(f"{SF}/events.parquet"), "event_id")
    assert [(c, b) for c, _, b in got] == [(r.user_id, r.blocked) for r in batch.selectExpr("user_id", "cast(ts as timestamp) as ts", "blocked").orderBy("user_id", "ts", "blocked").collect()]
    first = rows(spark, "stm3_first_requests_stream")
    events = dict(duck.execute("select event_id, user_id from events").fetchall())
    assert all(events[r.event_id] == r.user_id for r in first) and {r.user_id for r in first} == {u for u in events.values() if u is not None}


def test_clusters_by_their_cost(spark):
    import numpy as np

    best = rows(spark, "top4_elbow")[0]
    assert 2 <= best.k <= 6 and best.compatible_k == 2
    at = {r.vec_id: r.cluster for r in rows(spark, "top5_kmeans")}
    vec = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert set(at) == set(vec) and len(set(at.values())) == 4
    groups = [np.array([vec[i] for i in at if at[i] == c]) for c in set(at.values())]
    within = sum(((g - g.mean(0)) ** 2).sum() for g in groups)
    x = np.array(list(vec.values()))
    whole, rng = ((x - x.mean(0)) ** 2).sum(), np.random.default_rng(1)
    by_chance = [sum(((x[c == k] - x[c == k].mean(0)) ** 2).sum() for k in range(4)) for c in (rng.integers(0, 4, len(x)) for _ in range(20))]
    assert within < min(by_chance) and within < 0.999 * whole
    rows(spark, "top10_batch")


def test_entry(spark):
    assert catalog.flagship(spark, SF).count() > 0
