"""Hand-computed cases and invariants of the core operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import text as fx
from tessera.operators import claims, graph, keywords, references, relational, similarity, topics, unitize
from tessera.runtime import broadcast_below, latest
from tessera.sources import uploads
from tessera.streaming import audit, limits

UTC = dt.timezone.utc
DAY = dt.datetime(2024, 1, 1, tzinfo=UTC)


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first()[0]


def test_latest_takes_one_row_a_key(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", 1, "x"), (None, 9, "z"), ("c", None, "n")], "id string, t int, v string")
    got = {r.id: r.v for r in latest(df, "id", "t").collect()}
    assert got == {"a": "new", "b": "x", "c": "n"}
    assert latest(df, "id", "t", broadcast_bytes=0).count() == 3
    assert latest(df.limit(0), "id", "t").count() == 0


def test_latest_is_repeatable_where_stamps_tie(spark):
    rows = [("a", 1, f"v{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "id string, t int, v string")
    back = spark.createDataFrame(rows[::-1], "id string, t int, v string")
    assert latest(df, "id", "t").collect() == latest(back.repartition(7), "id", "t").collect()


def test_a_side_is_broadcast_by_its_bytes(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 100, "v string")
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    near, n = broadcast_below(df, 200_000)
    far, _ = broadcast_below(df, 100_000)
    assert n == 100 and "broadcast" in plan(near).lower() and "broadcast" not in plan(far).lower()


def test_unit_spans_without_sentences():
    assert list(unitize.spans(1000, [0, 1000])) == [(0, 400), (450, 850), (900, 1000)]
    assert list(unitize.spans(0, [0])) == [] and list(unitize.spans(400, [0, 400])) == [(0, 400)]


def test_units_slice_back(spark):
    text = "One sentence here. " * 120
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " \n "), (5, "a" * 1000)], "doc_id long, text string")
    rows = unitize.unitize(df).collect()
    assert {r.doc_id for r in rows} == {1, 5}
    norm = " ".join(text.split())
    assert all(norm[r.unit_start : r.unit_end] == r.unit_text for r in rows if r.doc_id == 1)
    assert max(r.unit_end - r.unit_start for r in rows) <= 400


def test_sentence_pieces_count_marks(spark):
    assert one(spark, fx.sentence_pieces(F.col("t")), t="A. B!") == 3
    assert one(spark, fx.sentence_pieces(F.col("t")), t="") == 1


@pytest.mark.parametrize("word,stem", [("running", "runn"), ("cats", "cat"), ("glass", "glass"), ("stations", "station"), ("creation", "crea"), ("as", "as"), ("ing", "ing")])
def test_stem(spark, word, stem):
    assert one(spark, keywords.stem(F.col("t")), t=word) == stem


def test_redaction_is_ordered(spark):
    t = "mail a.b@c.org call 555-123-4567 ssn 123-45-6789 ip 10.0.0.1"
    assert one(spark, fx.redact(F.col("t")), t=t) == "mail [REDACTED_EMAIL] call [REDACTED_PHONE] ssn [REDACTED_SSN] ip [REDACTED_IPADDRESS]"
    df = spark.createDataFrame([({"apiKey": "x", "note": "to a@b.co"},)], "m map<string,string>")
    assert df.select(fx.redact_map(F.col("m"))).first()[0] == {"apiKey": "[REDACTED_SENSITIVE]", "note": "to [REDACTED_EMAIL]"}


def test_similarity_of_equal_and_empty_texts(spark):
    df = spark.createDataFrame([("the cat sat down", "The cat, sat down!"), ("", ""), ("one two", "")], "a string, b string")
    sh = lambda c: similarity.shingles(similarity.prepared(F.col(c)))
    got = [tuple(r) for r in df.select(similarity.jaccard(sh("a"), sh("b")), similarity.cosine(sh("a"), sh("b"))).collect()]
    assert got == [(1.0, 1.0), (1.0, 1.0), (0.0, 0.0)]


def test_prefix_join_is_lossless(spark):
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [("s", i, r.sample(words, r.randint(1, 12))) for i in range(120)] + [("s", 999, words[:5]), ("s", 1000, words[:5])]
    df = spark.createDataFrame(rows, "scope string, id int, sh array<string>")
    cos = lambda x, y: len(set(x) & set(y)) / math.sqrt(len(x) * len(y))
    for t in (0.5, 0.8, 1.0):
        want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and cos(a[2], b[2]) >= t - 1e-12}
        assert {(x.a, x.b) for x in similarity.cosine_pairs(df, t).collect()} == want
    left = df.select("scope", "id", F.col("sh").alias("set"))
    jac = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(a[1], b[1]) for a in rows for b in rows if jac(a[2], b[2]) >= 0.4}
    assert {(x.a, x.b) for x in claims.jaccard_pairs(left, left, 0.4).collect()} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (None, 3)]
    df = spark.createDataFrame(chain, "a int, b int")
    got = {r.node: r.group for r in graph.components(df).collect()}
    assert set(got) == {*range(41), 100, 101} and {got[i] for i in range(41)} == {0} and got[101] == 100
    assert graph.components(df.limit(0)).count() == 0


def test_calibration_and_errors(spark):
    pts = spark.createDataFrame([(0.8, 0.85), (0.6, 0.55), (0.9, 0.95), (0.3, 0.25), (0.7, 0.75), (1.0, 1.0)], "predicted double, actual double")
    assert claims.calibration(pts).agg(F.sum("n")).first()[0] == 5
    flat = spark.createDataFrame([(0.5, 0.1), (0.5, 0.9)], "predicted double, actual double")
    assert flat.agg(claims.correlation("predicted", "actual")).first()[0] == 0.0


def test_persona_without_scores_is_rejected(spark):
    df = spark.createDataFrame([("p", None, 0), ("q", 0.95, 3), ("q", 0.9, 3)], "persona string, score double, support long")
    got = {r.persona: r.recommendation for r in claims.persona_confidence(df).collect()}
    assert got["p"] == "reject" and got["q"] in ("approve", "review")


def test_silhouette_of_one_and_of_one_cluster(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 1, [5.0, 0.0]), (3, 1, [5.0, 1.0])], "id int, c int, v array<double>")
    got = {r.id: r.silhouette for r in topics.silhouette(df, "id", "c", "v").collect()}
    assert got[1] == 1.0 and 0 < got[2] < 1
    assert {r.silhouette for r in topics.silhouette(df.where("c = 1"), "id", "c", "v").collect()} == {0.0}


def test_references_brute_force(spark):
    t = lambda h: DAY + dt.timedelta(hours=h)
    parent = spark.createDataFrame([("evidence_ids", f"u{i}", i * 3_600_000_000, i != 3, i == 5, i == 1) for i in range(50)], references.PARENT)
    c = spark.createDataFrame(
        [("c1", " f1 ", '["u1", " u3 ", null, "u9", "u9"]', t(0), t(4)), ("c1", "f1", '["u1", " u3 ", null, "u9", "u9"]', t(0), t(9)), ("c2", None, "broken [", t(1), t(2)), ("c3", "", "[]", t(1), None), ("c4", None, '["u5", "nope"]', t(800), t(900)), (None, "f", "[]", t(0), t(0))],
        "id string, claim_field_id string, evidence_ids string, created_at timestamp, loaded_at timestamp",
    )
    refs = references.citation_references(c).where("kind = 'evidence_ids'")
    micro = int(DAY.timestamp() * 1e6)
    parent = parent.withColumn("first", F.col("first") + micro)
    want = {("c1", "u3", "missing"), ("c1", "u9", "late"), ("c4", "u5", "deleted"), ("c4", "nope", "missing")}
    for size in (10, 200_000):  # many ranges, one range
        got = references.orphans(refs, parent, range_rows=size, task_refs=2)
        assert {(r.citation_id, r.ref_id, r.kind) for r in got.collect()} == want
    assert references.orphans(refs.limit(0), parent).count() == 0
    assert {r.kind for r in references.orphans(refs, parent.limit(0)).collect()} == {"missing"}


def test_parents_and_their_deletions(spark):
    t = lambda h: DAY + dt.timedelta(hours=h)
    units = spark.createDataFrame(
        [("logged_here", t(0), None), ("marked", t(0), t(3)), (" late ", t(9), None), ("late", t(8), None), ("fine", t(0), None), (None, t(0), None), ("timeless", None, None)],
        "id string, loaded_at timestamp, deleted_at timestamp",
    )
    fields = spark.createDataFrame([("f_logged", t(0)), ("f_late", t(7))], "id string, created_at timestamp")
    audit = spark.createDataFrame(
        [("DELETE", "Evidence_Unit", "logged_here"), (" delete", "evidenceUnits", "logged_gone"), ("UPDATE", "evidence_unit", "updated_gone"), ("DELETE", "claim field", "f_gone"), ("DELETE", "claim-field", "f_logged"),
         ("DELETE", "project", "fine"), ("DELETE", "claim_field", "wrong_kind"), ("DELETE", None, "x"), (None, "evidence_unit", "x")],
        "action string, entity string, entity_id string",
    )
    ids = ["logged_here", "marked", "late", "fine", "timeless", "logged_gone", "updated_gone", "wrong_kind", "f_gone"]
    cited = [("c", "f_gone", str(ids).replace("'", '"'), t(0), t(5)), ("d", "f_logged", None, t(800), t(800)), ("e", "f_late", "[]", t(0), t(5)), ("g", "nothing", "[null]", t(0), t(5))]
    c = spark.createDataFrame(cited, "id string, claim_field_id string, evidence_ids string, created_at timestamp, loaded_at timestamp")
    got = {(r.ref_field[0], r.citation_id, r.ref_id): r.kind for r in references.orphans(references.citation_references(c), references.parents(units, fields, audit)).collect()}
    assert got == {
        ("e", "c", "marked"): "deleted", ("e", "c", "late"): "late", ("e", "c", "logged_gone"): "deleted", ("e", "c", "updated_gone"): "missing", ("e", "c", "wrong_kind"): "missing",
        ("e", "c", "f_gone"): "missing", ("c", "c", "f_gone"): "deleted", ("c", "e", "f_late"): "late", ("c", "g", "nothing"): "missing",
    }


def test_limiter_batch_and_stream_agree(spark, tmp_path):
    rows = [(i, "a" if i % 3 else "b", DAY + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 30, 61, 62, 130, 131, 300])] + [(99, None, DAY)]
    df = spark.createDataFrame(rows, "k int, c string, ts timestamp")
    batch = {r.k: r.blocked for r in limits.fixed_windows(df, "c", "ts", "k", 60, 1).collect()}
    assert batch == {0: False, 1: False, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False, 8: False}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = limits.limiter(s, "c", "ts", 60, 1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    by_time = {(r.c, r.ts): batch[r.k] for r in df.where("c is not null").collect()}
    assert {(r.client, r.ts): r.blocked for r in got.collect()} == by_time


def test_windowed_counts_stream(spark, tmp_path):
    rows = [("x", DAY + dt.timedelta(minutes=m)) for m in (0, 1, 11, 12, 200)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = audit.windowed_counts(s, "ts", "k", "10 minutes").writeStream.format("memory").queryName("win").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("win").orderBy("start").collect()][:2] == [2, 2]


def test_uploads(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.html").write_text("<script>alert(1)</script>")
    got = {r.name: (r.size_ok, r.content_ok, r.extension_ok) for r in uploads.checked(uploads.read(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": (True, True, True), "b.html": (True, False, True)}


def test_filters_that_are_absent_filter_nothing(spark):
    df = spark.createDataFrame([("1", None), ("2", 0.5)], "id string, quality_score double")
    assert df.where(relational.evidence_filter(min_quality=0)).count() == 2
    assert df.where(relational.evidence_filter(min_quality=0.1)).count() == 1


@pytest.mark.parametrize("bad", [lambda: config.ConfidenceConfig(agreement=0.9), lambda: config.ConfidenceConfig(least=0), lambda: config.QualityConfig(authority=0), lambda: config.PromptConfig(max_evidence_length=10), lambda: config.PromptConfig(confidence_threshold=2)])
def test_configs_check_themselves(bad):
    with pytest.raises(ValueError):
        bad()
    config.ConfidenceConfig(), config.QualityConfig(), config.PromptConfig()
