"""Every query of the subpackage on the smallest tables: against its SQL, brute force or the columns it promises."""

import itertools
import re

import pytest
from conftest import SF, same_as_sql

from tessera.llm import catalog

#: Columns of the queries that TESTDATA.md fixes.
COLUMNS = {
    "p1_found": "claim_field_id, sentence_index int, char_start int, char_end int",
    "p2_found": "source_id, line_no int",
    "p3_found": "item_table, id_a, id_b",
    "p4_found": "source_id, line_no int",
    "p6_found": "evidence_unit_id",
    "p7_found": "item_table, item_id",
    "p8_ids": "doc_id bigint, ids array<int>",
    "p10_found": "doc_id bigint, kind, char_start int, char_end int",
}
#: So few rows show no limit.
EMPTY = {"p6_limits"}


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    same_as_sql(spark, duck, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in COLUMNS:
        assert dict(df.dtypes) == {c.split()[0]: (c.split() + ["string"])[1] for c in COLUMNS[name].split(", ")}
    rows = df.collect()
    assert rows or name in EMPTY
    if name.endswith("_found"):
        assert len(set(map(tuple, rows))) == len(rows)


def test_near_pairs_of_the_tables_equal_brute_force(spark):
    want = set()
    for space in (0, 1):
        sets = {}
        for r in catalog.texts_for_neardup(spark, SF).where(f"space = {space}").collect():
            w = re.findall(r"[^\W_]+", (r.text or "").lower())
            if w:
                sets[r.id] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)}
        for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
            if len(x & y) >= 0.6 * len(x | y):
                want.add((catalog.SPACES[space], a, b))
    got = {(r.item_table, r.id_a, r.id_b) for r in catalog.QUERIES["p3_found"](spark, SF).collect()}
    assert want and got <= want and len(want - got) <= 0.01 * len(want)


def test_token_ids_of_the_tables_equal_the_library(spark):
    from tessera.llm import tokens

    enc = tokens.encoding(tokens.VOCABULARY)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: list(r.ids) for r in catalog.QUERIES["p8_ids"](spark, SF).collect()} == {i: enc.encode_ordinary(t) if t else [] for i, t in texts.items()}
