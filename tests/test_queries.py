"""Registered queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from larkspur.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = [
    "e1_log_sizes", "e3_overlap_shares", "e16_location_ratio", "e20_pruning_ceiling", "j5_anti", "a7_describe", "a22_string_aggregate", "w4_limit_by_group", "l2_shared_items", "l4_stratified_sample",
    "r1_bm25_title_index", "r8_location_prior", "r10_token_bayes", "r5_char_trigrams", "k8_recall_at_k", "l6_hard_negatives", "p5_parameters", "p9_item_texts", "p17_remote_flags", "u2_candidate_union", "feature_rows", "k6_quota_assembly", "k9_eval_rank", "k11_dense_eval", "k16_density", "l8_negative_groups", "r4_field_weighted_bm25",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are elsewhere")


def plain(rows, columns):
    def one(v):
        if isinstance(v, (list, tuple)):
            return tuple(map(one, v))
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(one(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([r.asDict() for r in got.collect()], got.columns) == plain([dict(zip(want.columns, r)) for r in want.fetchall()], got.columns)


def test_every_query_but_the_ranker_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"k1_pairwise_ranker", "k20_ranker_study"}


def test_scenario_discriminates():
    """The relational scenario's shares and strata differ, so that a wrong plan shows."""
    con = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.01/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    rows = lambda n: con.sql(registry.oracle_sql()[n]).fetchall()
    assert all(0 < x < 1 for x in rows("e3_overlap_shares")[0]) and 0 < rows("e9_corpus_in_queried_locations")[0][0] < 1 and 0 < rows("e15_location_coverage")[0][0] < 1
    assert rows("e12_any_category") and rows("e21_items_with_two_titles")[0][0] > 0 and len(rows("e17_no_filter_by_frequency")) == 3
    assert len({r[2] for r in rows("e13_filter_shares")}) > 1 and {r[2] for r in rows("l4_stratified_sample")} == {0, 1}


def test_sources(spark, tmp_path):
    from larkspur.sources import tables

    df = spark.createDataFrame([("a", ""), ("b", "NA")], "x string, y string")
    tables.write_csv(df.coalesce(1), str(tmp_path / "c"))
    assert sorted(map(tuple, tables.read_csv_text(spark, str(tmp_path / "c"), ["x", "y"]).collect())) == [("a", ""), ("b", "NA")]
    calls = []
    make = lambda: calls.append(1) or df
    for _ in range(2):
        assert tables.table_or_write(spark, str(tmp_path / "t"), make).count() == 2
    assert calls == [1] and tables.read_lines(spark, str(tmp_path / "c")).count() == 3


def test_item_ids_of_more_than_five_digits(spark, tmp_path):
    """As in the SQL, where lpad cuts what is longer."""
    spark.createDataFrame([(7, "\u00a0a b \u00a0", "en", "src1", 6), (123456, "a\x0bb  c", "en", "src2", 6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for t in ("benchmark", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = {r[0]: r for r in con.sql(f"select doc, vid, item_text from ({registry.oracle_sql()['p9_item_texts']})").fetchall()}
    got = {r.doc: (r.doc, r.vid, r.item_text) for r in registry.queries()["p9_item_texts"](spark, str(tmp_path)).collect()}
    assert got == want and got[123456][1] == "v12345"


def test_overlap_shares_read_the_log_once(spark):
    plan = registry.queries()["e3_overlap_shares"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") and plan.count("Relation [l_orderkey") == 1
