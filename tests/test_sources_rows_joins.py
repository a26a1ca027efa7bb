from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cohortloom import operators as op
from cohortloom import sources as src
from cohortloom.schema import entities, entity_schema, field_name, normalise_fields


def test_field_names():
    assert field_name("Status_Change_Reason__c") == "status_change_reason"
    assert field_name("HealthCloudGA__Age__pc") == "health_cloud_ga_age"
    assert field_name("AccountId") == "account_id"
    assert field_name("What_can_ACME_help_you_with__c", "ACME") == "what_can_help_you_with"
    assert field_name("COQ_F_ACME_Prevent_Attempt__c", "ACME") == "coq_f_prevent_attempt"
    assert field_name("CP_ACME_Contact_Level__c", "ACME") == "cp_contact_level"
    assert field_name("AC_Impact__c", ["ACME", "AC"]) == "impact"


def test_schemas_cover_every_entity():
    sizes = {e: len(entity_schema(e)) for e in entities()}
    assert sizes == {"case": 41, "account": 16, "case_note": 42, "form": 63, "contact_analytics": 2, "owner": 3,
                     "survey": 6}


def test_normalise_fields_rejects_clash(spark):
    df = spark.createDataFrame([(1, 2)], "A__c int, A__pc int")
    with pytest.raises(ValueError):
        normalise_fields(df)


def test_entity_drift_fails(spark, tmp_path):
    path = str(tmp_path / "owner")
    spark.createDataFrame([("1", "n")], "id string, name string").write.parquet(path)
    assert src.read_entity(spark, path, "owner", ["id", "name"]).count() == 1
    with pytest.raises(ValueError):
        src.read_entity(spark, path, "owner")


def test_window_is_half_open(spark):
    ts = [dt.datetime(2023, 12, 1, 5), dt.datetime(2024, 3, 1, 5), dt.datetime(2024, 1, 1), None]
    df = spark.createDataFrame([(x,) for x in ts], "t timestamp")
    out = src.time_window(df, "t", "2023-12-01T05:00:00Z", "2024-03-01T05:00:00Z")
    assert rows(out, "t") == sorted([(ts[0],), (ts[2],)], key=repr)


def test_null_or_ne_and_semi_join(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert rows(df.filter(src.null_or_ne(F.col("k"), "a")), "k") == [("b",), (None,)]
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    assert rows(src.key_semi_join(df, "k", keys, "x"), "k") == [("a",)]
    assert rows(src.key_semi_join(df, "k", keys, "x", drop_null_keys=False), "k") == [("a",), (None,)]


def test_survey_scan(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("Year,Question,Percentage,SE,CI.lower,CI.upper\n2008,Some question,0.15,0.07,0.06,0.41\n")
    got = src.survey_scan(spark, str(path))
    assert got.columns == ["year", "question", "percentage", "se", "ci_lower", "ci_upper"]
    assert [tuple(r) for r in got.collect()] == [(2008, "Some question", 0.15, 0.07, 0.06, 0.41)]
    path.write_text("Year,Question,SE,Percentage,CI.lower,CI.upper\n2008,Some question,0.15,0.07,0.06,0.41\n")
    with pytest.raises(Exception, match="header"):
        src.survey_scan(spark, str(path)).collect()


def test_csv_sink_spells_missing(spark, tmp_path):
    out = str(tmp_path / "out")
    src.write_csv(spark.createDataFrame([("1", None), ("2", "x")], "id string, v string").coalesce(1), out)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.splitlines() == ["id,v", "1,NA", "2,x"]


def test_exclusion_rules(spark):
    df = spark.createDataFrame([("bad", "A"), ("ok", "C"), (None, "A"), (None, "C"), (None, None)], "r string, s string")
    assert rows(op.exclude_list(df, "r", ["bad"]), "r", "s") == sorted(
        [("ok", "C"), (None, "A"), (None, "C"), (None, None)], key=repr
    )
    assert rows(op.exclude_list_status(df, "r", ["bad"], "s", "A"), "r", "s") == sorted(
        [("ok", "C"), (None, "A")], key=repr
    )


def test_test_names_dropped_in_any_case(spark):
    df = spark.createDataFrame(
        [("Ann", False), ("a tEst b", False), ("Rrbc 1", False), (None, False), ("Bob", True), ("Cy", None)],
        "n string, t boolean",
    )
    assert rows(op.drop_test_names(df, "n", ["TEST", "RRBC"], "t"), "n") == [("Ann",), (None,)]


def test_subset_keeps_missing_conditions_as_missing(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", None)], "v string, c int")
    assert rows(op.na_subset(df, "v", F.col("c") == 1), "v") == [("a",), (None,)]


def test_project_checks_names(spark):
    with pytest.raises(ValueError):
        op.project(spark.range(1), keep=["nope"])


def test_derive_chain_sees_earlier_steps(spark):
    out = op.derive_chain(spark.range(1), [("a", F.col("id") + 1), ("b", F.col("a") * 2)])
    assert rows(out, "a", "b") == [(1, 2)]


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, y int")
    assert rows(op.inner_join(left, right, "k"), "k", "x", "y") == [("a", 1, 10)]
    assert rows(op.null_safe_join(left, right, "k", "left"), "k", "x", "y") == sorted(
        [("a", 1, 10), (None, 2, 20), ("c", 3, None)], key=repr
    )
    assert rows(op.null_safe_join(left, right, "k", "full"), "k", "x", "y") == sorted(
        [("a", 1, 10), (None, 2, 20), ("c", 3, None)], key=repr
    )
    assert rows(op.left_join_fill(left, right, "k", {"y": 0}), "k", "x", "y") == sorted(
        [("a", 1, 10), (None, 2, 0), ("c", 3, 0)], key=repr
    )
    dim = spark.createDataFrame([("a", "Ann"), ("c", "Cy")], "k string, name string")
    assert rows(op.dim_join_exclude(left, dim, "k", "name", "Cy"), "k", "name") == [("a", "Ann")]
    calls = spark.createDataFrame([("p1", "text")], "id string, transcript string")
    notes = spark.createDataFrame([("n1", "p1"), ("n2", None), ("n3", "p9")], "n string, call string")
    assert rows(op.call_text_join(notes, calls, "call"), "n", "transcript") == [("n1", "text")]
