"""What an import makes more than once: texts of whole conversations, rows of messages, copies of whole documents."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import json_keys_without
from evidentia.operators import validate
from evidentia.plans import importing
from evidentia.plans.merge_queries import documents
from evidentia.plans.views import Views
from evidentia.sources import manifests

CONVERSATIONS = [
    '{"b":1,"a":null,"messages":[{"x":1}],"title":"é\\u0001\\"<>/","z":{"q":null,"p":[1,2.50,1e3,1000.0,1e300,null]},"A":12345678901234567890}',
    '{"d":1.10,"e":-0,"e2":-0.0,"f":true,"g":"2020-01-01","h":[],"i":{},"j":0.00000012,"k":123456789012345678901234567890123456789012.5}',
    '{"":"e","a.b":1,"messages":{"k":1},"$":[{"messages":2}]}', '{"messages":[]}', "{}", "[1]", '"x"', "null", "5",
]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_messages_are_left_out_before_a_conversation_becomes_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CONVERSATIONS)], "n int, t string").select("n", F.try_parse_json("t").alias("conversation"))
    whole = rows.select("n", F.coalesce(json_keys_without(F.to_json("conversation"), ["messages"]), F.lit("{}")).alias("raw_json"))
    made = manifests.conversation_raw(rows)
    assert {r.n: r.raw_json for r in made.collect()} == {r.n: r.raw_json for r in whole.collect()}
    stated = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "to_json(conversation" not in stated(made) and "to_json(conversation" in stated(whole)


def test_messages_and_documents_are_taken_apart_once(spark, monkeypatch):
    staged, real = {}, importing.stage
    monkeypatch.setattr(importing, "stage", lambda df, label: (staged.__setitem__(label, plan(df)), real(df, label))[1])
    v = Views(spark, "/root/testdata/sf0.001")
    importing.import_documents(documents(v, 1), v.files, F.timestamp_seconds(F.lit(0)))
    assert "Generate" not in staged["messages"]
    # copies of documents are told without the documents
    assert not any("first(doc" in line for line in staged["sources"].splitlines() if "Aggregate" in line)


@pytest.mark.parametrize("field", ["participants", "messages", "parts"])
def test_a_list_is_told_without_the_schema_of_its_elements(spark, field):
    values = ["[]", "[1]", '[{"a":[]},2]', "{}", '"[]"', "null", "5", None]
    rows = spark.createDataFrame([(i, "{}" if x is None else f'{{"{field}":{x}}}') for i, x in enumerate(values)], "n int, t string")
    found = rows.select("n", validate._is_array(F.try_parse_json("t"), field).alias("is_array"))
    assert {r.n for r in found.collect() if r.is_array} == {0, 1, 2}
    problems = validate.problems_of_document()
    assert f"$.{field}, VariantType, false, Some(UTC))), ^([A-Z]+)" not in plan(
        spark.createDataFrame([("{}",)], "content string").select(F.lit("/x").alias("path"), "content").transform(manifests.parse_documents).select(problems)
    )
