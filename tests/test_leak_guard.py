"""Values that may not be kept, and incidents that never hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.text import pii_incident
from weft.operators.records import leak_guard


def test_values_go_and_incidents_name_kinds_only(spark):
    rows = [
        (1, "note", "write to a@b.org or 0612 345 678", "KNOWN"), (2, "author_name", "x", "KNOWN"), (3, "place", "0612 345 678", "KNOWN"),
        (4, "note", None, "MISSING"), (5, "note", "", "KNOWN"), (6, "note", "at 10.0.0.1", "KNOWN"), (7, "author_name", None, "MISSING"), (8, None, "plain", "KNOWN"),
    ]
    df = spark.createDataFrame(rows, "id int, key string, value string, status string")
    kept, incidents = leak_guard(df, pii_incident(F.col("value"), F.col("key"), {"phone": ("place",)}, ("author",)))
    assert {r["id"]: r["kinds"] for r in incidents.collect()} == {1: "email,phone", 2: "identifier_field", 6: "ip"}
    got = {r["id"]: (r["value"], r["status"], r["redacted"]) for r in kept.collect()}
    assert got[1] == got[6] == (None, "REVIEW", True) and got[2] == (None, "NOT_PROVIDED", True)
    assert got[3] == ("0612 345 678", "KNOWN", False) and got[4] == (None, "MISSING", False) and got[8] == ("plain", "KNOWN", False)
    assert incidents.columns == ["id", "key", "kinds"] and leak_guard(df.limit(0), F.array(F.lit("ip")))[1].count() == 0
