from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from bookloom.operators.wordcount import word_count


def counts(spark, lines, mode):
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    return [tuple(row) for row in word_count(df, mode).collect()]


def test_clean_words(spark):
    assert counts(spark, ["It's a \"dog\" -- A dog_1 ' café"], "clean") == [
        ("'", 1), ("1", 1), ("A", 1), ("It's", 1), ("a", 1), ("caf", 1), ("dog", 2),
    ]


def test_whitespace_words(spark):
    assert counts(spark, ["a, b\ta,\x0bc", "", "  a, "], "whitespace") == [
        ("a,", 2), ("a,\x0bc", 1), ("b", 1),
    ]


def test_unknown_mode(spark):
    with pytest.raises(KeyError):
        counts(spark, ["a"], "other")


def test_a_hot_word_is_combined_before_the_shuffle(spark):
    lines = spark.range(0, 4000, 1, 4).selectExpr("concat('the the ', id % 3) as value")
    result = word_count(lines)
    assert {r["word"]: r["count"] for r in result.collect()}["the"] == 8000
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "rangepartitioning(word" in plan


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("abZ_'é1😀 \t\r\n\f.,-", max_size=30), min_size=1, max_size=8))
def test_same_as_counting_one_by_one(spark, lines):
    cleaned = ["".join(c if c.isascii() and c.isalnum() or c == "'" else " " for c in l) for l in lines]
    assert dict(counts(spark, lines, "clean")) == Counter(w for l in cleaned for w in l.split())
    assert dict(counts(spark, lines, "whitespace")) == Counter(w for l in lines for w in l.split())
