"""Answers of a model as they come: fenced, cut, without a list, with strange objects."""

from opinara import schema as S
from opinara.operators import records as R


def test_validated_extractions(spark):
    contents = {
        1: '```json\n{"results": [{"review_id": "1a", "overall_sentiment": "negative", "features": [{"feature": "cap", "sentiment": "negative", "intensity": 0.5}], "trust_indicators": {"usage_context": true}}, {"review_id": "1b"}, {"review_id": "1b", "overall_sentiment": "mixed"}]}\n```',
        2: '{"results": [{"review_id": "2a", "overall_sentiment"', 3: '{"results": {"review_id": "3a"}}', 4: "", 5: None,
        6: '{"results": [{"review_id": "6a", "features": "none", "trust_indicators": [1]}, 7, null, {"overall_sentiment": "positive"}, {"review_id": "9z"}]}', 7: "[1, 2]",
    }
    reviews = spark.createDataFrame([(k, f"{k}{c}", "kept") for k in [*contents, 8] for c in "ab"] + [(1, "1a", "again"), (None, None, "none")], "batch int, review_id string, extra string")
    rows = R.validated_extractions(reviews, spark.createDataFrame(list(contents.items()), "batch int, content string")).collect()
    assert len(rows) == reviews.count()
    got = {(x.review_id, x.extra): x for x in rows}
    a = got["1a", "kept"]
    assert (a.overall_sentiment, a.features[0].feature, a.features[0].intensity, a.trust_indicators, a.human_review_needed, a.error_message) == ("negative", "cap", 0.5, {"usage_context": True}, False, None)
    assert got["1a", "again"].overall_sentiment == "negative" and got["1b", "kept"].overall_sentiment == "mixed" and got["1b", "kept"].features == []
    assert (got["6a", "kept"].features, got["6a", "kept"].trust_indicators, got["6a", "kept"].error_message) == ([], {}, None)
    errors = {r: x.error_message for (r, _), x in got.items()}
    assert {errors[r] for r in ("2a", "2b", "4a", "5a", "8a", None)} == {S.NO_JSON}
    assert {errors[r] for r in ("3a", "7b")} == {S.NO_RESULTS} and errors["6b"] == S.MISSING_RESULT
    assert all(x.human_review_needed == (x.error_message is not None) and (x.error_message is None or x.overall_sentiment == "neutral") for x in rows)
    assert R.validated_extractions(reviews.limit(0), spark.createDataFrame([], "batch int, content string")).count() == 0
