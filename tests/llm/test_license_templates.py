import pytest

from tidewrack.llm import license_scan


@pytest.mark.parametrize("text", ["Licensed under CC0.", ""])
def test_short_templates_raise(spark, text):
    templates = spark.createDataFrame([("X", "one two three four five"), ("Short", text)], "license string, text string")
    docs = spark.createDataFrame([(1, "Licensed under CC0.")], "doc_id long, text string")
    with pytest.raises(ValueError, match="Short"):
        license_scan.scan(docs, templates)
