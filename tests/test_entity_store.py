"""What the entity match stores of a text."""

from pyspark.sql import functions as F

from newsflow.operators import entities


def test_one_form_of_a_text_is_stored(spark, monkeypatch):
    stored, keep = [], entities.materialise
    monkeypatch.setattr(entities, "materialise", lambda df, label: stored.append(keep(df, label)) or stored[-1])
    master = spark.createDataFrame([("00001.HK", "阿里巴巴", "Big Firm"), ("00002.HK", None, "Other")], "stock_code string, company_name_zh string, company_name_en string")
    articles = spark.createDataFrame([("a", "news of big firm"), ("b", "阿里巴巴 rises"), ("c", "00002.HK up")], "cleaned_id string, body_cleaned string")
    rows = entities.mentioned_stocks(articles, master).collect()
    assert {tuple(r) for r in rows} == {("a", "00001.HK"), ("b", "00001.HK"), ("c", "00002.HK")}
    texts = stored[0]
    assert "body_cleaned" not in texts.columns
    assert {r["cleaned_id"] for r in texts.where(F.col("_text").isNotNull()).collect()} == {"b"}
