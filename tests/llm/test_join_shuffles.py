"""The n-gram join's keys cross the network once."""

from ruleloom.llm import ngram_join


def test_keys_are_shuffled_once(spark, monkeypatch):
    plans, materialize = [], ngram_join.materialize

    def looked_at(df, name):
        if name == "op1-members":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return materialize(df, name)

    monkeypatch.setattr(ngram_join, "materialize", looked_at)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = " ".join(f"w{i}" for i in range(40))
        docs = spark.createDataFrame([(0, words), (1, words + " x"), (2, "some other text that is long enough"), (3, None)], "doc_id long, text string")
        out = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_components(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out == {0: 0, 1: 0, 2: 2, 3: 3}
    assert len(plans) == 1 and "ReusedExchange" in plans[0]
