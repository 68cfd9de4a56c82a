"""op8 writes the coded texts once; its core is scored anew while n-grams are counted."""

from helixframe.llm import quality_rules as rules


def test_texts_are_written_once(spark, monkeypatch):
    from helixframe import storage

    words = "der die das und nicht ein eine mit von zu auf ist im dem den sich auch als an es wie".split()
    rows = [(i, ["de", None][i % 2], " ".join(words[(i * k * k + k) % 21] for k in range(60 + i))) for i in range(40)]
    docs = spark.createDataFrame([*rows, (99, "de", "")], "doc_id long, lang string, text string")
    wrote = []
    put = storage._put
    monkeypatch.setattr(storage, "_put", lambda df, path: (wrote.append(df.columns), put(df, path))[1])
    with rules.Scratch(spark):
        assert rules.quality_rules(docs, "doc_id").count() == 41
    assert sum("symbols" in columns for columns in wrote) == 1
