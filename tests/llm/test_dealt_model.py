"""The quality model dealt over buckets gives what the broadcast one gives, to the last bit."""

import numpy as np
import pytest

from helixframe.llm import quality_rules as rules


@pytest.fixture(scope="module")
def docs(spark):
    draw = np.random.default_rng(3)
    words = ["".join(draw.choice(list("etaoinshrdlu"), draw.integers(2, 7))) for _ in range(300)]
    rows = [(i, ["en", "de", None][i % 3], " ".join(draw.choice(words, 60 + i % 40)), i) for i in range(120)]
    rows += [(200 + i, "en", "".join(draw.choice(list("xqzj#kvw é漢"), 500)) + " q" * 3 + " w" * 3, i) for i in range(4)]
    rows += [(300, "en", "", 0), (301, "de", None, 0), (302, None, "kurz", 0), (302, None, "kurz", 0)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string, n_chars long").repartition(5).localCheckpoint()


def test_the_model_s_size_changes_no_result(spark, docs, monkeypatch):
    order = lambda df: sorted(map(repr, df.collect()))
    small = order(rules.quality_rules(docs, "doc_id")), order(rules.quality_filter(docs))
    monkeypatch.setattr(rules, "MOST_GRAMS", 100)
    monkeypatch.setattr(rules, "UNIT_CHARS", 2000)
    dealt = order(rules.quality_rules(docs, "doc_id")), order(rules.quality_filter(docs))
    assert dealt == small
    assert 60 < len(small[1]) < len(small[0])


def test_rows_tables_do_not_pile_up(spark, docs, tmp_path, monkeypatch):
    from helixframe import storage

    there, most = [], []
    put, remove = storage._put, storage.remove
    monkeypatch.setattr(storage, "_put", lambda df, path: (there.append(path), most.append(sum("grams" not in p for p in there)), put(df, path))[2])
    monkeypatch.setattr(storage, "remove", lambda spark_, path: (there.remove(path), remove(spark_, path))[1])
    with rules.Scratch(spark):
        rules.quality_rules(docs, "doc_id").count()
    assert max(most) == 2 and not there
