"""Training takes whole texts of the rows that it samples."""

from memoria.llm import toxicity


def test_training_takes_whole_texts(spark, monkeypatch):
    texts = {i: "clean words " * (6000 + i) + f"zorgblat{i}" for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in texts], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "ToxicityModel", lambda found, toxic: seen.append(dict(zip(found, toxic))))
    toxicity.train(docs, labels)
    toxic = {t.encode(): float(i % 2) for i, t in texts.items()}
    assert len(seen[0]) >= 10 and seen[0].items() <= toxic.items()
    for most, rows in ((150_000, 2), (10, 1)):
        monkeypatch.setattr(toxicity, "MAX_BYTES", most)
        toxicity.train(docs, labels)
        assert seen[-1].items() <= toxic.items() and sorted(seen[-1].values()) == [0.0] * rows + [1.0] * rows
