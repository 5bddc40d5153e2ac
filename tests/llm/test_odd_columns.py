"""Columns with dots, clashing names and maps pass through every stage that keeps rows."""

from memoria.llm.decontamination import decontaminate
from memoria.llm.near_duplicates import keep_one
from memoria.llm.quality import keep_quality
from memoria.llm.repeats import remove_repeats

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards boil quarts of nitrogen under a cold moon"
SCHEMA = "doc_id long, text string, `label.x` int, row string, `text.y` struct<text: string>, tags map<string, int>, fp binary, item_id long, n_chars long"


def test_dotted_and_map_columns(spark):
    one = lambda k, text: (k, text, 1, "r", ("t",), {"a": k or 0}, b"f", 5, 9)
    words = " ".join(f"word{i}" for i in range(60))
    rows = [one(1, words), one(2, words), one(2, words), one(3, None), one(3, None), one(None, ""), one(4, f"x {ITEM} y"), one(5, "plain")]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(str(x.doc_id) for x in kept.collect()) == ["1", "3", "4", "5", "None"]
    clean = decontaminate(df, items)
    assert clean.columns == df.columns and sorted(str(x.doc_id) for x in clean.collect()) == ["1", "2", "2", "3", "3", "5", "None"]
    assert {x["label.x"] for x in clean.collect()} == {1} and clean.filter("doc_id = 5").first().tags == {"a": 5}
    assert keep_quality(df, labels, threshold=0.0).columns == df.columns and keep_quality(df, labels, threshold=0.0).count() == len(rows)
    assert remove_repeats(df, length=240).columns == df.columns and remove_repeats(df, length=240).count() == len(rows)
    for stage in (keep_one(df.limit(0)), decontaminate(df.limit(0), items), keep_quality(df.limit(0), labels), remove_repeats(df.limit(0))):
        assert stage.columns == df.columns and stage.count() == 0
