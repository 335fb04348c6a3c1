"""Queries that once read a part of their input."""

from lodestone.plans import catalog


def test_language_class_reads_past_the_first_signs(spark, tmp_path):
    # Over 60 signs, and no block that repeats: letters that repeat as a block are gibberish too.
    plain = "a line of one idea goes on over here as a road to a lake or a hill in a far away area by sea "
    rows = [(1, "s", "en", plain + "سلام " * 40), (2, "s", "en", plain), (3, "s", "en", plain + "bcdfghjk"), (4, "s", "en", plain * 5)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["class"]: r["n"] for r in catalog.queries()["language_class"](spark, str(tmp_path)).collect()}
    assert got == {"mixed": 1, "latin": 1, "gibberish": 2}
