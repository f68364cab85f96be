from stratalog.llm import sentences as S
from stratalog.session import ship

from .test_sentences import learned as learn


def learned(spark, bodies):
    df = spark.createDataFrame([(i, f"Subject {i}\n\n{b}") for i, b in enumerate(bodies)], "doc_id bigint, text string").selectExpr("*", "'en' AS lang")
    return {(r["kind"], r["a"]) for r in learn(df).collect()}


def test_a_letter_is_judged_by_how_it_is_used_and_not_by_its_count(spark):
    ship(spark)
    plain = "The queue is full of this and that. We stop it when the disk is full! The end of it is near."
    # 16 periods, all at sentence ends; 40 periods, all inside a sentence but beside as many bare letters; 3 periods say nothing
    ends = [f"The value is q. We stop. {plain}"] * 16
    inside = [f"We ask k. about it. The size of it is k here. {plain}"] * 40
    few = [f"The value is j. We stop. {plain}"] * 3
    found = learned(spark, ends + inside + few)
    assert ("ordinary", "q") in found
    assert ("ordinary", "k") not in found and ("ordinary", "j") not in found
