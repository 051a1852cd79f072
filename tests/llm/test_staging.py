"""Staged tables: parts, and the driver's memory after them."""

from namewright.llm import common


def test_parts_are_one_table(spark):
    made = common.stage_parts((spark.range(i, i + 3) for i in (0, 3, 6)), "parts")
    assert sorted(r.id for r in made.collect()) == list(range(9))
    common.drop_staged(made)


def test_the_driver_gives_memory_back_after_each_table(spark, monkeypatch):
    said, give_back = [], common.give_back
    monkeypatch.setattr(common, "give_back", lambda s: said.append(give_back(s)))
    common.drop_staged(common.stage_table(spark.range(3), "one"))
    assert len(said) == 1 and said[0].splitlines()[-1].startswith("Trim native heap")
