"""Stages: switches, settings, skipping, repeats and time limits."""

import time

import pytest

from helixframe.stages import Stage, StageTimeout, filled, run_stages


def test_settings_fill_each_other():
    assert filled({"a": "x${b}", "b": "${c}y", "c": "z"}) == {"a": "xzy", "b": "zy", "c": "z"}
    with pytest.raises(KeyError):
        filled({"a": "${nowhere}"})
    with pytest.raises(ValueError):
        filled({"a": "${b}", "b": "${a}"})


def test_stages_are_switched_and_skipped(spark, tmp_path):
    made = []

    def first(spark, settings, tables):
        made.append("first")
        return spark.range(int(settings["rows"]))

    def second(spark, settings, tables):
        made.append("second")
        return tables["first"].filter("id > 1")

    stages = [Stage("first", first), Stage("second", second, on=False)]
    got = run_stages(spark, stages, str(tmp_path), {"rows": "${n}", "n": "5"})
    assert list(got) == ["first"] and got["first"].count() == 5
    got = run_stages(spark, stages, str(tmp_path), {"rows": "9"}, only=["second"])
    assert sorted(r.id for r in got["second"].collect()) == [2, 3, 4] and made == ["first", "second"]
    with pytest.raises(ValueError):
        run_stages(spark, stages, str(tmp_path), only=["third"])


def test_empty_and_failed_stages_are_repeated(spark, tmp_path):
    tries = []

    def late(spark, settings, tables):
        tries.append(len(tries))
        if len(tries) == 1:
            raise OSError("not there yet")
        return spark.range(0 if len(tries) == 2 else 3)

    assert run_stages(spark, [Stage("late", late, attempts=5)], str(tmp_path))["late"].count() == 3 and len(tries) == 3
    tries.clear()
    with pytest.raises(OSError):
        run_stages(spark, [Stage("once", late)], str(tmp_path))


def test_a_stage_over_its_time_is_cancelled(spark, tmp_path):
    def endless(spark, settings, tables):
        return spark.range(10**13).selectExpr("sum(sqrt(id)) AS s")

    began = time.monotonic()
    with pytest.raises(StageTimeout):
        run_stages(spark, [Stage("endless", endless, seconds=1, attempts=3)], str(tmp_path))
    assert time.monotonic() - began < 30
    assert run_stages(spark, [Stage("quick", lambda *_: spark.range(2), seconds=60)], str(tmp_path))["quick"].count() == 2
