"""Line dedup moves and stores no more than its step needs."""

from pyspark.sql import functions as F

from dealtide.llm import fuzzy_lines


def test_only_lines_of_pairs_are_fetched(spark, monkeypatch):
    """Lines may repeat, and none that is in no pair is stored."""
    held, keep = [], fuzzy_lines.settled
    monkeypatch.setattr(fuzzy_lines, "settled", lambda frame: held.append(keep(frame)) or held[-1])
    lines = spark.createDataFrame([(1, "een twee drie vier vijf"), (1, "een twee drie vier vijf"), (2, "een twee drie vier vijf."), (3, "iets anders"), (4, "kort")], "sid long, line string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [tuple(r) for r in fuzzy_lines.similar(pairs, lines, 5, 80).collect()] == [(1, 2)]
    stored = [f for f in held if f.columns == ["sid", "line"]]
    assert [sorted(r.sid for r in f.collect()) for f in stored] == [[1, 2, 3]]


def test_sketches_do_not_go_through_the_window(spark):
    lines = spark.createDataFrame([(n, f"{n % 5} een regel die vaak voorkomt") for n in range(20)], "sid long, line string")
    signed = fuzzy_lines.settled(fuzzy_lines.signatures(lines, 5))
    found = fuzzy_lines.shared_bands(signed)
    plan = found._jdf.queryExecution().optimizedPlan()
    windows = [line for line in plan.toString().split("\n") if "Window [" in line]
    assert windows and not any(" n#" in line for line in windows)
    want = fuzzy_lines.banded(lines, 5)
    many = want.groupBy("sig").agg(F.countDistinct("sid").alias("c")).filter("c > 1").select("sig")
    assert sorted(map(str, want.join(many, "sig").select("sig", "sid", "n").collect())) == sorted(map(str, found.collect()))
