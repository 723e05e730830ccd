"""What the dashboard's pages ask."""

from feedback_engine.operators import explore, tags

ROWS = [(1, "A", 1, 0, 0), (2, "A", 2, 3, 1), (3, "B", 2, None, 0), (4, "B", 2, None, 2)]


def test_periods_and_noise(spark):
    df = spark.createDataFrame(ROWS, "id int, entity string, ord int, before long, after long")
    ids = lambda x: sorted(r["id"] for r in x.collect())
    assert ids(explore.in_period(df)) == [2, 3, 4] and ids(explore.in_period(df, 1)) == [1] and ids(explore.in_period(df, explore.ALL)) == [1, 2, 3, 4]
    assert ids(explore.revealed(df, ["before", "after"])) == [2, 4] and ids(explore.revealed(df, ["before"], show_all=True)) == [1, 2, 3, 4]
    assert explore.in_period(df.limit(0)).count() == 0
    latest, every = explore.revealed(explore.in_period(df), ["after"]), explore.revealed(df, ["after"], show_all=True)
    assert latest.count() < every.count()


def test_selector_and_timeline(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "b"), ("y", "c"), ("y", None)], "g string, o string")
    assert {r["g"]: r["options"] for r in explore.selector(df, "g", "o").collect()} == {"x": ["a", "b"], "y": ["c"]}
    changes = spark.createDataFrame([("A", 1), ("A", 1), ("B", 2)], "entity string, ord int")
    counts = spark.createDataFrame([("A", 2, 5), ("B", 2, 1)], "entity string, ord int, complaint long")
    got = sorted(map(tuple, explore.entity_timeline(changes, counts).collect()))
    assert got == [("A", 1, 2, 0), ("A", 2, 0, 5), ("B", 2, 1, 1)]
    assert sorted(map(tuple, explore.entity_timeline(changes, counts, "A").collect())) == got[:2]


def test_links(spark):
    assert explore.link("http://h/#patch-notes?entity=CL-40&season=S3") == ("patch-notes", {"entity": "CL-40", "season": "S3"})
    assert explore.link("http://h/") == ("", {}) and explore.link("#a%20b?x=") == ("a b", {"x": ""})
    df = spark.createDataFrame(ROWS, "id int, entity string, ord int, before long, after long")
    assert sorted(r["id"] for r in explore.linked(df, "#p?entity=B&season=2&other=1&x=", {"entity": "entity", "season": "ord"}).collect()) == [3, 4]
    assert explore.linked(df, "#p?entity=", {"entity": "entity"}).count() == 4


def test_backfill_by_a_list(spark):
    rows = [(1, "negative", [], ["T", "U"]), (2, "positive", [], ["T"]), (3, "negative", ["own"], ["T"]), (4, None, [], ["T"]), (5, "negative", [], None)]
    df = spark.createDataFrame(rows, "rec_id int, sentiment string, tags array<string>, topics array<string>")
    mapping = [("negative", "T", "t"), ("negative", "U", "a"), ("negative", "T", "a")]
    assert {r["rec_id"]: r["tags"] for r in tags.backfilled_by(df, mapping).collect()} == {1: ["a", "t"], 2: [], 3: ["own"], 4: [], 5: []}
    assert tags.backfilled_by(df, []).count() == 5
