from pyspark.sql import functions as F

from synthloom.operators import generate, sync
from synthloom.plans import datasets
from synthloom.queries import symbols


def test_rows_that_differ_are_made_anew(spark, sf):
    s = symbols(spark, sf)
    ids = [(r.id, r.body_sha) for r in sync.current_rows(s, "explanation").orderBy("id").limit(4).collect()]
    columns = "id string, body_sha string, generated_at string, response string"
    ours = [(ids[0][0], "old", "2020", "a"), (ids[1][0], "same", "2020", "b"), (ids[2][0], "mine", "2020", "c"), ("gone", "x", "2020", "d")]
    theirs = [(ids[0][0], "other", "2021", "e"), (ids[1][0], "same", "2021", "f"), (ids[3][0], "theirs", "2021", "g"), ("gone", "y", "2021", "h")]
    frames = (spark.createDataFrame(rows, columns) for rows in (ours, theirs))
    got = {r.id: r for r in datasets.merge_regenerated(*frames, s, generate.maker("offline")).collect()}
    assert {k: (r.merged, r.response) for k, r in got.items() if k != ids[0][0]} == {
        ids[1][0]: ("same", "b"),
        ids[2][0]: ("ours", "c"),
        ids[3][0]: ("theirs", "g"),
        "gone": ("conflict", "d"),
    }
    remade = got[ids[0][0]]
    assert (remade.merged, remade.body_sha) == ("regenerated", ids[0][1]) and remade.generated_at > "2021" and remade.response.startswith("reply:")
    empty = spark.createDataFrame([], columns)
    assert datasets.merge_regenerated(empty, empty, s, generate.maker("offline")).filter(F.col("id").isNotNull()).count() == 0
