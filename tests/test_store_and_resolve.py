import pandas as pd

from marquee.operators import resolve, store


def test_pivot_dedup_and_empty(spark):
    meta = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "a", "y"), (3, 1, "b", None), (4, 2, "c", "z")], "meta_id long, post_id long, meta_key string, meta_value string")
    assert [tuple(r) for r in store.pivot_meta(meta, ["a", "b"]).collect()] == [(1, "y", None)]
    latest = store.dedup_meta(meta)
    assert sorted(r["meta_id"] for r in latest.collect()) == [2, 3, 4]
    assert store.dedup_meta(latest.select(meta.columns)).count() == latest.count()
    assert store.dedup_meta(meta.where("false")).count() == 0


def test_orphans_keep_null_safe(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "post_id long")
    parent = spark.createDataFrame([(1,), (None,)], "post_id long")
    assert sorted(str(r[0]) for r in store.orphans(child, parent, "post_id").collect()) == ["2", "None"]


def test_slugs_follow_those_taken(spark):
    new = spark.createDataFrame([(5, "A b"), (6, "a  B!"), (7, "c")], "post_id long, post_title string")
    taken = spark.createDataFrame([("a-b",), ("a-b-3",)], "slug string")
    assert {r[0]: r[1] for r in resolve.assign_slugs(new, taken).collect()} == {5: "a-b-1", 6: "a-b-2", 7: "c"}
    rows = [(1, "Foo"), (2, "foo!"), (3, "Foo 1"), (4, "Foo"), (5, "foo-1")]
    taken = spark.createDataFrame([("foo-2",), ("foo-1-1",)], "slug string")
    got = {r[0]: r[1] for r in resolve.assign_slugs(spark.createDataFrame(rows, "post_id long, post_title string"), taken).collect()}
    assert len(set(got.values())) == 5 and not {"foo-2", "foo-1-1"} & set(got.values())
    assert (got[1], got[2], got[3]) == ("foo", "foo-1", "foo-1-2")


def _events(spark, titles):
    rows = [(i, t, "text", "2026-01-02 20:00:00", "memphis", None, None) for i, t in enumerate(titles, 1)]
    return spark.createDataFrame(rows, "post_id long, post_title string, post_content string, start_utc string, city_slug string, ticket_url string, thumb_id long")


def test_pairs_and_guards(spark):
    titles = ["Blues Traveler", "Blues Traveler w/ Better Than Ezra", "Auburn v. UCF", "Auburn vs. Florida State", "Tedeschi Trucks Band", "Tedeschi Trucks Band (Night 2)", "In The Round with Zach Henard & friends", "In The Round with Kim Richey & friends", "Blues Traveler (Live)"]
    got = {(r["a"], r["b"], r["exact"]) for r in resolve.duplicate_pairs(_events(spark, titles)).collect()}
    assert got == {(1, 2, False), (1, 9, True)}


def test_greedy_merge_skips_stale():
    """A cluster A, B, C: A takes B and C in, and the pair of B and C is stale."""
    posts = pd.DataFrame({"post_id": [1, 2, 3], "class": [1, 2, 3], "fp": ["a", "b", "c"], "worth": [0, 0, 0]})
    links = pd.DataFrame({"x": [1, 1, 2], "y": [2, 3, 3], "ratio": [0.9, 0.9, 0.9], "back": [0.9, 0.9, 0.9]})
    assert resolve._walk(posts, links).to_numpy().tolist() == [[1, 2], [1, 3]]
    posts["worth"] = [1, 0, 1]
    assert resolve._walk(posts, links).to_numpy().tolist() == [[2, 1], [2, 3]]


def test_plan_prefers_status_then_affiliate_then_image(spark):
    rows = [((1, "X", "", "https://e.example/?aaid=1", None), (2, "X CANCELLED", "longer", None, 5)), ((1, "X", "", None, 4), (2, "X", "", "https://eventim.us/2", None)), ((1, "X", "", None, None), (2, "X", "", None, 5))]
    one = "struct<post_id: long, post_title: string, post_content: string, ticket_url: string, thumb_id: long>"
    got = [tuple(r) for r in resolve.plan_merge(spark.createDataFrame(rows, f"a {one}, b {one}")).collect()]
    assert [g[0] for g in got] == [2, 2, 2]
    assert got[0][2] == "https://e.example/?aaid=1" and got[1][3] == 4
