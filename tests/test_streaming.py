import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from marquee.functions import text as T
from marquee.streaming import ingest


def _rows(seed):
    draw = random.Random(seed)
    links = [None, "https://t.example.com/?aaid=1", "https://v.example.com/x", "https://eventim.us/2"]
    return [
        {"seq": i, "title": draw.choice(["A Show", "B Show", "C *cancelled*", " "]), "start_utc": f"2026-01-02 {draw.randint(10, 22)}:00:00", "city_slug": "m", "ticket_url": draw.choice(links), "source_name": draw.choice(["Ticketmaster", "venue"]), "description": draw.choice(["", f"d{i}"]), "category": f"c{i}"}
        for i in range(60)
    ]


def _ingest(spark, folder, parts, compact):
    rows, paths = _rows(5), [str(folder / d) for d in ("in", "store", "check")]
    size = -(-len(rows) // parts)
    for k in range(parts):
        (folder / "in").mkdir(parents=True, exist_ok=True)
        (folder / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k * size : (k + 1) * size]))
        ingest.ingest_stream(spark, *paths).awaitTermination()
        if compact and k % 2 == 0:
            assert ingest.compact(spark, paths[1]) == ingest.compact(spark, paths[1])
    return sorted(map(tuple, ingest.read_posts(spark, paths[1]).collect()))


def test_posts_do_not_depend_on_batches_or_snapshots(spark, tmp_path):
    one = _ingest(spark, tmp_path / "one", 1, False)
    assert len(one) == 2 and len({r[0] for r in one}) == 2
    assert _ingest(spark, tmp_path / "many", 4, False) == one
    assert _ingest(spark, tmp_path / "compacted", 4, True) == one


def _listings(seed, n=140):
    """Shows of two days with misspelt and cancelled listings among them, some of which come back later."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        title = draw.choice(["Blues Traveler", "Silver Band Live", "Open Mic Night", "Jazz Trio"])
        if draw.random() < 0.3:
            k = draw.randrange(len(title))
            title = title[:k] + draw.choice("xyz") + title[k + 1 :]
        if draw.random() < 0.25:
            title = draw.choice([title + " **Cancelled**", "Cancelled: " + title])
        day, hour = draw.randint(1, 2), draw.randint(10, 22)
        rows.append({"seq": i, "title": title, "start_utc": f"2026-01-0{day} {hour}:00:00", "city_slug": draw.choice(["m", " M", "n"]), "ticket_url": None, "source_name": "venue", "description": draw.choice(["", f"d{i}"]), "category": f"c{i}"})
    return rows


def _plain_store(rows, keyed):
    """The store row by row: a listing updates its post or makes one, a cancellation deletes."""
    posts, fuzzy = {}, 0
    for r in rows:
        k = keyed.get(r["seq"])
        if k is None:  # says cancelled in a form that does nothing
            continue
        if k["cancels"]:
            near = []
            if k["fp"] in posts:
                del posts[k["fp"]]
                continue
            for fp, p in posts.items():
                if (p["day"], p["city"]) == (k["day"], k["city"]):
                    ratio = difflib.SequenceMatcher(None, k["norm"], p["norm"]).ratio()
                    s, l = sorted((k["norm"], p["norm"]), key=len)
                    if len(s) >= T.LEAST_PREFIX and l.startswith(s) and (len(l) == len(s) or l[len(s)] in " |(-:"):
                        ratio = max(ratio, T.THRESHOLD)
                    if ratio >= T.THRESHOLD:
                        near.append((-ratio, fp))
            if near:
                del posts[min(near)[1]]
                fuzzy += 1
            continue
        p = posts.setdefault(k["fp"], {**k, "title": r["title"], "start": r["start_utc"], "text": "", "n": 0})
        p["start"], p["text"], p["n"], p["category"] = min(p["start"], r["start_utc"]), p["text"] or r["description"], p["n"] + 1, r["category"]
    return sorted((fp, p["title"], p["start"], p["text"] or None, p["category"], p["n"]) for fp, p in posts.items()), fuzzy


@pytest.mark.parametrize("seed", [1, 2])
def test_cancellations_equal_a_row_by_row_store_in_any_batches(spark, tmp_path, seed):
    rows = _listings(seed)
    df = ingest.normalized(spark.createDataFrame([tuple(r.get(c.split(" ")[0]) for c in ingest.SCHEMA.split(", ")) for r in rows], ingest.SCHEMA))
    keyed = {r["seq"]: r.asDict() for r in df.select("seq", "fp", "cancels", T.normalize_title(F.col("title")).alias("norm"), F.substring("start_utc", 1, 10).alias("day"), F.lower(F.trim("city_slug")).alias("city")).collect()}
    want, fuzzy = _plain_store(rows, keyed)
    assert fuzzy and sum(k["cancels"] for k in keyed.values()) > 12
    for parts, every in ((1, 0), (5, 1), (5, 2)):
        folder = tmp_path / f"{parts}-{every}"
        (folder / "in").mkdir(parents=True)
        paths = [str(folder / d) for d in ("in", "store", "check")]
        size = -(-len(rows) // parts)
        for k in range(parts):
            (folder / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k * size : (k + 1) * size]))
            ingest.ingest_stream(spark, *paths).awaitTermination()
            if every and k % every == 0:
                ingest.compact(spark, paths[1])
        got = ingest.read_posts(spark, paths[1]).select("fp", "title", "start_utc", "description", "category", "n_observed").collect()
        assert sorted(tuple(r) for r in got) == want


def test_a_snapshot_rewrites_touched_buckets_alone(spark, tmp_path):
    paths = [str(tmp_path / d) for d in ("in", "store", "check")]
    (tmp_path / "in").mkdir()
    row = lambda i, title: json.dumps({"seq": i, "title": title, "start_utc": "2026-01-02 20:00:00", "city_slug": "m"})

    def land(name, titles):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(row(i, t) for i, t in enumerate(titles)))
        ingest.ingest_stream(spark, *paths).awaitTermination()
        return ingest.compact(spark, paths[1])

    buckets = lambda version: {p.name for p in (tmp_path / "store" / "posts" / f"upto={version}").glob("bucket=*")}
    first = land("a", [f"Show {i} of {i * 7919}" for i in range(300)])
    assert len(buckets(first)) > 100
    stat = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "posts" / f"upto={first}").rglob("*.parquet")}
    second = land("b", ["Show 5 of 39595", "A new one"])
    assert 1 <= len(buckets(second)) <= 2 and stat == {p: p.stat().st_mtime_ns for p in stat}
    assert ingest.read_posts(spark, paths[1]).count() == 301
    # A bucket whose only posts are cancelled is no longer named.
    third = land("c", ["A new one **Cancelled**"])
    assert ingest.read_posts(spark, paths[1]).count() == 300 and ingest.compact(spark, paths[1]) == third
    # A snapshot without a manifest doesn't count.
    (tmp_path / "store" / "posts" / "upto=99" / "bucket=0").mkdir(parents=True)
    assert ingest.read_posts(spark, paths[1]).count() == 300
    assert ingest.vacuum(spark, paths[1], keep=1) >= 1
    assert ingest.read_posts(spark, paths[1]).count() == 300


def test_an_empty_store_has_no_posts(spark, tmp_path):
    assert ingest.read_posts(spark, str(tmp_path / "none")).count() == 0


def test_a_fold_reads_what_was_observed_once(spark):
    rows = spark.range(40).selectExpr(
        "id AS seq", "'Night Market' AS title", "'' AS description", "'2026-07-04 20:00:00' AS start_utc", "'tampa' AS city_slug", "'' AS image_url", "'https://v.example.com/' || id AS ticket_url",
        "'venue' AS source_name", "'c' AS category", "'f' || id % 8 AS fp", "false AS cancels", "0L AS batch", "1L AS n_before",
    )
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            read.add(part.num_rows)
            yield part

    none = spark.createDataFrame([], "fp string, last long")
    assert sum(r["n_observed"] for r in ingest.posts_of(rows.mapInArrow(counted, rows.schema), none).collect()) == 40
    assert read.value == 40
