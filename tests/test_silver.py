"""Silver tables behind a manifest: batches, replays, other checkpoints, compaction, late readers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from agoralens.operators.scoring import Lexicon, score_posts
from agoralens.schema import POSTS
from agoralens.sources import files
from agoralens.sources.lake import stream_table
from agoralens.streaming import scored as st, silver
from test_stream import run, same, scorer, write_posts

SCORED_ROWS = "post_id long, subreddit string, thread string, user_posting string, author long, post_date timestamp_ntz, enqueued_utc timestamp_ntz, token_count int, prediction int, prediction_prob double"


def rows(spark, first, n):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, "s", "t", "x", 1, day, day + dt.timedelta(minutes=k), 12, k % 2, 0.5) for k in range(first, first + n)], SCORED_ROWS)


def ids(spark, root):
    return sorted(r.post_id for r in st.read_silver(spark, root, st.SCORED).select("post_id").collect())


def test_second_checkpoint_adds_to_the_root(spark, tmp_path):
    write_posts(spark, str(tmp_path / "posts"), 0, 120)
    run(spark, tmp_path, scorer(spark)[0])
    before = ids(spark, str(tmp_path / "silver"))
    write_posts(spark, str(tmp_path / "more"), 500, 60)
    posts = stream_table(spark, str(tmp_path / "more"), POSTS)
    st.run(st.score_stream(posts, scorer(spark)[0], str(tmp_path / "silver"), str(tmp_path / "other"), window=100))
    after = ids(spark, str(tmp_path / "silver"))
    assert set(before) < set(after) and len(after) == len(set(after))
    assert sum(r.posts for r in st.read_windows(spark, str(tmp_path / "silver")).collect()) == len(after)
    assert len({e.query for e in silver.latest(spark, str(tmp_path / "silver")).entries}) == 2


def test_many_batches_are_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(silver, "FAN", 3)
    monkeypatch.setattr(silver, "KEEP", 2)
    root = str(tmp_path)
    for k in range(12):
        assert st.write_silver(rows(spark, 10 * k, 10), root, k, window=25, query="q")
        assert len(silver.latest(spark, root).entries) <= 2 * 4
    assert ids(spark, root) == list(range(120))
    windows = {r.window_no: r.posts for r in st.read_windows(spark, root).collect()}
    assert windows == {0: 25, 1: 25, 2: 25, 3: 25, 4: 20}
    monthly = st.read_monthly(spark, root).collect()
    assert [(r.post_count, r.prediction_1, r.avg_token_count) for r in monthly] == [(120, 60, 12.0)]
    # Closed batches are still known: a replay of one does nothing.
    assert not st.write_silver(rows(spark, 0, 10), root, 0, window=25, query="q")
    assert ids(spark, root) == list(range(120))
    # What was replaced is gone from disk after a few versions, and so are old manifests.
    assert len(files.names(spark, f"{root}/{st.SCORED}")) <= 2 * 4 + 3 * 3
    assert len([n for n in files.names(spark, f"{root}/_manifest") if n.endswith(".json")]) <= 3


def test_many_batches_in_the_log(spark, tmp_path, monkeypatch):
    """The log alone: a read lists folders by the logarithm of the batches."""
    monkeypatch.setattr(silver, "FAN", 4)
    root, made = str(tmp_path), []

    def write(folder, start):
        (tmp_path / "t" / folder).mkdir(parents=True)
        made.append(start)
        return 5

    for k in range(150):
        silver.append(spark, root, "q", k, ["t"], write)
        seen = silver.latest(spark, root)
        while due := silver.due(seen.entries):
            merged = silver.Entry("q", due[0].first, due[-1].last, due[0].tier + 1, f"m{k}-{due[0].tier}", due[0].start, sum(e.rows for e in due))
            assert silver._switch(spark, root, ["t"], seen, [*(e for e in seen.entries if e not in due), merged], [e.folder for e in due])
            seen = silver.latest(spark, root)
    entries = sorted(seen.entries, key=lambda e: e.first)
    assert len(entries) <= 3 * 4 and seen.end == 750 and made == list(range(0, 750, 5))
    assert [e.first for e in entries][1:] == [e.last + 1 for e in entries][:-1] and entries[-1].last == 149


def test_reader_sees_whole_batches(spark, tmp_path):
    root = str(tmp_path)
    st.write_silver(rows(spark, 0, 10), root, 0, query="q")
    seen = []

    def write(folder, start):
        rows(spark, 50, 5).withColumn("batch_id", F.lit(1)).write.parquet(f"{root}/{st.SCORED}/{folder}")
        seen.append(ids(spark, root))
        raise RuntimeError("the driver dies here")

    with pytest.raises(RuntimeError):
        silver.append(spark, root, "q", 1, [st.SCORED], write)
    assert seen == [list(range(10))] == [ids(spark, root)]
    assert st.write_silver(rows(spark, 50, 5), root, 1, query="q")
    assert ids(spark, root) == [*range(10), *range(50, 55)]


def test_reader_of_an_older_version_still_finds_its_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(silver, "FAN", 4)
    root = str(tmp_path)
    for k in range(3):
        st.write_silver(rows(spark, 10 * k, 10), root, k, query="q")
    reader = st.read_silver(spark, root, st.SCORED)
    st.write_silver(rows(spark, 30, 10), root, 3, query="q")  # merges the four
    assert len(silver.latest(spark, root).entries) == 1
    assert reader.count() == 30 and len(ids(spark, root)) == 40


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    """A second writer shows its batch while the first still writes: the first numbers its rows again."""
    root, starts = str(tmp_path), []

    def second(folder, start):
        rows(spark, 100, 7).write.parquet(f"{root}/t/{folder}")
        return 7

    def first(folder, start):
        starts.append(start)
        if len(starts) == 1:
            silver.append(spark, root, "b", 0, ["t"], second)
        rows(spark, 0, 3).write.parquet(f"{root}/t/{folder}")
        return 3

    assert silver.append(spark, root, "a", 0, ["t"], first)
    assert starts == [0, 7]
    assert silver.read(spark, root, "t").count() == 10 and len(files.names(spark, f"{root}/t")) == 2


def test_delta_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        st.write_silver(rows(spark, 0, 1), str(tmp_path), 0, fmt="delta")
    with pytest.raises(FileNotFoundError):
        st.read_silver(spark, str(tmp_path), st.SCORED)


def test_replay_calls_no_scorer(spark, tmp_path):
    model, calls = scorer(spark)
    write_posts(spark, str(tmp_path / "posts"), 0, 60)
    from agoralens.operators.projections import with_clean_text

    posts = with_clean_text(spark.read.parquet(str(tmp_path / "posts")))
    for _ in range(2):
        st.write_silver(score_posts(posts, model), str(tmp_path / "silver"), 0, query="q")
    assert calls.value == posts.filter("token_count > 10").count()


# --- redeliveries in the stream -----------------------------------------------------


def test_redeliveries_are_dropped_after_a_restart(spark, tmp_path):
    root, path = str(tmp_path), str(tmp_path / "posts")

    def deliver(first, n, days):
        write_posts(spark, f"{root}/one", first, n)
        moved = spark.read.schema(POSTS).parquet(f"{root}/one").withColumn("enqueued_utc", F.expr(f"enqueued_utc + interval {days} days"))
        moved.write.mode("append").parquet(path)
        posts = stream_table(spark, path, POSTS)
        st.run(st.score_stream(posts, Lexicon({"word": 1.0}), f"{root}/silver", f"{root}/checkpoint", n=0, window=None, dedup="3 days"))

    deliver(0, 50, 0)
    deliver(0, 50, 1)  # the same posts a day later, by a restarted stream
    deliver(50, 20, 1)
    assert ids(spark, f"{root}/silver") == list(range(70))
    deliver(300, 1, 9)  # the watermark passes them, and the state lets go
    deliver(0, 70, 9)
    assert len(ids(spark, f"{root}/silver")) == 141
    deliver(200, 5, 1)  # late by more than the delay
    assert len(ids(spark, f"{root}/silver")) == 141


def test_state_is_bounded_by_the_watermark(spark, tmp_path):
    path, sizes = str(tmp_path / "posts"), []
    for k in range(5):
        write_posts(spark, str(tmp_path / "one"), 1000 * k, 40)
        spark.read.schema(POSTS).parquet(str(tmp_path / "one")).withColumn("enqueued_utc", F.expr(f"enqueued_utc + interval {10 * k} days")).write.mode("append").parquet(path)
        query = st.drop_redeliveries(stream_table(spark, path, POSTS), "1 day").writeStream.format("parquet")
        query = query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        st.run(query)
        sizes += [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]][-1:]
    assert max(sizes) <= 2 * 40
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
