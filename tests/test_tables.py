import datetime as dt
import decimal
import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from trackloom.functions import text as T
from trackloom.operators import catalog as C
from trackloom.operators import social as S
from trackloom.plans import registry
from trackloom.sources import readers, writers
from trackloom.streaming import twins

ROOT = Path(__file__).resolve().parent.parent


def plain(value):
    assert not isinstance(value, decimal.Decimal)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(repr([plain(x) for x in r]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs_and_repeats(spark, sf, name):
    if name in ("tracked_rallies", "param_sweep", "physics_gate"):
        pytest.skip("covered by its operators' tests; slow")
    rows = sorted(map(repr, registry.QUERIES[name](spark, sf).collect()))
    assert rows == sorted(map(repr, registry.QUERIES[name](spark, sf).collect()))


def test_entry_without_the_corpus_folders(tmp_path):
    """The rest of the repository works where those folders are gone."""
    shutil.copytree(ROOT / "trackloom", tmp_path / "trackloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print('rally_segments' in q, any(n.startswith('op') or n == 'pipeline' for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["True", "False"]


def test_flags_insert_or_increment(spark):
    rows = [("u", "v", 1, "first", ["a"]), ("u", "v", 2, "second", []), ("u", "v", 3, "third", ["b", "c"]), ("u", None, 4, "n1", []), ("u", None, 5, "n2", ["x", "y"])]
    flags = spark.createDataFrame(rows, "user_id string, local_video_id string, seq long, reason string, events array<string>")
    got = sorted((r.reason, r.flag_count, r.flag_events) for r in S.record_flags(flags).collect())
    assert got == [("first", 4, ["a", "b", "c"]), ("n1", 1, []), ("n2", 2, ["x", "y"])]
    again = S.record_flags(flags.where("seq = 3"), S.record_flags(flags.where("seq < 3"))).collect()
    assert [(r.reason, r.flag_count, r.flag_events) for r in again] == [("first", 4, ["a", "b", "c"])]


def test_policies(spark):
    h = spark.createDataFrame([(1, "me"), (2, "you")], "id int, author_id string")
    polls = spark.createDataFrame([(10, 1), (20, 2)], "id int, highlight_id int")
    options = spark.createDataFrame([(100, 10), (200, 20)], "id int, poll_id int")
    votes = spark.createDataFrame([(10, "me"), (20, "you")], "poll_id int, user_id string")
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(S.secure(h, "highlights", "delete", "me")) == [1] and ids(S.secure(h, "highlights", "select", "me")) == [1, 2]
    assert ids(S.secure(polls, "polls", "insert", "me", h).select("id")) == [10]
    assert ids(S.secure(options, "poll_options", "insert", "me", h, polls).select("id")) == [100]
    assert ids(S.secure(votes, "poll_votes", "insert", "me")) == [10]  # also in one's own poll
    assert ids(S.secure(h, "moderation_actions", "delete", "me")) == []


def test_pages_come_up_short_after_blocks(spark):
    h = spark.createDataFrame([(k, k % 3, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)) for k in range(60)], "id int, author_id int, created_at timestamp")
    blocks = spark.createDataFrame([(9, 0)], "blocker_id int, blocked_id int")
    shown = S.newest(h, 1)
    assert [r.id for r in shown.collect()] == list(range(39, 19, -1))
    assert S.without_blocked(shown, blocks, 9).count() == 13


def test_writes(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    grown, refused = S.insert_new(table, spark.createDataFrame([("b", 9), ("c", 3), ("c", 4), (None, 5), (None, 6)], "id string, n int"), "id")
    assert sorted(r.id or "" for r in grown.collect()) == ["", "", "a", "b", "c"] and [r.id for r in refused.collect()] == ["b"]
    up = {r.id: r.n for r in S.upsert(table, spark.createDataFrame([("b", None), ("d", 4)], "id string, n int"), "id", ["n"]).collect()}
    twice = spark.createDataFrame([("d", 4), ("d", 9), ("d", None), ("d", 7)], "id string, n int").repartition(3)
    assert [(r.id, r.n) for r in S.upsert(table, twice, "id", ["n"]).where("id = 'd'").collect()] == [("d", 9)]
    assert up == {"a": 1, "b": None, "d": 4}
    good, bad = S.violations(spark.createDataFrame([("a", "b"), ("a", "a"), ("a", None)], "follower_id string, following_id string"), S.checks_of("follows"))
    assert good.count() == 2 and bad.first().broken == ["no_self_follow"]
    made = S.new_profiles(spark.createDataFrame([("x", "X", "x")], "id string, display_name string, username string"), spark.createDataFrame([("x", "no"), ("abcdefghij", None)], "id string, full_name string"))
    assert sorted((r.display_name, r.username) for r in made.collect()) == [("Volleyball Player", "user_abcdefgh"), ("X", "x")]


def test_folders_with_names_alike(spark):
    folders = spark.createDataFrame([("Sports", "Sports", None), ("Sports/A", "A", "Sports"), ("Sports2", "Sports2", None)], "path string, name string, parent_path string")
    videos = spark.createDataFrame([(1, "Sports"), (2, "Sports/A"), (3, "Sports2"), (4, "")], "id int, folder_path string")
    f, v = C.delete_folder(folders, videos, "Sports")
    assert [r.path for r in f.collect()] == ["Sports2"] and sorted(r.id for r in v.collect()) == [3, 4]
    f, v = C.rename_folder(folders, videos, "Sports", "Games")
    assert sorted((r.path, r.parent_path or "") for r in f.collect()) == [("Games", ""), ("Games/A", "Games"), ("Sports2", "")]
    f, v = C.move_folder(folders, videos, "Sports/A", "Sports2")
    assert {r.id: r.folder_path for r in v.collect()}[2] == "Sports2/A"
    with pytest.raises(ValueError):
        C.move_folder(folders, videos, "Sports", "Sports/A")
    moved, failed = C.move_videos(videos, folders, spark.createDataFrame([(1, "Sports2"), (9, ""), (2, "nowhere")], "id int, target string"))
    assert {r.id: r.folder_path for r in moved.collect()}[1] == "Sports2"
    assert sorted((r.id, r.reason) for r in failed.collect()) == [(2, "no such folder"), (9, "no such video")]


def test_deleting_videos_and_copies(spark):
    videos = spark.createDataFrame([("o", ["c1", "c2"]), ("c1", []), ("c2", []), ("p", ["q"]), ("q", [])], "id string, processed_video_ids array<string>")
    left = {r.id: r.processed_video_ids for r in C.delete_videos(videos, spark.createDataFrame([("o",), ("q",)], "id string")).collect()}
    assert left == {"p": []}
    left = {r.id: r.processed_video_ids for r in C.delete_videos(videos, spark.createDataFrame([("c1",)], "id string")).collect()}
    assert left == {"o": ["c2"], "c2": [], "p": ["q"], "q": []}


def test_review_undo_does_not_restore(spark):
    log = [("v", 1, "save", 3), ("v", 2, "favorite", 3), ("v", 3, "remove", 3), ("v", 4, "undo_remove", 3), ("v", 5, "save", 1)]
    r = C.review_state(spark.createDataFrame(log, "video_id string, seq int, action string, idx int")).first()
    assert (r.saved, r.removed, r.favorited) == ([1], [], [])


def test_text_functions(spark):
    row = spark.range(1).select(
        T.hashtags(F.lit("a #Spike #spike #é_1 # x")).alias("tags"),
        T.depth(F.lit("")).alias("root"),
        T.depth_penalty(F.lit("")).alias("penalty"),
        T.video_relevance(F.lit("Final"), F.lit("final.mov"), F.lit(""), "final").alias("score"),
        T.sanitized_folder_name(F.lit("a/b:c")).alias("clean"),
        T.compact_count(F.lit(1234567)).alias("many"),
        T.even_times(F.lit(2.0), F.lit(4.0), 3).alias("times"),
        T.even_times(F.lit(2.0), F.lit(4.0), 1).alias("middle"),
        T.even_times(F.lit(4.0), F.lit(2.0), 3).alias("empty"),
    ).first()
    assert row.tags == ["spike", "spike", "é_1"] and (row.root, row.penalty, row.score) == (0, 2, 128.0)
    assert (row.clean, row.many, row.times, row.middle, row["empty"]) == ("a_b_c", "1.2M", [2.0, 3.0, 4.0], [3.0], [4.0])
    assert T.search_term('a,b(c){}"\\d') == "abcd"


def test_documents(spark, tmp_path):
    good = {"id": "1", "videoId": "V1", "rallySegments": [{"id": "s", "startTime": 1.0, "endTime": 3.5, "confidence": 0.5}], "retired": 7}
    for name, text in (("v1_metadata.json", json.dumps(good)), ("v2_metadata.json", "{broken"), ("v3_metadata.json", json.dumps({"videoId": "other"})), ("v1_metadata.json.backup", "{}")):
        (tmp_path / name).write_text(text)
    docs, bad = readers.documents(spark, str(tmp_path))
    assert [(r.videoId, r.processingVersion) for r in docs.collect()] == [("V1", "1.0")]
    assert sorted((r.file_stem, r.reason) for r in bad.collect()) == [("v2", "corrupt"), ("v3", "wrong video")]
    assert [(r.video_id, r.seg_idx, r.duration) for r in readers.segments(docs).collect()] == [("V1", 0, 2.5)]
    assert readers.document_metrics(docs).first().mean_duration == 2.5
    assert sorted(r.video_id for r in readers.document_ids(spark, str(tmp_path)).collect()) == ["v1", "v2", "v3"]
    out = str(tmp_path / "out")
    for version in ("1", "2"):
        writers.documents(docs.withColumn("processingVersion", F.lit(version)), out)
    assert [r.processingVersion for r in spark.read.json(out).collect()] == ["2"]


def test_manifest_and_sidecars(spark, tmp_path):
    manifest = {"version": "2", "folders": {"A": {"name": "A", "path": "A", "createdDate": 0.0}}, "videos": {"f.mov": {"id": "ABC", "folderPath": "A", "createdDate": 86400.0, "fileSize": 5, "processedVideoIds": ["DEF"]}}}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text(json.dumps(manifest))
    (tmp_path / "m" / "b.json").write_text("nonsense")
    v, f, bad = readers.manifest(spark, str(tmp_path / "m"))
    r = v.first()
    assert (r.id, r.created_date, r.is_processed, r.processed_video_ids) == ("abc", dt.datetime(2001, 1, 2), False, ["def"]) and f.count() == bad.count() == 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text(json.dumps({"videoId": "v", "trims": {"2": {"before": 1.0}}}))
    t = readers.trims(spark, str(tmp_path / "t")).first()
    assert (t.seg_idx, t.before, t.after, t.zoom, t.rotation) == (2, 1.0, 0.0, 1.0, 0.0)


def test_test_results(spark):
    tree = [("root", None, json.dumps([{"name": "suite", "children": json.dumps([{"name": "a", "status": "Passed"}, {"name": "b", "status": "Failed"}])}, {"name": "c", "status": "Skipped"}]))]
    flat = readers.flatten_results(spark.createDataFrame(tree, "name string, status string, children string"))
    assert sorted((r.name, r.status) for r in flat.collect()) == [("root/c", "Skipped"), ("root/suite/a", "Passed"), ("root/suite/b", "Failed")]
    items = spark.createDataFrame([(1, "root/suite/a", "pass"), (2, "root/suite/b", "pass"), (3, "root/suite/b", None)], "item_id int, automation_id string, status string")
    changed, left = writers.status_changes(flat, items)
    assert sorted((r.item_id, r.after) for r in changed.collect()) == [(2, "fail"), (3, "fail")] and [r.name for r in left.collect()] == ["root/c"]


def test_stream_of_decisions_equals_the_batch(spark, tmp_path):
    from trackloom.operators import stateful

    rows = [(v, k / 10, k % 40 < 25, k % 40 < 20, None) for v in ("a", "b") for k in range(200)]
    schema = "video_id string, t double, has_ball boolean, is_projectile boolean, ball_y double"
    source = tmp_path / "in"
    for part in range(4):
        spark.createDataFrame([r for r in rows if part * 5 <= r[1] < part * 5 + 5], schema).coalesce(1).write.mode("append").parquet(str(source))
        os.utime(sorted(source.glob("*.parquet"), key=os.path.getmtime)[-1], (1_700_000_000 + part, 1_700_000_000 + part))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    run = twins.decide(stream).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    want = stateful.decide(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, spark.table("decided").collect())) == sorted(map(tuple, want.collect()))


def test_counters_from_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 1), ("b", -1), ("a", -1)], "id string, delta int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, delta int").parquet(str(tmp_path / "in"))
    twins.into_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "id", "likes").awaitTermination()
    assert {r.id: r.likes for r in twins.counter_table(spark, str(tmp_path / "out"), "id", "likes").collect()} == {"a": 1, "b": 0}


def test_passive_capture(spark):
    from trackloom.operators.capture import capture

    segments = spark.createDataFrame([(v, k, 10.0 * k, 10.0 * k + 4, c) for v in ("a", "b", "c") for k, c in enumerate((0.4, 0.9, 0.1, 0.3))], "video_id string, seg_idx int, start double, end double, confidence double")
    evidence = spark.createDataFrame([(v, t) for v in ("a", "b") for t in (1.0, 4.2, 4.3, 24.25, 33.0)], "video_id string, t double")
    staged = spark.createDataFrame([(f"s{k}",) for k in range(48)] + [("a",)], "local_video_id string")
    rows, kept = capture(segments, evidence, staged, "me")
    assert sorted((r.local_video_id, r.events) for r in rows.collect()) == sorted((v, [e]) for v in ("a", "b") for e in ('{"seg_idx":2,"confidence":0.1}', '{"seg_idx":3,"confidence":0.3}'))
    assert sorted((r.video_id, r.t) for r in kept.collect()) == [(v, t) for v in ("a", "b") for t in (24.25, 33.0)]


def test_staged_videos_are_the_first_by_id(spark):
    from trackloom.plans import motion

    ids = [f"{k}" for k in range(100, 300)]
    f = spark.createDataFrame([(x,) for x in reversed(ids)], "video_id string").repartition(7)
    assert [r.local_video_id for r in motion._staged(f).collect()] == ids[:20]


def test_path_conversions(spark):
    row = spark.range(1).select(*[C.relative_path(F.lit(p), "lib") for p in ("lib", "lib/a/b", "library/a")], C.full_path(F.lit(""), "lib"), C.full_path(F.lit("a"), "lib")).first()
    assert tuple(row) == ("", "a/b", None, "lib", "lib/a")


def test_single_row_or_error(spark):
    rows = spark.range(3)
    assert S.single(rows.where("id = 1")).first().id == 1
    for wrong in (rows, rows.where("id = 9")):
        with pytest.raises(ValueError):
            S.single(wrong)


def test_draws_do_not_follow_partitions(spark):
    from trackloom.operators import evaluate as E
    from trackloom.operators import metrics as M
    from trackloom.operators.config import Config

    anchor = {k: float(getattr(Config(), k)) for k in E.BOUNDS}
    drawn = sorted(map(tuple, E.draw_parameters(spark, anchor, 40, seed=3).collect()))
    assert drawn == sorted(map(tuple, E.draw_parameters(spark, anchor, 40, seed=3).repartition(7).collect()))
    rows = spark.range(2000)
    some = sorted(r.id for r in M.sample(rows, 0.25, 5).collect())
    assert some == sorted(r.id for r in M.sample(rows.repartition(7), 0.25, 5).collect()) and 400 < len(some) < 600


def test_deep_test_results_and_odd_prefixes(spark):
    node = {"name": "leaf", "status": "Passed"}
    for k in range(12):
        node = {"name": f"n{k}", "children": json.dumps([node])}
    tree = spark.createDataFrame([(node["name"], None, node["children"])], "name string, status string, children string")
    assert readers.flatten_results(tree).first().name == "/".join([f"n{k}" for k in range(11, -1, -1)] + ["leaf"])
    named = spark.createDataFrame([("A+ (7",), ("A+ (9",), ("AA (50",)], "name string")
    assert named.agg(T.next_number(F.col("name"), "A+ (").alias("n")).first().n == 10
