"""Stored indexes and embeddings, jobs, and tasks that expire: round trips, stale and broken parts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import suite as SU
from kindred.sources import loaders
from kindred.stores import embeddings as EM
from kindred.stores import files
from kindred.stores import indexes as IX
from kindred.stores.levels import Level, TwoLevels, pair_name
from kindred.streaming import progress as P

ROWS = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.6, 0.8])]


def index(spark, rows=ROWS):
    return spark.createDataFrame(rows, "term string, vector array<double>")


def same(frame, rows=ROWS):
    return sorted((r["term"], r["vector"]) for r in frame.collect()) == sorted(rows)


def test_an_index_comes_back_by_its_key(spark, tmp_path):
    folder, own = str(tmp_path), index(spark)
    key = IX.index_key("hj rg", "ru", own)
    assert key.startswith("hj-rg_ru_") and IX.load_index(spark, folder, key) is None
    assert [IX.save_index(own, folder, key, "hj rg", "ru", "m"), IX.save_index(index(spark, ROWS[:2]), folder, key, model="m")] == [1, 2]
    assert same(IX.load_index(spark, folder, key, "m"), ROWS[:2]) and IX.load_index(spark, folder, key, "other") is None
    assert IX.forget_index(spark, folder, key, keep=1) == 1 and files.versions(spark, f"{folder}/{key}") == [2]
    assert IX.forget_index(spark, folder, key) == 1 and IX.load_index(spark, folder, key) is None


def test_other_terms_make_another_key(spark):
    own = index(spark)
    assert IX.index_key("d", "ru", own) == IX.index_key("d", "ru", own.orderBy(F.desc("term")).union(own))
    assert len({IX.index_key("d", "ru", own), IX.index_key("d", "en", own), IX.index_key("e", "ru", own), IX.index_key("d", "ru", own.filter("term <> 'a'"))}) == 4


def test_broken_versions_are_passed_over(spark, tmp_path):
    folder, own = str(tmp_path), index(spark)
    IX.save_index(own, folder, "k")
    IX.save_index(own, folder, "k")
    IX.save_index(own, folder, "k")
    files.remove(spark, f"{folder}/k/v3/record")  # cut off before it was whole
    index(spark, ROWS[:1]).write.mode("append").parquet(f"{folder}/k/v2/rows")  # rows that its record does not count
    assert same(IX.load_index(spark, folder, "k"))
    files.remove(spark, f"{folder}/k/v1/rows")
    assert IX.load_index(spark, folder, "k") is None
    assert sorted((r["key"], r["version"], r["terms_count"]) for r in IX.registry(spark, folder).collect()) == [("k", 1, 3), ("k", 2, 3)]


def test_an_index_that_is_none_is_not_stored(spark, tmp_path):
    for rows in ([], [("a", [1.0]), ("b", [1.0, 2.0])]):
        with pytest.raises(ValueError):
            IX.save_index(index(spark, rows), str(tmp_path), "k")
    assert IX.load_index(spark, str(tmp_path), "k") is None and IX.registry(spark, str(tmp_path)).collect() == []


def test_an_index_is_built_once(spark, tmp_path):
    built = []

    def build(vectors):
        built.append(1)
        return vectors

    for _ in range(2):
        assert same(IX.index_for(index(spark), str(tmp_path), "d", "ru", build))
    assert same(IX.index_for(index(spark, ROWS[:2]), str(tmp_path), "d", "ru", build), ROWS[:2])
    assert len(built) == 2


def encoders(**broken):
    found = EM.Encoders("one", "spare")
    for name, factor in (("one", 1.0), ("two", 2.0), ("spare", 3.0)):
        if name not in broken:
            found.register(name, lambda factor=factor: lambda texts: [[factor * len(t)] for t in texts])
    return found


def test_only_unseen_texts_are_encoded(spark, tmp_path):
    folder, own = str(tmp_path), encoders()
    texts = spark.createDataFrame([("aa",), ("b",), ("aa",), (None,), ("",)], "term string")
    first, n = EM.embedded(texts, own, folder)
    assert n == 3 and sorted(map(tuple, first.collect()), key=repr) == [("", [0.0]), ("aa", [2.0]), ("aa", [2.0]), ("b", [1.0]), (None, None)]
    more, n = EM.embedded(texts.union(spark.createDataFrame([("ccc",)], "term string")), own, folder)
    assert n == 1 and more.count() == 6
    assert own.switch("two") and EM.embedded(texts, own, folder)[1] == 3 and EM.embedded(texts, own, folder)[1] == 0
    assert own.restore() and EM.embedded(texts, own, folder)[1] == 0
    EM.clear(spark, folder, "one")
    assert EM.embedded(texts, own, folder)[1] == 3
    assert EM.embedded(texts.limit(0), own, folder)[0].collect() == []


def test_fallback_and_switch():
    own = encoders(one=False)
    assert own.ready() == "spare" and own.current == "spare"
    assert not own.switch("none") and own.current == "spare" and own.switch("two") and own.ready() == "two"
    with pytest.raises(RuntimeError):
        encoders(one=False, spare=False).ready()


def test_jobs_end_in_a_state_and_store_what_they_found(spark, tmp_path):
    path = str(tmp_path)
    vectors = spark.createDataFrame([(c, "d", [float(i), 1.0]) for i, c in enumerate("abcdef")], "term string, domain string, embedding array<float>")
    pairs = spark.createDataFrame([(a, b, float(i)) for i, (a, b) in enumerate(zip("abcde", "bcdef", strict=True))], "word1 string, word2 string, human_score double")
    good = SU.run_job(path, "simlex999", lambda: pairs, vectors, seeded=False)
    bad = SU.run_job(path, "hj-rg", lambda: loaders.with_human_score(pairs.drop("human_score")), vectors)
    states = {r["task_id"]: r for r in SU.job_states(spark, path).collect()}
    assert (states[good]["progress"], states[good]["status"], states[good]["error"]) == (100, "Completed", None)
    assert (states[bad]["progress"], states[bad]["status"]) == (0, "Failed") and "score" in states[bad]["error"]
    steps = [r["progress"] for r in spark.read.parquet(f"{path}/jobs").filter(F.col("task_id") == good).orderBy("step").collect()]
    assert steps == [0, 20, 90, 100]
    stored = SU.stored_runs(spark, path).collect()
    assert {r["task_id"] for r in stored} == {good} and {r["method"] for r in stored} == {"sbert", "wordnet_lin_en", "wordnet_wup_en"}
    assert all(r["execution_time_sec"] > 0 for r in stored)


def test_unknown_methods_and_data_sets(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0)], "word1 string, word2 string, human_score double")
    vectors = spark.createDataFrame([("a", "d", [1.0])], "term string, domain string, embedding array<float>")
    with pytest.raises(ValueError, match="unknown methods: magic"):
        SU.predictions_of(("sbert", "magic"), pairs, vectors)
    assert [r["method"] for r in SU.run_suite("none of them", pairs, vectors).collect()] == ["sbert"]


EVENTS = "event_id long, ts timestamp, task_id long, status string, progress double"


def test_stream_and_batch_agree_on_which_tasks_are_listed(spark, tmp_path):
    rng, start = random.Random(1), dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i * 0.7 + rng.random()), rng.randrange(25), rng.choice(["running", "running", "completed", "failed"]), rng.random()) for i in range(300)]
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    before, seen = spark.conf.get("spark.sql.streaming.stateStore.providerClass"), {}
    query = P.listed(P.read_events(spark, f"{tmp_path}/events", EVENTS)).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state")
    query.foreachBatch(lambda batch, n: [seen.setdefault(r["task_id"], []).append(r) for r in batch.collect()] and None).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    stream = {k: tuple(rs[-1][c] for c in ("ts", "status", "progress")) for k, rs in seen.items() if rs[-1]["live"]}
    batch = {r["task_id"]: (r["ts"], r["status"], r["progress"]) for r in P.live_at(spark.createDataFrame(rows, EVENTS)).collect()}
    assert stream == batch and 0 < len(batch) < 25


def test_a_task_that_goes_on_is_listed(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, at(0), 1, "completed", 1.0), (2, at(5), 1, "running", 0.1), (3, at(0), 2, "failed", 0.5), (4, at(30), 3, "completed", 1.0), (5, at(9), 4, "running", 0.2)]
    events = spark.createDataFrame(rows, EVENTS)
    assert sorted(r["task_id"] for r in P.live_at(events).collect()) == [1, 3, 4]
    assert sorted(r["task_id"] for r in P.live_at(events, F.lit(at(9))).collect()) == [1, 2, 4]


def put(spark, rows):
    return spark.createDataFrame(rows, "key string, value array<double>")


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def got(frame):
    return {r["key"]: (r["value"] and r["value"][0], r["level"]) for r in frame.collect()}


def test_a_hit_below_is_above_afterwards_until_it_ends(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    later = lambda s: start + dt.timedelta(seconds=s)
    both = TwoLevels(spark, f"{tmp_path}/up", f"{tmp_path}/low", seconds=60)
    both.lower.put("sim", put(spark, [("a", [0.5]), ("b", [0.25])]), start)
    both.upper.put("sim", put(spark, [("b", [0.75])]), start)
    assert got(both.get("sim", keys(spark, "a", "b", "c", "a"), later(1))) == {"a": (0.5, "lower"), "b": (0.75, "upper"), "c": (None, None)}
    assert got(both.get("sim", keys(spark, "a"), later(2))) == {"a": (0.5, "upper")}
    assert got(both.get("sim", keys(spark, "a", "b"), later(60))) == {"a": (0.5, "upper"), "b": (0.25, "lower")}  # b ended above
    assert got(both.get("sim", keys(spark, "a"), later(61))) == {"a": (0.5, "lower")}
    assert both.upper.compact("sim", later(100)) == 2 and both.upper.compact("sim", later(1000)) == 0
    assert both.upper.all("sim", later(1000)).collect() == [] and both.lower.compact("sim", later(1000)) == 2


def test_what_neither_level_has_is_computed_once(spark, tmp_path):
    both, asked = TwoLevels(spark, f"{tmp_path}/up", f"{tmp_path}/low"), []

    def compute(missed):
        asked.append(sorted(r["key"] for r in missed.collect()))
        return missed.withColumn("value", F.array(F.length("key").cast("double")))

    assert got(both.get_or("emb", keys(spark, "aa", "b"), compute)) == {"aa": (2.0, "new"), "b": (1.0, "new")}
    assert got(both.get_or("emb", keys(spark, "aa", "ccc"), compute)) == {"aa": (2.0, "upper"), "ccc": (3.0, "new")}
    both.upper.clear("emb")
    assert got(both.get_or("emb", keys(spark, "aa"), compute)) == {"aa": (2.0, "lower")}
    assert asked == [["aa", "b"], ["ccc"]]
    both.lower.put("sim", put(spark, [("x", [1.0])]))
    both.lower.clear("emb")
    assert got(both.get("sim", keys(spark, "x"))) == {"x": (1.0, "lower")} and both.lower.all("emb").collect() == []
    with pytest.raises(ValueError, match="unknown kind"):
        both.lower.clear("other")


def test_newest_value_counts_and_pairs_have_one_key(spark, tmp_path):
    level = Level(spark, str(tmp_path), 10)
    level.put("centroid", put(spark, [("d", [1.0, 2.0])]), dt.datetime(2024, 1, 1))
    level.put("centroid", put(spark, [("d", [3.0, 4.0])]), dt.datetime(2024, 1, 1, 0, 0, 5), seconds=1)
    assert level.get("centroid", keys(spark, "d"), dt.datetime(2024, 1, 1, 0, 0, 5)).first()["value"] == [3.0, 4.0]
    assert level.all("centroid", dt.datetime(2024, 1, 1, 0, 0, 7)).collect() == []  # an older value does not come back
    row = spark.range(1).select(pair_name("sbert", "cosine", F.lit("B"), F.lit("a")).alias("x"), pair_name("sbert", "cosine", F.lit("a"), F.lit("B")).alias("y")).first()
    assert row["x"] == row["y"] == "sbert:a:B:cosine"


def csv_file(path, n, bad):
    lines = ["term,domain,frequency"] + [f"{'' if i in bad else f't{i}'},{' ' if -i in bad else f'd{i % 7}'},{i}" for i in range(2, n + 2)]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_errors_name_their_rows_over_splits(spark, tmp_path):
    path = csv_file(tmp_path / "terms.csv", 900, {17, 733, -734})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = spark.read.csv(path, header=True)
        assert read.rdd.getNumPartitions() > 5
        assert [r["frequency"] for r in loaders.with_rows(read, 2).orderBy("_row").collect()] == [str(i) for i in range(2, 902)]
        assert all(int(r["frequency"]) == r["_row"] for r in loaders.with_rows(read, 2).collect())
        for lines in (True, False):
            with pytest.raises(loaders.LoadError, match="^2 rows without a term, 1 without a domain: row 17 of terms.csv has no term; row 733 of terms.csv has no term; row 734 of terms.csv has no domain$"):
                loaders.read_terms_csv(spark, path, lines)
        assert loaders.read_terms_csv(spark, csv_file(tmp_path / "fine.csv", 300, set()), True).count() == 300
        (tmp_path / "old.csv").write_text("term,domain,frequency\n" + "".join(f"t{i % 50},d{i},{i}\n" for i in range(400)), encoding="utf-8")
        found = {r["term"]: (r["domain"], r["frequency"]) for r in loaders.resumed_terms(spark, str(tmp_path / "old.csv")).collect()}
        assert found == {f"t{i % 50}": (f"d{i}", i) for i in range(350, 400)}  # the last line of each
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_quoted_field_over_lines_is_one_row(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('term,domain\n"a\nb",x\nc,\n', encoding="utf-8")
    with pytest.raises(loaders.LoadError, match="row 3 of q.csv has no domain"):
        loaders.read_terms_csv(spark, str(path))
