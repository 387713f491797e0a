"""What must not grow with the number of files or pairs."""

from docreef.operators import similarity
from docreef.sources import files
from docreef.streaming import watch


def test_watched_files_are_not_listed_through_the_driver(spark, tmp_path, monkeypatch):
    """No task a file, each file once over restarts, large folders in shares."""
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "deep" / "_no").mkdir(parents=True)
    for i in range(300):
        (src / ("deep" if i % 3 else ".") / f"é {i}.txt").write_text("x" * (i + 1))
    for name in ("empty", ".hidden", "_part", "deep/_no/x"):
        (src / name).write_text("" if name == "empty" else "1")

    def run():
        stream = watch.created(spark, f"file://{src}", per_batch=300)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/_state").trigger(availableNow=True).start(f"{out}/rows")
        query.awaitTermination()
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).stageIds]
        return max(s.numTasks for s in stages if s)

    assert run() <= 8
    want = {(f"file:{src}/{'deep/' if i % 3 else ''}é {i}.txt", i + 1) for i in range(300)}
    rows = lambda: [(r["src_path"], r["length"]) for r in spark.read.schema("event_type string, src_path string, length long").parquet(f"{out}/rows").collect()]
    assert len(rows()) == 300 and set(rows()) == want
    (src / "later").write_text("1")
    (src / "empty").write_text("no longer")  # seen already: not told of changes
    monkeypatch.setattr(files, "TASK_NAMES", 30)
    run()
    assert len(rows()) == 301 and set(rows()) == want | {(f"file:{src}/later", 1)}
    reader = files.WatchReader({"path": str(src)})
    parts = reader.partitions({}, {})
    assert len(parts) > 8 and sorted(r[0] for p in parts for r in reader.read(p)) == sorted({w[0] for w in want} | {f"file:{src}/later", f"file:{src}/empty"})
    monkeypatch.setattr(files, "FOLDER_TASKS", 2)
    assert len(reader.partitions({}, {})) == 5  # two shares of both folders, and one for small ones


def _near_copies(spark, m, groups=1):
    import random

    rng = random.Random(7)
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for i in range(m):
            w = list(base)
            w[rng.randrange(300)] = f"n{g}x{i}"
            texts.append(" ".join(w))
    return spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)


def test_sets_are_moved_once_a_text_not_once_a_pair(spark, monkeypatch):
    """240 near copies of 2.4 kB have 28,680 pairs: less is shuffled than 100 bytes a pair. Blocks give what one task gives."""
    store = spark.sparkContext._jsc.sc().statusStore()
    moved = lambda: store.executorList(True).apply(0).totalShuffleWrite()

    def cost(m):
        sets = similarity.written(similarity.shingle_sets(_near_copies(spark, m), 5, "doc_id", "text"), "sets")
        at = moved()
        assert similarity.pairs(sets, 0.8).count() == m * (m - 1) // 2
        return moved() - at

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert cost(240) < 100 * 28_680
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    docs = _near_copies(spark, 40, 2)
    want = {tuple(r) for r in similarity.pairs(similarity.shingle_sets(docs, 5, "doc_id", "text"), 0.8).collect()}
    for name, n in (("BLOCK", 7), ("WIDTH", 50), ("SORTED", 1_000), ("ASKED", 2)):
        monkeypatch.setattr(similarity, name, n)
    assert len(want) == 2 * 780 and {tuple(r) for r in similarity.pairs(similarity.shingle_sets(docs, 5, "doc_id", "text"), 0.8).collect()} == want


def test_small_files_share_tasks_and_are_stored_from_beside(spark, tmp_path):
    """Thousands of small files are one task of each source; files are stored whole, again and again, with nothing left."""
    root = tmp_path / "files"
    rows = spark.range(3_000).selectExpr("if(id = 5, null, concat('é', id)) as text", "concat('a/', id) as path", "id as seconds").repartition(3)
    for _ in range(2):
        assert files.store_texts(rows, f"file://{root}").agg({"n_files": "sum"}).first()[0] == 3_000
    assert len(list(root.rglob("*"))) == 3_001 and not [p for p in tmp_path.rglob("*") if p.is_file() and root not in p.parents]
    assert (root / "a/7").read_text() == "é7" and (root / "a/7").stat().st_mtime == 7 and (root / "a/5").read_text() == ""
    assert len(files.FolderReader({"path": str(root)}).partitions()) == 1
    reader = files.ListingReader({"path": str(root), "pagesize": "1000"})
    assert len(reader.partitions()) == 1 and sum(1 for p in reader.partitions() for _ in reader.read(p)) == 3_000
    assert len(files.ListingReader({"path": str(root), "pagesize": "10000"}).partitions()) == 1
