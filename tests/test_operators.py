"""Hand-made cases: reconciliation, sources, executor, streams, checks, classification."""

import json
import os

import pytest

from docreef import catalogue as C
from docreef.functions.scalars import described, extension, iso_local, missing, percent, requirement_name, version
from docreef.operators import checks, classify, diff, inventory, similarity, tree
from docreef.operators.executor import FolderBackend, execute
from docreef.sources import files
from docreef.streaming import watch
from pyspark.sql import functions as F

LOCAL = "container string, name string, path string, hash string"
REMOTE = "container string, id string, name string, md5Checksum string"
CASES = [  # name, local hash or None for an absent row, remote, raw, processed, syntheses
    ("only_local", "a", ..., "UPLOAD", "UPLOAD", "UPLOAD"),
    ("only_remote", ..., "a", "DOWNLOAD", "DOWNLOAD", "NOOP"),
    ("same", "a", "a", "NOOP", "NOOP", "NOOP"),
    ("changed", "a", "b", "UPDATE", "NOOP", "UPDATE"),
    ("no_checksum", "a", None, "UPDATE", "NOOP", "UPDATE"),
    ("unreadable", None, "b", "UPDATE", "NOOP", "UPDATE"),
    ("both_null", None, None, "NOOP", "NOOP", "NOOP"),
]


@pytest.mark.parametrize("container,column", [(C.RAW, 3), (C.PROCESSED + "/Drones", 4), (C.SYNTHESES, 5)])
def test_policy_matrix(spark, container, column):
    local = spark.createDataFrame([(container, n, "/p/" + n, h) for n, h, r, *_ in CASES if h is not ...], LOCAL)
    remote = spark.createDataFrame([(container, "i" + n, n, r) for n, h, r, *_ in CASES if r is not ...], REMOTE)
    got = {r["name"]: r for r in diff.plan(local, remote, "2024-01-15").collect()}
    assert {n: r["action"] for n, r in got.items()} == {c[0]: c[column] for c in CASES}
    assert (got["only_local"]["description"] is not None) == (container == C.RAW)
    assert got["changed"]["description"] is None


def test_duplicates_case_and_unknown_containers(spark):
    local = spark.createDataFrame([(C.RAW, "d", "/a/d", "x"), (C.RAW, "d", "/b/d", "y"), (C.RAW, "N", "/N", "a"), ("Elsewhere", "e", "/e", "a")], LOCAL)
    remote = spark.createDataFrame([(C.RAW, "1", "d", "y"), (C.RAW, "2", "n", "a")], REMOTE)
    got = {(r["container"], r["name"]): r["action"] for r in diff.plan(local, remote, "d").collect()}
    assert got == {(C.RAW, "d"): "NOOP", (C.RAW, "N"): "UPLOAD", (C.RAW, "n"): "DOWNLOAD", ("Elsewhere", "e"): "NOOP"}
    assert diff.plan(local.limit(0), remote.limit(0), "d").count() == 0


def test_folders_without_id_are_left_out(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "domain string")
    folders = spark.createDataFrame([("a", "1"), ("b", ""), ("c", None)], "domain string, folder_id string")
    assert [r[0] for r in diff.with_folder(rows, folders).collect()] == ["a"]
    assert diff.status(folders).first().asDict() == {"ok": False, "n_containers": 3, "n_failed": 2}
    assert diff.status(folders.limit(0)).first()["ok"] is True


@pytest.fixture
def corpus(tmp_path):
    for name, body in {"local/Raw Documents/é doc 1.pdf": "x", "local/Raw Documents/deep/.hidden": "h", "local/Raw Documents/empty": "", "remote/Raw Documents/old": "o", "remote/Raw Documents/é doc 1.pdf": "y"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return tmp_path


def test_sources_and_executor(spark, corpus):
    files.register(spark)
    local = spark.read.format("docreef_folder").load(f"{corpus}/local/Raw Documents")
    assert {r["name"] for r in local.collect()} == {"é doc 1.pdf", ".hidden", "empty"}
    assert [r["size"] for r in local.where("name = 'empty'").collect()] == [0]
    remote = spark.read.format("docreef_listing").option("pagesize", "1").load(f"{corpus}/remote")
    assert {r["name"] for r in remote.collect()} == {"old", "é doc 1.pdf"}
    plan = diff.plan(local, remote, "2024-01-15").cache()
    assert {r["name"]: r["action"] for r in plan.collect()} == {"é doc 1.pdf": "UPDATE", ".hidden": "UPLOAD", "empty": "UPLOAD", "old": "DOWNLOAD"}
    assert execute(plan).where("not ok").count() == 0 and not os.path.exists(corpus / "remote/Raw Documents/empty")
    for _ in range(2):  # twice: actions may run again
        assert {r["ok"] for r in execute(plan, FolderBackend(str(corpus / "remote"), str(corpus / "local"))).collect()} == {True}
    assert (corpus / "remote/Raw Documents/é doc 1.pdf").read_text() == "x" and (corpus / "local/Raw Documents/old").read_text() == "o"
    assert not [p for p in corpus.rglob("*.part")]
    again = diff.plan(spark.read.format("docreef_folder").load(f"{corpus}/local/Raw Documents"), spark.read.format("docreef_listing").load(f"{corpus}/remote"), "d")
    assert {r["action"] for r in again.collect()} == {"NOOP"}
    gone = plan.withColumn("local_path", F.lit("/nowhere/at/all"))
    out = {r["name"]: r["ok"] for r in execute(gone, FolderBackend(str(corpus / "remote"), str(corpus / "local"))).collect()}
    assert out["old"] and not out["empty"] and (corpus / "remote/Raw Documents/é doc 1.pdf").read_text() == "x"


def test_actions_run_once_and_any_failure_is_a_row(spark, tmp_path):
    class Counting(FolderBackend):
        """Fails in its own way, and notes what it is asked for."""

        def upload(self, container, name, path):
            with open(os.path.join(self.remote_root, "log"), "a") as f:
                f.write(name + "\n")
            if name == "bad":
                raise KeyError("no such thing")

    rows = [(C.RAW, n, "UPLOAD", "/p", None) for n in ("a", "bad", "c")] + [(C.RAW, "x", "DOWNLOAD", None, "../../etc/passwd"), (C.RAW, "n", "NOOP", None, None)]
    plan = spark.createDataFrame(rows, "container string, name string, action string, local_path string, remote_id string")
    report = execute(plan, Counting(str(tmp_path), str(tmp_path)))
    for _ in range(2):
        assert report.count() == 4 and {r["name"]: r["ok"] for r in report.collect()} == {"a": True, "bad": False, "c": True, "x": False}
    assert sorted((tmp_path / "log").read_text().split()) == ["a", "bad", "c"]
    backend = FolderBackend(str(tmp_path / "r"), str(tmp_path / "l"))
    backend.create_folder("A/B")
    backend.upload("A", "f", str(tmp_path / "log"))
    backend.delete("A/f")
    backend.delete("A/f")
    assert (tmp_path / "r/A/B").is_dir() and not (tmp_path / "r/A/f").exists()


def test_files_are_dealt_by_number_and_size(spark, tmp_path, monkeypatch):
    for i in range(25):
        (tmp_path / f"f{i:02}").write_text("x" * (50 if i == 7 else 1))
    monkeypatch.setattr(files, "TASK_FILES", 10)
    monkeypatch.setattr(files, "TASK_BYTES", 20)
    reader = files.FolderReader({"path": f"file://{tmp_path}"})
    parts = [p.value for p in reader.partitions()]
    assert sum(map(len, parts)) == 25 and max(map(len, parts)) <= 10 and [str(tmp_path / "f07")] in parts
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == [f"f{i:02}" for i in range(25)]
    with pytest.raises(ValueError):
        files.plain_path("s3://bucket/x")


def test_listing_filters_reach_the_folders(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        for i in range(5):
            (tmp_path / folder / f"{i}.txt").write_text(folder)
    files.register(spark)
    rows = spark.read.format("docreef_listing").option("pagesize", "2").load(str(tmp_path))
    assert rows.count() == 10 and {r["id"] for r in rows.where("container = 'b'").collect()} == {f"b/{i}.txt" for i in range(5)}
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = files.ListingReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([EqualTo(("container",), "b"), GreaterThan(("size",), "0")]))
    assert len(left) == 1 and {p.value[0] for p in reader.partitions()} == {"b"}


def test_arms_are_those_of_the_plan(spark):
    """Two local files of one name, the later equal to the remote one: nothing to do."""
    local = spark.createDataFrame([(C.RAW, "d", "/a/d", "x"), (C.RAW, "d", "/b/d", "y"), (C.SYNTHESES, "s", "/s", "1")], LOCAL)
    remote = spark.createDataFrame([(C.RAW, "1", "d", "y"), (C.SYNTHESES, "2", "only", "a")], REMOTE)
    assert diff.updates(local, remote).count() == 0 and diff.downloads(local, remote).count() == 0
    assert [r["name"] for r in diff.uploads(local, remote).collect()] == ["s"]
    assert {(r["name"], r["side"]) for r in diff.names_on(local, remote).collect()} == {("d", "both"), ("s", "local"), ("only", "remote")}


def test_provisioning(spark, tmp_path):
    wanted = spark.createDataFrame(tree.adjacency(), "path string, name string, parent_path string")
    have = spark.createDataFrame([("Corpus",), ("Corpus/Logs",)], "path string")
    rows = tree.provision(spark, wanted, have, [f"Corpus/{C.PROCESSED}"])
    got = {r["path"]: r["action"] for r in rows.collect()}
    assert got["Corpus"] == got["Corpus/Logs"] == "EXISTS" and got[f"Corpus/{C.PROCESSED}"] == "FAILED" and got[f"Corpus/{C.RAW}"] == "CREATE"
    assert {a for p, a in got.items() if p.startswith(f"Corpus/{C.PROCESSED}/")} == {"SKIPPED"}
    report = execute(tree.folder_actions(rows), FolderBackend(str(tmp_path), str(tmp_path)))
    assert report.where("ok").count() == 3 and (tmp_path / "Corpus" / C.RAW).is_dir() and not (tmp_path / "Corpus" / C.PROCESSED).exists()
    two = [tree.flatten(spark, wanted), tree.flatten(spark, wanted.where("path = 'Corpus'"))]  # at once: neither takes the other's table
    assert [x.count() for x in two] == [13, 1]


def test_entry_points(spark, tmp_path):
    from docreef import sync

    (tmp_path / "l" / C.RAW).mkdir(parents=True)
    (tmp_path / "l" / C.RAW / "a.txt").write_text("1")
    config = {"local_root": str(tmp_path / "l"), "remote_root": str(tmp_path / "r"), "containers": {C.RAW: "id1"}, "history": str(tmp_path / "h")}
    (tmp_path / "c.json").write_text(json.dumps(config))
    assert sync.main(["--mode", "once", "--config", str(tmp_path / "c.json")], spark) == 0 and (tmp_path / "r" / C.RAW / "a.txt").read_text() == "1"
    assert sync.main(["--mode", "status", "--config", str(tmp_path / "c.json")], spark) == 0
    assert sync.main(["--mode", "once", "--config", str(tmp_path / "none.json")], spark) == 1
    own = sync.Sync(spark, config)
    assert [(r["folder"], r["n_files"]) for r in own.status().collect()] == [(C.RAW, 1)] and own.history().first()["n_actions"] == 1
    (tmp_path / "r" / C.RAW / "b.txt").write_text("2")
    own.watch(every=None).awaitTermination()
    assert (tmp_path / "l" / C.RAW / "b.txt").read_text() == "2"
    assert own.connected() and not sync.Sync(spark, config | {"remote_root": str(tmp_path / "nowhere")}).connected()
    lacking = sync.Sync(spark, config | {"containers": {C.RAW: "id1", C.SYNTHESES: ""}})
    assert lacking.once() is False and sync.Sync(spark, None).once() is False and not (tmp_path / "r" / C.SYNTHESES).exists()
    health = sync.Health()
    spark.streams.addListener(health)
    (tmp_path / "l" / C.RAW / "a.txt").write_text("changed")  # no new file: only a tick sees it
    query = own.continuous(every="1 second")
    try:
        (tmp_path / "l" / C.RAW / "a.txt").write_text("changed twice")
        import time

        end = time.time() + 60
        while (tmp_path / "r" / C.RAW / "a.txt").read_text() != "changed twice" and time.time() < end:
            time.sleep(0.3)
    finally:
        query.stop()
        spark.streams.removeListener(health)
    assert (tmp_path / "r" / C.RAW / "a.txt").read_text() == "changed twice" and health.fine()


def test_shared_folder_is_required_off_one_machine(spark, monkeypatch):
    from docreef import shared

    class Context:
        def __init__(self, master):
            self.master, self._jsc = master, self
        getConf = lambda self: {}
        sc = lambda self: self
        getCheckpointDir = lambda self: self
        isDefined = lambda self: False
        setCheckpointDir = lambda self, x: None

    session = lambda master: type("S", (), {"sparkContext": Context(master)})()
    assert shared.shared_dir(session("local[4]")).startswith("file://")
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(RuntimeError):
            shared.shared_dir(session(master))


def test_probes(spark, tmp_path):
    got = {r["module"]: r["present"] for r in checks.modules(spark, [("json", "json"), ("no_such_module_here", "x"), ("no.such", "y")]).collect()}
    assert got == {"json": True, "no_such_module_here": False, "no.such": False}
    (tmp_path / ".env").write_text("# c\nA=1\nexport B='two'\nnope\n")
    assert checks.env_file(str(tmp_path / ".env")) == {"A": "1", "B": "two"} and checks.env_file(str(tmp_path / "none")) == {}
    assert checks.free_bytes(str(tmp_path)) > 0 and checks.round_trip(str(tmp_path)) and not checks.round_trip(str(tmp_path / "none"))
    assert not checks.answers("http://127.0.0.1:9/", 1) and not checks.answers("no url")
    rows = spark.createDataFrame([(0, "a", "passed"), (1, "b", "failed")], "seq int, check string, status string")
    assert "success rate 50.0%, warning" in checks.rendered(checks.summary(rows))
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 404)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    assert checks.answers(f"{at}/ok") and not checks.answers(f"{at}/no")
    server.shutdown()


def test_inventory_limits(spark):
    rows = spark.createDataFrame([("a.TXT", 5), ("b.exe", 5), ("c.md", 11), ("noext", 1), (".txt", 1)], "name string, size long")
    assert {r["name"] for r in inventory.allowed(rows, C.EXTENSIONS, 10).collect()} == {"a.TXT", ".txt"}
    need = spark.createDataFrame([("a",), ("b",)], "name string")
    assert [r["name"] for r in inventory.found(need, spark.createDataFrame([("b",), ("b",)], "name string")).collect()] == ["b"]


def test_connected_sets(spark):
    from docreef.operators.graph import connected

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 200)]
    got = {(r["node"], r["root"]) for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_inventory_by_spark(spark, corpus):
    rows = files.inventory(spark, f"{corpus}/local/Raw Documents", C.RAW, most_bytes=10).collect()
    assert [(r["name"], r["size"]) for r in rows] == [("é doc 1.pdf", 1)]


def test_config(spark, tmp_path):
    path = str(tmp_path / "config.json")
    files.save_config(path, {"Drones": "id7"}, C.DOMAINS)
    got = {r["domain"]: r for r in files.load_domains(spark, path).collect()}
    assert set(got) == set(C.DOMAINS) and got["Drones"]["folder_id"] == "id7" and got["Artillerie"]["folder_id"] is None
    assert got["Drones"]["keywords"] == C.DOMAINS["Drones"]["keywords"]
    (tmp_path / "bad.json").write_text("{nope")
    assert files.load_domains(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "short.json").write_text(json.dumps({"x_domains": {"A": {"keywords": ["k"]}}}))
    assert [r.asDict() for r in files.load_domains(spark, str(tmp_path / "short.json")).collect()] == [{"domain": "A", "keywords": ["k"], "aliases": [], "folder_id": None, "color": None, "priority": None}]


def test_streams(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    (src / "a.txt").write_text("1")
    run = lambda: watch.reconcile(watch.created(spark, str(src)), lambda: spark.range(1), lambda plan, n: seen.append(plan.count()), str(tmp_path / "state"), None).awaitTermination()
    run()
    run()
    assert seen == [1]
    (src / "b.txt").write_text("2")
    run()
    assert seen == [1, 1]
    before = spark.createDataFrame([("a", "1"), ("b", None), ("d", "x")], "path string, hash string")
    after = spark.createDataFrame([("a", "2"), ("b", None), ("c", "1")], "path string, hash string")
    assert {tuple(r) for r in watch.changes(before, after).collect()} == {("modified", "a"), ("created", "c")}


def test_tree(spark):
    folders = spark.createDataFrame(tree.adjacency(), "path string, name string, parent_path string")
    assert folders.count() == 13 and tree.flatten(spark, folders).agg(F.max("depth")).first()[0] == 2
    assert tree.flatten(spark, folders, [f"Corpus/{C.PROCESSED}"]).count() == 5
    assert tree.lookup(folders, "nope").count() == 0
    twice = spark.createDataFrame([("a/x", "x", "a"), ("b/x", "x", "b")], "path string, name string, parent_path string")
    assert tree.folder_map(twice).count() == 1 and tree.lookup(twice, "x").first()["path"] == "a/x"


def test_checks(spark):
    none = checks.summary(spark.createDataFrame([], "seq int, check string, status string")).first()
    assert (none["rate"], none["verdict"]) == (0.0, "ok")
    rows = [(i, f"c{i}", "failed" if i < 3 else "warned" if i == 3 else "passed") for i in range(10)]
    got = checks.summary(spark.createDataFrame(rows, "seq int, check string, status string")).first()
    assert (got["n_passed"], got["n_failed"], got["rate"], got["verdict"], got["failed"]) == (6, 3, 66.7, "failed", "c0, c1, c2")


def test_scalars(spark):
    one = spark.createDataFrame([("a/b.TXT", "", "2024-01-02 03:04:05.5", "2024-01-02 03:04:05")], "p string, e string, t string, u string")
    got = one.select(
        extension(F.col("p")), missing(F.col("e")), iso_local(F.col("t").cast("timestamp")), iso_local(F.col("u").cast("timestamp")), version(F.lit("3.10rc1")),
        requirement_name(F.lit("x>=1")), percent(F.lit(1), F.lit(0)), described("Doc", "d"),
    ).first()
    assert list(got) == [".txt", True, "2024-01-02T03:04:05.500000", "2024-01-02T03:04:05", [3, 101], "x", 0.0, "Doc - d"]


def test_classification(spark):
    docs = spark.createDataFrame([(1, "The EW unit: combat medic."), (2, "brewed; combat, medic"), (3, None), (4, "дрон летит, UAV")], "doc_id long, text string")
    lexicon = [(d, t, x["priority"]) for d, x in C.DOMAINS.items() for t in x["keywords"] + x["aliases"]]
    got = {r["doc_id"]: (r["domain"], r["score"]) for r in classify.best(docs, lexicon).collect()}
    assert got == {1: ("Sauvetage Combat", 3), 2: ("Sauvetage Combat", 2), 3: (C.OTHER, 0), 4: ("Drones", 2)}
    many = lexicon + [(f"x{i}", f"zz{i}", 5) for i in range(classify.PLANNED_TERMS)]
    assert {tuple(r) for r in classify.hits(docs, many).collect()} == {tuple(r) for r in classify.hits(docs, lexicon).collect()}
    top = classify.top_points(classify.hits(docs, lexicon), 1, 2).collect()
    assert {(r["domain"], r["doc_id"], r["enough"]) for r in top} == {("Sauvetage Combat", 1, True), ("Guerre Electronique", 1, False), ("Drones", 4, False)}


def test_numbering_by_ranges(spark):
    rows = spark.range(0, 3000, 3).selectExpr("id as k", "'x' as part", "1 as place", "2 as row", "3 as key").repartition(7)
    got = inventory.numbered(rows, "k").orderBy("k").collect()
    assert [r["number"] for r in got] == list(range(1, 1001)) and len(got[0]) == 6
    assert inventory.batches(rows.limit(0), "k", 50).count() == 0
    same = spark.range(100).selectExpr("cast(null as long) as k")
    assert sorted(r["number"] for r in inventory.numbered(same, "k").collect()) == list(range(1, 101))


def test_similar_pairs_brute_force(spark):
    import random

    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 40)) for _ in range(60)) for _ in range(12)]
    texts = []
    for t in base:
        for n in (0, 1, 2, 4, 9):
            w = t.split()
            for _ in range(n):
                w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, "short one"), (903, "short one")], "doc_id long, text string")
    sets = {}
    for i, t in enumerate(texts):
        w = t.split()
        sets.setdefault(t, (i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    own = list(sets.values())
    want = {(i, j) for i, a in own for j, b in own if i < j and 5 * len(a & b) >= 4 * len(a | b)}
    got = similarity.pairs(similarity.shingle_sets(docs, 5, "doc_id", "text"), 0.8)
    assert {(r["a"], r["b"]) for r in got.collect()} == want and want
    links = {i: {b if a == i else a for a, b in want if i in (a, b)} for p in want for i in p}
    rows = similarity.similar_texts(docs).collect()
    assert {r["doc_id"]: r["n_links"] for r in rows} == {i: len(x) for i, x in links.items()}
    assert all(min(x | {i}) >= next(r["class_id"] for r in rows if r["doc_id"] == i) for i, x in links.items())
    top = similarity.clusters(docs).orderBy("rank").collect()
    assert [r["rank"] for r in top] == list(range(1, 11)) and top[0]["n_docs"] == max(r["n_docs"] for r in top)
    assert similarity.clusters(docs.limit(0)).count() == 0 and similarity.similar_texts(docs.limit(0)).count() == 0
