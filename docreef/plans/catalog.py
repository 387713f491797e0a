"""Queries by name over the driver's tables, and the SQL that states them.

Inventories are made of documents. ``local_inventory``, ``remote_inventory`` and ``sync_executed`` write them as files
into the shared folder and read those by the sources; the plans, which need no files, take each document as a file that
is present locally, remotely or on both sides: local ones lack ``doc_id % 10 = 3``, remote ones ``doc_id % 10 = 5``, so
that every document is on one side at least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docreef import catalogue as C
from docreef import schema
from docreef.functions import scalars as S
from docreef.functions.scalars import requirement_name
from docreef.operators import checks, classify, diff, inventory, semantic, similarity, tree
from docreef.operators.executor import FolderBackend, execute
from docreef.shared import new_folder
from docreef.sources import files
from docreef.streaming import watch

DAY = "2024-01-15"
LEXICON = [("en_core", "the", 1), ("en_core", "with", 1), ("fr_core", "le", 2), ("fr_core", "pour", 2), ("es_core", "los", 3), ("de_core", "und", 3)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file() -> F.Column:
    return F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt"))


def local_files(spark: SparkSession, sf_dir: str, container: F.Column | None = None, where: str = "doc_id % 10 <> 3") -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(where)
    return docs.select(
        (F.lit(C.RAW) if container is None else container).alias("container"), _file().alias("name"),
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), _file()).alias("path"), F.octet_length("text").cast("long").alias("size"),
        F.md5(F.encode("text", "utf-8")).alias("hash"),
    )


def remote_files(spark: SparkSession, sf_dir: str, container: F.Column | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id % 10 <> 5")
    stale = F.md5(F.encode(F.concat("text", F.lit("~")), "utf-8"))
    return docs.select(
        (F.lit(C.RAW) if container is None else container).alias("container"), F.concat(F.lit("id"), "doc_id").alias("id"), _file().alias("name"),
        F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 7 == 0, stale).otherwise(F.md5(F.encode("text", "utf-8"))).alias("md5Checksum"),
        F.octet_length("text").cast("string").alias("size"),
    )


def _stored(spark: SparkSession, sf_dir: str, path: F.Column, where: str = "true", text: F.Column | None = None) -> str:
    """Documents as files below a new shared folder, each a second younger than the one before; the folder."""
    docs = table(spark, sf_dir, "documents").where(where)
    root = new_folder(spark, "files")
    files.store_texts(docs.select((F.col("text") if text is None else text).alias("text"), path.alias("path"), (F.lit(1_704_067_200) + F.col("doc_id")).alias("seconds")), root).agg(F.sum("n_files")).collect()
    files.register(spark)
    return files.plain_path(root)


def local_inventory(spark, sf_dir):
    """All documents, one folder a source, read as files."""
    root = _stored(spark, sf_dir, F.concat(F.lit(C.RAW + "/"), "source", F.lit("/"), _file()))
    rows = spark.read.format("docreef_folder").load(f"{root}/{C.RAW}")
    return rows.withColumn("path", F.expr(f"substring(path, {len(root) + 2})"))


def remote_inventory(spark, sf_dir):
    """All documents, one remote folder a source, read as a paged listing."""
    return spark.read.format("docreef_listing").option("pagesize", "500").load(_stored(spark, sf_dir, F.concat("source", F.lit("/"), _file())))


def inventory_allowed(spark, sf_dir):
    """The documents as files of several extensions, those that the allow-list and the size limit keep."""
    names = F.concat(F.lit("doc_"), F.col("doc_id"), F.element_at(F.array(*[F.lit(x) for x in (".txt", ".PDF", ".exe", ".md", "")]), (F.pmod(F.col("doc_id"), F.lit(5)) + 1).cast("int")))
    rows = table(spark, sf_dir, "documents").select(names.alias("name"), F.octet_length("text").cast("long").alias("size"))
    return inventory.allowed(rows, C.EXTENSIONS, 5_000)


def sync_executed(spark, sf_dir):
    """Both sides as files, scanned, planned and carried out; and what a second plan would do."""
    stale = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text"))
    local = _stored(spark, sf_dir, F.concat(F.lit(C.RAW + "/"), _file()), "doc_id % 10 <> 3")
    remote = _stored(spark, sf_dir, F.concat(F.lit(C.RAW + "/"), _file()), "doc_id % 10 <> 5", stale)

    def planned():
        return diff.plan(spark.read.format("docreef_folder").load(f"{local}/{C.RAW}"), spark.read.format("docreef_listing").load(remote), DAY)

    report = execute(planned(), FolderBackend(remote, local))
    after = planned().select("container", "name", F.col("action").alias("after"))
    return report.join(after, ["container", "name"], "full").select("container", "name", F.coalesce("action", F.lit("NOOP")).alias("action"), F.coalesce("ok", F.lit(True)).alias("ok"), "after")


def _colliding(rows):
    """Up to three documents a name, so that both sides must be deduplicated."""
    n = F.regexp_extract("name", "([0-9]+)", 1).cast("long")
    return rows.withColumn("name", F.concat(F.lit("file_"), F.when(n % 2 == 1, n).otherwise(F.floor(n / 4))))


def _both(spark, sf_dir):
    return _colliding(local_files(spark, sf_dir)), _colliding(remote_files(spark, sf_dir))


_L = "SELECT '{c}' AS container, concat('doc_', doc_id, '.txt') AS name, concat('/corpus/', source, '/doc_', doc_id, '.txt') AS path, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS hash FROM documents WHERE doc_id % 10 <> 3"
_ALL = _L.removesuffix(" WHERE doc_id % 10 <> 3")
_R = "SELECT '{c}' AS container, concat('id', doc_id) AS id, concat('doc_', doc_id, '.txt') AS name, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN md5(text || '~') ELSE md5(text) END AS md5Checksum, CAST(strlen(text) AS VARCHAR) AS size FROM documents WHERE doc_id % 10 <> 5"
_SOURCE = "concat('Processed Documents/', source)"


def _sides(container: str, by_source: bool = False) -> str:
    l, r = _L.format(c=container), _R.format(c=container)
    if by_source:
        l, r = l.replace(f"'{container}' AS", f"{_SOURCE} AS"), r.replace(f"'{container}' AS", f"{_SOURCE} AS")
        l, r = (x + " AND source IN (SELECT domain FROM f WHERE folder_id <> '')" for x in (l, r))
    return f"l AS ({l}), r AS ({r})"


def _plan_sql(upload: bool = True, update: bool = True, download: bool = True, note: str = "NULL") -> str:
    arm = lambda on, x: f"'{x}'" if on else "'NOOP'"
    return f"""
SELECT container, name, action, path AS local_path, id AS remote_id, hash AS local_hash, md5Checksum AS remote_hash,
       CAST(CASE WHEN action = 'UPLOAD' THEN {note} END AS VARCHAR) AS description
FROM (SELECT coalesce(l.container, r.container) AS container, coalesce(l.name, r.name) AS name, l.path, r.id, l.hash, r.md5Checksum,
             CASE WHEN r.name IS NULL THEN {arm(upload, "UPLOAD")} WHEN l.name IS NULL THEN {arm(download, "DOWNLOAD")}
                  WHEN l.hash IS DISTINCT FROM r.md5Checksum THEN {arm(update, "UPDATE")} ELSE 'NOOP' END AS action
      FROM l FULL JOIN r ON l.container = r.container AND l.name = r.name)"""


def source_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, folder_id): sources as domains; some have no folder, one an empty id."""
    one = table(spark, sf_dir, "documents").select(F.col("source").alias("domain")).distinct()
    return one.withColumn("folder_id", F.when(F.col("domain").isin("src3", "src13"), None).when(F.col("domain") == "src7", "").otherwise(F.concat(F.lit("folder-"), "domain")))


_FOLDERS = "f AS (SELECT DISTINCT source AS domain, CASE WHEN source IN ('src3', 'src13') THEN NULL WHEN source = 'src7' THEN '' ELSE concat('folder-', source) END AS folder_id FROM documents)"


def sync_plan_raw(spark, sf_dir):
    return diff.plan(local_files(spark, sf_dir), remote_files(spark, sf_dir), DAY)


def _processed(spark, sf_dir):
    on = F.concat(F.lit(C.PROCESSED + "/"), "source")
    folders = source_folders(spark, sf_dir).withColumn("container", F.concat(F.lit(C.PROCESSED + "/"), "domain"))
    return [diff.with_folder(f(spark, sf_dir, on), folders, "container") for f in (local_files, remote_files)]


def sync_plan_processed(spark, sf_dir):
    return diff.plan(*_processed(spark, sf_dir), DAY)


def sync_plan_syntheses(spark, sf_dir):
    return diff.plan(*[f(spark, sf_dir, F.lit(C.SYNTHESES)) for f in (local_files, remote_files)], DAY)


def sync_plan_all(spark, sf_dir):
    """All containers in one join."""
    sides = [_processed(spark, sf_dir)[i].unionByName(f(spark, sf_dir)).unionByName(f(spark, sf_dir, F.lit(C.SYNTHESES))) for i, f in enumerate((local_files, remote_files))]
    return diff.plan(*sides, DAY)


def sync_status(spark, sf_dir):
    return diff.status(source_folders(spark, sf_dir))


def inventory_dedup(spark, sf_dir):
    rows = local_files(spark, sf_dir, where="true").withColumn("name", F.concat(F.lit("file_"), F.regexp_extract("name", r"(\d+)", 1).cast("long") % 97))
    return inventory.deduplicated(rows, ["container", "name"], "path")


def _folders(spark, sf_dir):
    """(path, name, parent_path) of the folders that the corpus needs: a root, languages, sources in them, and in those
    four folders for the documents."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.concat(F.lit("part"), F.col("doc_id") % 4).alias("part")).distinct()
    root = F.lit("Corpus")
    levels = [(root, root, F.lit(None).cast("string"))]
    for c in ("lang", "source", "part"):
        path = F.concat(levels[-1][0], F.lit("/"), F.col(c))
        levels.append((path, F.col(c), levels[-1][0]))
    rows = docs.select(F.explode(F.array(*[F.struct(p.alias("path"), n.alias("name"), q.alias("parent_path")) for p, n, q in levels])).alias("f")).select("f.*")
    return rows.distinct()


def _domains(spark, sf_dir):
    """Sources as themes: languages as keywords, the first of them with an ending as alias, a priority by their size."""
    docs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("domain")).agg(F.array_sort(F.collect_set("lang")).alias("keywords"), F.count(F.lit(1)).alias("n"))
    return docs.select("domain", "keywords", F.array(F.concat(F.col("keywords")[0], F.lit("-é"))).alias("aliases"), F.when(F.col("n") % 2 == 0, F.lit("")).alias("folder_id"), F.lit("#123456").alias("color"), (F.col("n") % 5).cast("int").alias("priority"))


def _config(spark, sf_dir) -> str:
    path = new_folder(spark, "config")
    files.config_text(_domains(spark, sf_dir), "corpus_domains").coalesce(1).write.text(path)
    return path


def config_domains(spark, sf_dir):
    """A configuration made of the corpus, written and loaded again: a row a term."""
    d = files.load_domains(spark, _config(spark, sf_dir))
    words = [d.select("domain", F.lit(kind).alias("kind"), F.explode(column).alias("term"), "folder_id", "priority") for kind, column in (("keyword", "keywords"), ("alias", "aliases"))]
    return words[0].unionByName(words[1])


def config_sections(spark, sf_dir):
    return files.sections(spark, _config(spark, sf_dir), ("system", "google_drive", "corpus_domains"))


def provision_plan(spark, sf_dir):
    """The corpus' folders against those that documents of even id have already; one of them cannot be made."""
    wanted = _folders(spark, sf_dir)
    have = table(spark, sf_dir, "documents").where("doc_id % 2 = 0 and doc_id % 4 <> 2").select(F.concat_ws("/", F.lit("Corpus"), "lang", "source", F.concat(F.lit("part"), F.col("doc_id") % 4)).alias("path")).distinct()
    return tree.provision(spark, wanted, have, ["Corpus/fr"])


def folder_counts(spark, sf_dir):
    known = spark.createDataFrame([(f"src{i}",) for i in range(25)], "folder string")
    return inventory.folder_counts(known, table(spark, sf_dir, "documents").select(F.col("source").alias("folder")))


REQUIRED = (0, 1, 3, 13, 14, 10**9)


def _required(spark):
    return spark.createDataFrame([(f"doc_{i}.txt", f"package{i}>={i}.0") for i in REQUIRED], "name string, requirement string")


def missing_required(spark, sf_dir):
    out = inventory.missing(_required(spark), local_files(spark, sf_dir).select("name"))
    return out.select("name", requirement_name(F.col("requirement")).alias("package"))


def found_required(spark, sf_dir):
    out = inventory.found(_required(spark), local_files(spark, sf_dir).select("name"))
    return out.select("name", requirement_name(F.col("requirement")).alias("package"))


def json_path_exists(spark, sf_dir):
    return checks.json_paths(table(spark, sf_dir, "events").select("event_id", "props"), "props", {"has_k": "$.k", "has_client": "$.installed.client_id"}).drop("props")


def _versions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat_ws(".", F.col("p_size"), F.col("p_partkey") % 20).alias("have"), F.concat_ws(".", F.lit(25), F.col("p_partkey") % 7, F.lit(1)).alias("need"))


def version_check(spark, sf_dir):
    return checks.new_enough(_versions(spark, sf_dir)).select("p_partkey", "have", "need", "ok")


def version_least(spark, sf_dir):
    return checks.least_version(_versions(spark, sf_dir), ["p_brand"])


def scalar_functions(spark, sf_dir):
    """Columns of events and documents through the scalars that no other query shows."""
    docs = table(spark, sf_dir, "documents")
    name, day = _file(), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id"))
    return docs.select(
        "doc_id", S.base_name(F.concat_ws("/", "source", name)).alias("base"), S.iso_local(day).alias("iso"), S.stamped(day).alias("stamp"), S.stamped(day, "yyyyMMdd").alias("day"),
        S.fields(F.concat_ws(".", "lang", "source", "doc_id"), ".", 2, 3).alias("cut"), S.holds(F.col("text"), "the ").alias("holds"), S.rule_line("=", 5).alias("rule"),
        S.looked_up(F.create_map(F.lit("fr"), F.lit("français"), F.lit("en"), F.lit("english")), F.col("lang"), F.lit("?")).alias("language"),
        S.child_path(F.when(F.col("doc_id") % 2 == 0, F.col("source")), name).alias("path"), S.extension(name).alias("ext"), F.round(S.alike(F.col("lang"), F.col("source")), 6).alias("alike"),
    )


def check_summary(spark, sf_dir):
    """The ten checks, each failed if the corpus' row count has its place as last digit."""
    n = table(spark, sf_dir, "documents").agg((F.count(F.lit(1)) % 10).alias("n"))
    names = spark.createDataFrame(list(enumerate(C.CHECKS)), "seq int, check string")
    return checks.summary(names.crossJoin(F.broadcast(n)).select("seq", "check", F.when(F.col("seq") == F.col("n"), "failed").otherwise("passed").alias("status")))


def corpus_metrics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    size = F.octet_length("text").cast("long")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("n_bytes"), F.avg(size).alias("mean_bytes"), F.sum((size <= C.MOST_OCR_BYTES).cast("long")).alias("n_ocr"))


def sync_frequency(spark, sf_dir):
    """Runs of a synchroniser a day, as events of the kind ``sync`` would be: how many, and their mean value."""
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def watch_snapshots(spark, sf_dir):
    """Events between the remote side as the earlier snapshot and all documents as the later."""
    before = remote_files(spark, sf_dir).select(F.col("name").alias("path"), F.col("md5Checksum").alias("hash"))
    return watch.changes(before, local_files(spark, sf_dir, where="true").select(F.col("name").alias("path"), "hash"))


def watch_created(spark, sf_dir):
    """All documents as files of a watched folder, seen as new by a stream that ends with what there is."""
    root = _stored(spark, sf_dir, F.concat("source", F.lit("/"), _file()))
    out = new_folder(spark, "seen")
    stream = watch.created(spark, f"file://{root}", per_batch=20_000).withColumn("src_path", F.expr(f"substring(src_path, {len(root) + 7})"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/_state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").withColumn("src_path", F.regexp_replace("src_path", "^/+", ""))


def stream_documents(spark, sf_dir):
    one = f"{sf_dir}/[d]ocuments.parquet"  # a pattern: the stream's reader takes a single file only so
    return watch.documents_seen(spark, one, table(spark, sf_dir, "documents").schema, new_folder(spark, "stream"))


def semantic_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return semantic.semantic_search(vectors, vectors.where("vec_id % 20 = 0"))


def _docs(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


QUERIES = {
    "local_inventory": local_inventory,
    "remote_inventory": remote_inventory,
    "inventory_allowed": inventory_allowed,
    "inventory_dedup": inventory_dedup,
    "sync_upload": lambda s, d: diff.uploads(*_both(s, d)),
    "sync_update": lambda s, d: diff.updates(*_both(s, d)),
    "sync_download": lambda s, d: diff.downloads(*_both(s, d)),
    "name_sets": lambda s, d: diff.names_on(*_both(s, d)),
    "sync_executed": sync_executed,
    "sync_plan_raw": sync_plan_raw,
    "sync_plan_processed": sync_plan_processed,
    "sync_plan_syntheses": sync_plan_syntheses,
    "sync_plan_all": sync_plan_all,
    "sync_status": sync_status,
    "config_domains": config_domains,
    "config_sections": config_sections,
    "folder_flatten": lambda s, d: tree.flatten(s, _folders(s, d)),
    "folder_lookup": lambda s, d: tree.lookup(_folders(s, d), "src7"),
    "domain_folders": lambda s, d: tree.domain_folders(_domains(s, d).unionByName(s.createDataFrame([("Sans dossier", [], [], None, None, 9)], schema.DOMAINS)), _folders(s, d)),
    "provision_plan": provision_plan,
    "folder_counts": folder_counts,
    "missing_required": missing_required,
    "found_required": found_required,
    "json_path_exists": json_path_exists,
    "version_check": version_check,
    "version_least": version_least,
    "scalar_functions": scalar_functions,
    "check_summary": check_summary,
    "classify_hits": _docs(lambda docs: classify.hits(docs, LEXICON)),
    "classify_best": _docs(lambda docs: classify.best(docs, LEXICON)),
    "domain_counts": _docs(lambda docs: classify.best(docs, LEXICON).groupBy("domain").agg(F.count(F.lit(1)).alias("n_docs"))),
    "synthesis_top20": _docs(lambda docs: classify.top_points(classify.hits(docs, LEXICON), C.TOP_POINTS, C.LEAST_POINTS)),
    "batch_assign": _docs(lambda docs: inventory.batches(docs, "doc_id", C.BATCH_DOCUMENTS)),
    "corpus_metrics": corpus_metrics,
    "sync_frequency": sync_frequency,
    "similar_pairs": _docs(lambda docs: similarity.similar_texts(docs, C.SIMILAR)),
    "document_clusters": _docs(lambda docs: similarity.clusters(docs, C.RELATED, C.SIMILAR, C.CLUSTERS)),
    "semantic_search": semantic_search,
    "theme_relations": _docs(lambda docs: semantic.relations(classify.hits(docs, LEXICON))),
    "watch_snapshots": watch_snapshots,
    "watch_created": watch_created,
    "stream_documents": stream_documents,
    "event_counts": lambda s, d: watch.event_counts(table(s, d, "events")),
}


def _text(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(x if isinstance(x, str) and x.startswith("CAST") else str(x) if isinstance(x, int) else _text(x) for x in r) + ")" for r in rows)


_RAW = "WITH " + _sides(C.RAW)
_NOTE = f"'Document - {DAY}'"
_LEX = f"x(domain, keyword, priority) AS (VALUES {_values(LEXICON)})"
_HITS = _LEX + r""", hits AS (SELECT doc_id, domain, keyword, CAST(priority AS INTEGER) AS priority FROM documents, x
 WHERE regexp_matches(lower(coalesce(text, '')), '(^|[^\p{L}\p{N}_])' || keyword || '([^\p{L}\p{N}_]|$)'))"""
_SCORES = _HITS + ", scores AS (SELECT doc_id, domain, count(DISTINCT keyword) AS score, min(priority) AS priority FROM hits GROUP BY ALL)"
_BEST = _SCORES + f""", best AS (SELECT d.doc_id, coalesce(s.domain, '{C.OTHER}') AS domain, coalesce(s.score, 0) AS score FROM documents d LEFT JOIN
 (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, priority, domain) = 1) s USING (doc_id))"""
_TREE = """docs AS (SELECT DISTINCT lang, source, concat('part', doc_id % 4) AS part FROM documents),
a AS (SELECT 'Corpus' AS path, 'Corpus' AS name, CAST(NULL AS VARCHAR) AS parent_path WHERE EXISTS (SELECT 1 FROM docs)
 UNION SELECT concat('Corpus/', lang), lang, 'Corpus' FROM docs
 UNION SELECT concat('Corpus/', lang, '/', source), source, concat('Corpus/', lang) FROM docs
 UNION SELECT concat('Corpus/', lang, '/', source, '/', part), part, concat('Corpus/', lang, '/', source) FROM docs)"""
_NAMED = "named AS (SELECT name, md5(max(path)) AS id FROM a GROUP BY name)"
_WALK = "t AS (SELECT path, name, parent_path, 0 AS depth FROM a WHERE parent_path IS NULL{0} UNION ALL SELECT a.path, a.name, a.parent_path, t.depth + 1 FROM a JOIN t ON a.parent_path = t.path{1})"
_TERMS = "d AS (SELECT source AS domain, list_sort(list_distinct(list(lang))) AS k, CASE WHEN count(*) % 2 = 0 THEN '' END AS folder_id, CAST(count(*) % 5 AS INTEGER) AS priority FROM documents GROUP BY source)"
_N = "CAST(regexp_extract(name, '[0-9]+') AS BIGINT)"
_C = f"concat('file_', CASE WHEN {_N} % 2 = 1 THEN {_N} ELSE {_N} // 4 END)"
_LC = f"WITH l0 AS ({_L.format(c=C.RAW)}), r0 AS ({_R.format(c=C.RAW)}), l AS (SELECT container, {_C} AS name, max(path) AS path, arg_max(hash, path) AS hash FROM l0 GROUP BY 1, 2), r AS (SELECT container, {_C} AS name, max(id) AS id, max_by(struct_pack(h := md5Checksum), id).h AS md5Checksum FROM r0 GROUP BY 1, 2)"
_HAVE = "v AS (SELECT p_partkey, p_brand, concat(p_size, '.', p_partkey % 20) AS have, concat('25.', p_partkey % 7, '.1') AS need FROM part)"
_INTS = "list_transform(string_split({0}, '.'), lambda x: CAST(x AS INTEGER))"
_SETS = r"""d AS (SELECT min(doc_id) AS id, count(*) AS copies, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents GROUP BY text),
s AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM s a JOIN s b USING (x) WHERE a.id <> b.id GROUP BY ALL),
near AS (SELECT a, b, common, na.n + nb.n - common AS total FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b),
links AS (SELECT a, b FROM near WHERE 5 * common >= 4 * total),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
classes AS (SELECT a AS id, least(a, min(b)) AS class_id FROM reach GROUP BY a)"""
_SCAN = "to_timestamp(1704067200 + doc_id) AT TIME ZONE 'UTC'"

ORACLE_SQL = {
    "local_inventory": f"SELECT '{C.RAW}' AS container, concat('doc_', doc_id, '.txt') AS name, concat('{C.RAW}/', source, '/doc_', doc_id, '.txt') AS path, CAST(strlen(text) AS BIGINT) AS size, {_SCAN} AS modified, md5(text) AS hash FROM documents",
    "remote_inventory": f"SELECT source AS container, concat(source, '/doc_', doc_id, '.txt') AS id, concat('doc_', doc_id, '.txt') AS name, strftime({_SCAN}, '%Y-%m-%dT%H:%M:%S') AS modifiedTime, md5(text) AS md5Checksum, CAST(strlen(text) AS VARCHAR) AS size FROM documents",
    "inventory_dedup": f"WITH l AS ({_ALL.format(c=C.RAW)}) SELECT container, concat('file_', CAST(regexp_extract(name, '[0-9]+') AS BIGINT) % 97) AS name, max(path) AS path, arg_max(size, path) AS size, arg_max(hash, path) AS hash FROM l GROUP BY 1, 2",
    "sync_upload": f"{_LC} SELECT container, name, path, hash FROM l ANTI JOIN r USING (container, name)",
    "sync_update": f"{_LC} SELECT container, name, id, hash, md5Checksum FROM l JOIN r USING (container, name) WHERE hash IS DISTINCT FROM md5Checksum",
    "sync_download": f"{_LC} SELECT container, name, id, md5Checksum FROM r ANTI JOIN l USING (container, name)",
    "sync_plan_raw": _RAW + _plan_sql(note=_NOTE),
    "sync_plan_processed": f"WITH {_FOLDERS}, " + _sides(C.PROCESSED, True) + _plan_sql(update=False),
    "sync_plan_syntheses": "WITH " + _sides(C.SYNTHESES) + _plan_sql(download=False),
    "sync_plan_all": "\nUNION ALL\n".join(
        f"SELECT * FROM ({x})" for x in (_RAW + _plan_sql(note=_NOTE), f"WITH {_FOLDERS}, " + _sides(C.PROCESSED, True) + _plan_sql(update=False), "WITH " + _sides(C.SYNTHESES) + _plan_sql(download=False))
    ),
    "sync_status": f"WITH {_FOLDERS} SELECT bool_and(coalesce(folder_id, '') <> '') AS ok, count(*) AS n_containers, count(*) FILTER (WHERE coalesce(folder_id, '') = '') AS n_failed FROM f",
    "config_domains": f"WITH {_TERMS} SELECT domain, 'keyword' AS kind, unnest(k) AS term, folder_id, priority FROM d UNION ALL SELECT domain, 'alias', concat(k[1], '-é'), folder_id, priority FROM d",
    "folder_flatten": f"WITH RECURSIVE {_TREE}, {_WALK.format('', '')} SELECT * FROM t",
    "folder_lookup": f"WITH {_TREE} SELECT * FROM a WHERE name = 'src7' ORDER BY path LIMIT 1",
    "domain_folders": f"WITH {_TREE}, {_NAMED} SELECT domain, id AS folder_id FROM (SELECT DISTINCT source AS domain FROM documents UNION ALL SELECT 'Sans dossier') AS d LEFT JOIN named ON name = domain",
    "folder_counts": "SELECT folder, count(doc_id) AS n_files, count(doc_id) > 0 AS present FROM (SELECT concat('src', i) AS folder FROM range(25) AS t(i)) LEFT JOIN documents ON source = folder GROUP BY folder",
    "missing_required": f"WITH {_sides(C.RAW)} SELECT name, package FROM (VALUES {_values([(f'doc_{i}.txt', f'package{i}') for i in REQUIRED])}) AS e(name, package) ANTI JOIN l USING (name)",
    "json_path_exists": "SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS has_k, json_extract(props, '$.installed.client_id') IS NOT NULL AS has_client FROM events",
    "version_check": f"WITH {_HAVE} SELECT p_partkey, have, need, {_INTS.format('have')} >= {_INTS.format('need')} AS ok FROM v",
    "check_summary": f"WITH c AS (SELECT seq, name, CASE WHEN seq = (SELECT count(*) % 10 FROM documents) THEN 'failed' ELSE 'passed' END AS status FROM (VALUES {_values(list(enumerate(C.CHECKS)))}) AS t(seq, name)), s AS (SELECT count(*) FILTER (WHERE status = 'passed') AS n_passed, count(*) FILTER (WHERE status = 'failed') AS n_failed, coalesce(string_agg(name, ', ' ORDER BY seq) FILTER (WHERE status = 'passed'), '') AS passed, coalesce(string_agg(name, ', ' ORDER BY seq) FILTER (WHERE status = 'failed'), '') AS failed FROM c) SELECT *, round(100.0::DOUBLE * n_passed / (n_passed + n_failed), 1) AS rate, CASE WHEN n_failed = 0 THEN 'ok' WHEN n_failed <= 2 THEN 'warning' ELSE 'failed' END AS verdict FROM s",
    "classify_hits": f"WITH {_HITS} SELECT * FROM hits",
    "classify_best": f"WITH {_BEST} SELECT * FROM best",
    "domain_counts": f"WITH {_BEST} SELECT domain, count(*) AS n_docs FROM best GROUP BY domain",
    "synthesis_top20": f"WITH {_SCORES} SELECT domain, CAST(rank AS INTEGER) AS rank, doc_id, score, n >= 5 AS enough FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY domain) AS n FROM scores) WHERE rank <= 20",
    "batch_assign": "SELECT doc_id, CAST(ceil(row_number() OVER (ORDER BY doc_id) / 50.0) AS BIGINT) AS batch FROM documents",
    "corpus_metrics": f"SELECT source, count(*) AS n_docs, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, avg(strlen(text)) AS mean_bytes, count(*) FILTER (WHERE strlen(text) <= {C.MOST_OCR_BYTES}) AS n_ocr FROM documents GROUP BY source",
    "watch_snapshots": f"WITH l AS ({_ALL.format(c=C.RAW)}), r AS ({_R.format(c=C.RAW)}) SELECT CASE WHEN r.name IS NULL THEN 'created' ELSE 'modified' END AS event_type, l.name AS src_path FROM l LEFT JOIN r USING (name) WHERE r.name IS NULL OR l.hash IS DISTINCT FROM r.md5Checksum",
    "watch_created": "SELECT 'created' AS event_type, concat(source, '/doc_', doc_id, '.txt') AS src_path, CAST(strlen(text) AS BIGINT) AS length FROM documents WHERE strlen(text) > 0",
    "stream_documents": "SELECT concat('doc_', doc_id, '.txt') AS name, CAST(strlen(text) AS BIGINT) AS size FROM documents",
    "event_counts": "SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "similar_pairs": f"WITH RECURSIVE {_SETS} SELECT a AS doc_id, class_id, count(*) AS n_links FROM links JOIN classes ON id = a GROUP BY ALL",
    "inventory_allowed": "SELECT concat('doc_', doc_id, ext) AS name, CAST(strlen(text) AS BIGINT) AS size FROM (SELECT doc_id, text, ['.txt', '.PDF', '.exe', '.md', ''][doc_id % 5 + 1] AS ext FROM documents) WHERE lower(ext) IN ('.pdf', '.docx', '.txt', '.md', '.json') AND strlen(text) <= 5000",
    "name_sets": f"{_LC} SELECT container, name, 'local' AS side FROM (SELECT container, name FROM l EXCEPT SELECT container, name FROM r) UNION ALL SELECT container, name, 'remote' FROM (SELECT container, name FROM r EXCEPT SELECT container, name FROM l) UNION ALL SELECT container, name, 'both' FROM (SELECT container, name FROM l INTERSECT SELECT container, name FROM r)",
    "sync_executed": f"SELECT '{C.RAW}' AS container, concat('doc_', doc_id, '.txt') AS name, CASE WHEN doc_id % 10 = 3 THEN 'DOWNLOAD' WHEN doc_id % 10 = 5 THEN 'UPLOAD' WHEN doc_id % 7 = 0 THEN 'UPDATE' ELSE 'NOOP' END AS action, true AS ok, 'NOOP' AS after FROM documents",
    "config_sections": "SELECT section, section = 'corpus_domains' AND EXISTS (SELECT 1 FROM documents) AS present FROM (VALUES ('system'), ('google_drive'), ('corpus_domains')) AS t(section)",
    "provision_plan": f"""WITH RECURSIVE {_TREE}, {_WALK.format(" AND path <> 'Corpus/fr'", " WHERE a.path <> 'Corpus/fr'")},
h AS (SELECT DISTINCT concat('Corpus/', lang, '/', source, '/part', doc_id % 4) AS path FROM documents WHERE doc_id % 4 = 0)
SELECT a.path, a.name, a.parent_path, t.depth, CASE WHEN a.path = 'Corpus/fr' THEN 'FAILED' WHEN t.path IS NULL THEN 'SKIPPED' WHEN h.path IS NOT NULL THEN 'EXISTS' ELSE 'CREATE' END AS action
FROM a LEFT JOIN t ON t.path = a.path LEFT JOIN h ON h.path = a.path""",
    "found_required": f"WITH {_sides(C.RAW)} SELECT name, package FROM (VALUES {_values([(f'doc_{i}.txt', f'package{i}') for i in REQUIRED])}) AS e(name, package) SEMI JOIN l USING (name)",
    "version_least": f"WITH {_HAVE} SELECT p_brand, arg_min(have, struct_pack(a := {_INTS.format('have')}, b := have)) AS least FROM v GROUP BY p_brand",
    "scalar_functions": f"""SELECT doc_id, concat('doc_', doc_id, '.txt') AS base, strftime({_SCAN}, '%Y-%m-%dT%H:%M:%S') AS iso, strftime({_SCAN}, '%Y-%m-%d %H:%M:%S') AS stamp, strftime({_SCAN}, '%Y%m%d') AS day,
concat(source, '.', doc_id) AS cut, coalesce(contains(text, 'the '), false) AS holds, '=====' AS rule, CASE lang WHEN 'fr' THEN 'français' WHEN 'en' THEN 'english' ELSE '?' END AS language,
concat(CASE WHEN doc_id % 2 = 0 THEN concat(source, '/') ELSE '' END, 'doc_', doc_id, '.txt') AS path, '.txt' AS ext, round(1.0::DOUBLE - levenshtein(lang, source)::DOUBLE / greatest(length(lang), length(source), 1), 6) AS alike FROM documents""",
    "sync_frequency": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL",
    "document_clusters": f"""WITH RECURSIVE {_SETS}, c AS (SELECT d.id, copies, coalesce(class_id, d.id) AS cluster FROM d LEFT JOIN classes ON classes.id = d.id WHERE len(w) > 0),
r AS (SELECT x.cluster, count(DISTINCT y.cluster) AS n_related FROM near JOIN c AS x ON x.id = a JOIN c AS y ON y.id = b WHERE 10 * common >= 7 * total AND x.cluster <> y.cluster GROUP BY 1),
g AS (SELECT cluster, count(*) AS n_texts, CAST(sum(copies) AS BIGINT) AS n_docs FROM c GROUP BY cluster)
SELECT CAST(row_number() OVER (ORDER BY n_docs DESC, cluster) AS INTEGER) AS rank, cluster, n_texts, n_docs, coalesce(n_related, 0) AS n_related FROM g LEFT JOIN r USING (cluster) ORDER BY rank LIMIT 10""",
    "semantic_search": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "theme_relations": f"WITH {_HITS}, o AS (SELECT DISTINCT doc_id, domain FROM hits) SELECT x.domain AS domain_a, y.domain AS domain_b, count(*) AS n_docs FROM o AS x JOIN o AS y ON x.doc_id = y.doc_id AND x.domain < y.domain GROUP BY ALL",
}
