from __future__ import annotations

import io
import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec import schemas
from lexivec.functions import integrity
from lexivec.operators import dataset, pages, search
from lexivec.operators.embed import HashingEmbedder
from lexivec.service import BadRequest, Service, authorized
from lexivec.settings import Settings
from lexivec.sources import discovery, files, index
from lexivec.streaming import ingest


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_scans(spark, tmp_path):
    arr = write(tmp_path / "a.json", json.dumps([{"qid": "Q1", "label_en": "x"}, {"qid": "Q2"}]))
    assert [r.qid for r in files.records(spark, arr).collect()] == ["Q1", "Q2"]
    lines = write(tmp_path / "a.jsonl", '{"qid": "Q1"}\n\n{"qid": "Q2"}\n')
    assert files.records(spark, lines).count() == 2
    bad = write(tmp_path / "b.jsonl", '{"qid": "Q1"}\n[1]\nnope\n')
    with pytest.raises(Exception):
        files.records(spark, bad).collect()
    errors = files.checked_lines(spark, bad, schemas.RAW_RECORD).where("error is not null").collect()
    assert sorted(r.line for r in errors) == [2, 3]
    assert files.resumed(spark, str(tmp_path / "none.jsonl"), schemas.PROVENANCE).count() == 0
    assert [r.qid for r in files.resumed(spark, lines, schemas.RAW_RECORD).orderBy("qid").collect()] == ["Q1", "Q2"]
    with pytest.raises(Exception, match=r"b.jsonl:2:not a JSON object|b.jsonl:3:not a JSON object"):
        files.resumed(spark, bad, schemas.RAW_RECORD).collect()


def test_line_numbers_across_blocks(spark, tmp_path):
    for name in ("a", "b"):
        write(tmp_path / f"{name}.txt", "".join(f"{name} {i} {'x' * (i % 50)}\n" + "\n" * (i % 7 == 0) for i in range(1, 3000)))
    want = {(f"{n}.txt", i, line) for n in "ab" for i, line in enumerate((tmp_path / f"{n}.txt").read_text().split("\n")[:-1], 1)}
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = files.numbered_lines(spark, f"{tmp_path}/*.txt")
        assert df.rdd.getNumPartitions() > 1
        assert {(r.file.rsplit("/", 1)[1], r.line, r.text) for r in df.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_golden_suite(spark, tmp_path):
    case = {"id": "c1", "query": "q", "language": "en", "expected_qids": ["Q1"], "category": "x"}
    good = write(tmp_path / "s.json", json.dumps([{"version": "1", "cases": [case]}]))
    assert files.golden_suite(spark, good).first().top_k == 10
    for name, cases in (("two", [case, case]), ("none", []), ("empty", [{**case, "expected_qids": []}]), ("low", [{**case, "top_k": 0}])):
        path = write(tmp_path / f"{name}.json", json.dumps([{"version": "1", "cases": cases}]))
        with pytest.raises(ValueError):
            files.golden_suite(spark, path)


def test_matrix_results(spark, tmp_path):
    one = {"case_id": "a", "worker_count": 1, "latency_ms": {"p95": 1.5}}
    assert files.matrix_results(spark, write(tmp_path / "r.jsonl", json.dumps(one) + "\n")).first().latency_ms.p95 == 1.5
    assert files.matrix_results(spark, write(tmp_path / "l.json", json.dumps([one, one]))).count() == 2
    assert files.matrix_results(spark, write(tmp_path / "o.json", json.dumps({"results": [one]}))).count() == 1
    folder = tmp_path / "cases"
    folder.mkdir()
    write(folder / "1.json", json.dumps(one))
    write(folder / "2.json", json.dumps({"other": 1}))
    write(folder / "0.json", json.dumps({**one, "case_id": "z"}))
    assert [(r.case_id, r.ordinal) for r in files.matrix_results(spark, str(folder)).orderBy("ordinal").collect()] == [("z", 1), ("a", 2)]


def test_checksums_and_trees(spark, tmp_path):
    data = tmp_path / "d"
    data.mkdir()
    write(data / "a.txt", "hello")
    write(data / "b.txt", "world")
    dataset.write_checksums(str(data))
    listed = files.checksums(spark, str(data / "SHA256SUMS"))
    have = files.tree(spark, str(data), "*.txt")
    assert files.checksum_mismatches(listed, have).count() == 0
    write(data / "b.txt", "tampered")
    (data / "c.txt").write_text("new")
    got = {r.name: r.problem for r in files.checksum_mismatches(listed, files.tree(spark, str(data), "*.txt")).collect()}
    assert got == {"b.txt": "differs", "c.txt": "not listed"}
    for row in ("abc", "abc  d/e"):
        with pytest.raises(Exception, match="checksum"):
            files.checksums(spark, write(tmp_path / "bad", row)).collect()


def test_archives_and_scan(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/__pycache__/m.pyc", "")
        z.writestr("log.txt", "Authorization: Bearer abcdefgh12345")
        z.writestr("doc.md", "Authorization: Bearer abcdefgh12345")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("api-key.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"ok"))
    members = files.members(spark, str(tmp_path)).withColumn("text", F.decode("content", "utf-8"))
    got = {(r.member, r.kind, r.reason) for r in integrity.scan_members(members).collect()}
    assert got == {
        ("x/__pycache__/m.pyc", "cache", "cache member"), ("log.txt", "secret", "Authorization: Bearer"), ("api-key.txt", "secret", "api-key"),
    }
    ev = spark.createDataFrame([("a", '"username": "u", "key": "k"'), ("b", "ghp_x"), ("SHA256SUMS", "ghp_x"), ("c", None)], "member string, text string")
    assert {(r.member, r.reason) for r in integrity.scan_evidence(ev).collect()} == {("a", "credential JSON"), ("b", "access token pattern")}


def test_hashes(spark, tmp_path):
    assert integrity.fingerprint({"b": 1, "a": "ấ"}) == integrity.fingerprint({"a": "ấ", "b": 1})
    df = spark.createDataFrame([("ấ", 1, {"b": "1", "a": "2"})], "b string, a int, m map<string,string>")
    r = df.select(
        integrity.json_hash("b", "a").alias("h"), integrity.map_fingerprint(F.col("m")).alias("m"),
        integrity.allowed(F.col("m"), ("a",)).alias("k"), integrity.holds(F.lit(b"xsecretx"), "secret").alias("s"), integrity.holds(F.lit(b"x"), "").alias("n"),
    ).first()
    assert r.h == integrity.fingerprint({"a": 1, "b": "ấ"}) and r.m == integrity.fingerprint({"a": "2", "b": "1"})
    assert r.k == {"a": "2"} and r.s and not r.n
    config, weights = tmp_path / "config.json", tmp_path / "w.bin"
    config.write_text("{}")
    weights.write_bytes(b"12")
    before = integrity.model_fingerprint([weights, config])
    weights.write_bytes(b"34")
    assert integrity.model_fingerprint([config, weights]) == before
    config.write_text("[]")
    assert integrity.model_fingerprint([config, weights]) != before


def test_exact_search(spark):
    df = spark.createDataFrame([("Q1", [1.0, 0.0]), ("Q2", [0.0, 1.0]), ("Q3", [0.8, 0.2])], "qid string, embedding array<float>")
    q = F.array(F.lit(1.0), F.lit(0.0))
    assert [r.qid for r in search.top_k(df, q, 2, "qid", "embedding").orderBy("rank").collect()] == ["Q1", "Q3"]
    assert search.top_k(df.limit(1), q, 100, "qid", "embedding").count() == 1
    with pytest.raises(ValueError):
        search.top_k(df, q, 0, "qid", "embedding")
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(300)] + [(300, None), (301, [1.0])]
    rows += [(1000 + i, rows[0][1]) for i in range(20)]  # ties
    big = spark.createDataFrame(rows, "id bigint, v array<float>").repartition(5)
    got: dict[int, list] = {}
    for r in search.search_all(big, big.where("id < 40"), 5, "id", "v", 8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    own = [(i, np.array(v)) for i, v in rows if v is not None and len(v) == 8]
    ids = np.array([i for i, _ in own])
    m = np.array([v / np.linalg.norm(v) for _, v in own])
    for i in range(40):
        s = np.round(m @ m[i], 12)
        s[i] = -2
        assert got[i] == ids[np.lexsort((ids, -s))][:5].tolist()
    search.QUERY_BYTES, keep = 8 * 8 * 7, search.QUERY_BYTES
    try:
        again = search.search_all(big, big.where("id < 40"), 5, "id", "v", 8)
        assert {(r.query_id, r["rank"], r.id) for r in again.collect()} == {(q, n + 1, i) for q, r in got.items() for n, i in enumerate(r)}
    finally:
        search.QUERY_BYTES = keep


def test_index_and_service(spark, tmp_path):
    def embedder():
        return HashingEmbedder(64)

    docs = spark.createDataFrame(
        [("Q1", "river bridge.", None), ("Q2", None, "cầu đá."), ("Q3", "old orchard.", "vườn.")], "qid string, document_en string, document_vi string"
    )
    path = str(tmp_path / "ix")
    meta = index.build(docs, path, embedder, "fp", "sha", 64)
    assert meta["row_count"] == 3
    rows = index.load(spark, path, meta)
    for key, other in (("model_fingerprint", "x"), ("dimensions", 32), ("dataset_sha256", "y"), ("row_count", 9)):
        with pytest.raises(index.IndexMismatch, match=key):
            index.load(spark, path, {**meta, key: other})
    settings = Settings.from_env({"API_KEY": "k", "EMBEDDING_DIMENSIONS": "64", "QUERY_INSTRUCTION": ""})
    service = Service(spark, settings, embedder, "fp", rows)
    hits = service.search("old orchard", 2).orderBy("rank").collect()
    assert hits[0].qid == "Q3" and len(hits) == 2 and service.search("x", 5, "vi").count() == 3
    for bad in (("", 5, None), ("x", 0, None), ("x", 101, None), ("x", 5, "de")):
        with pytest.raises(BadRequest):
            service.search(*bad)
    items = spark.createDataFrame([("r", 0, " old  orchard "), ("r", 1, "river"), ("s", 0, "\x01")], "request_id string, item_index int, text string")
    got = {r.request_id: r for r in service.embed_requests(items, 32).collect()}
    assert got["r"].status == 200 and len(json.loads(got["r"].body)["data"]) == 2
    assert got["s"].status == 422 and got["s"].body is None
    assert authorized("/v1/search", "Bearer k", settings) and not authorized("/v1/search", "Bearer x", settings)
    assert authorized("/health", None, settings) and not authorized("/v1/search", None, settings)
    assert service.ready() == {"ready": True} and service.health() and service.info()["dimensions"] == 64
    with pytest.raises(ValueError):
        index.build(docs.limit(0), str(tmp_path / "e"), embedder, "fp", "sha", 64)
    out = dataset.package_index(path, str(tmp_path / "pack"), "index")
    assert out["row_count"] == 3
    (tmp_path / "pack" / "index-metadata.json").write_text("{}")
    with pytest.raises(ValueError):
        dataset.validated_artifact(str(tmp_path / "pack"), "index")
    assert dataset.resolved(str(tmp_path), "manifest.json").endswith("pack")


def test_settings():
    assert Settings.from_env({}).max_batch_items == 16
    with pytest.raises(ValueError):
        Settings.from_env({"EXPOSE_MODE": "cloudflare-quick"})
    with pytest.raises(ValueError):
        Settings.from_env({"EXPOSE_MODE": "other"})


def test_discovery(spark):
    class Offline(discovery.DiscoverySource):
        @staticmethod
        def transport(url, params):
            offset = int(params["query"].rsplit("OFFSET ", 1)[1])
            ids = [f"http://x/Q{offset + i + 1}" for i in range(2)] + ["http://x/L5"]
            return {"results": {"bindings": [{"item": {"value": v}} for v in ids]}}

    spark.dataSource.register(Offline)
    df = spark.read.format("discovery").options(seed="Q5", pages="2", page_size="10").load()
    got = [(r.page_offset, r.item_pos, r.qid) for r in discovery.listed(df).collect()]
    assert sorted(got) == [(0, 0, "Q1"), (0, 1, "Q2"), (10, 0, "Q11"), (10, 1, "Q12")]
    odd = spark.createDataFrame([("Q5", 0, "{}"), ("Q5", 1, "no"), ("Q5", 2, None), ("Q5", 3, '{"results": {"bindings": [null, {"item": {}}, {"item": {"value": "Q7"}}]}}')], df.schema)
    assert [(r.page_offset, r.item_pos, r.qid) for r in discovery.listed(odd).collect()] == [(3, 0, "Q7")]
    for bad in (("x", 0, 1), ("Q1", -1, 1), ("Q1", 0, 1001)):
        with pytest.raises(ValueError):
            discovery.page_query(*bad)
    asked = []

    def transport(url, params):
        asked.append(params)
        return {"entities": [{"id": "Q2"}, {"id": "Q1", "n": "ấ"}, {"id": "Q3", "missing": True}]}

    body = discovery.entity_body(["Q1", "Q2", "Q3", "Q4"], transport, "")
    assert asked[0]["ids"] == "Q1|Q2|Q3|Q4" and asked[0]["maxlag"] == "5" and asked[0]["props"].startswith("labels|")
    by_id = '{"entities": {"Q1": {"id": "Q1"}, "Q9": {"missing": true}}}'
    rows = [(["Q1", "Q2", "Q3", "Q4"], body), (["Q9", "Q1"], by_id), (["Q1"], "{}"), (["Q1"], None), ([], body)]
    df = spark.createDataFrame(rows, "ids array<string>, body string").select(discovery.in_order(F.col("ids"), F.col("body")).alias("e"))
    assert [[json.loads(e)["id"] for e in r.e or []] for r in df.collect()] == [["Q1", "Q2"], ["Q1"], [], [], []]
    with pytest.raises(ValueError):
        discovery.entity_body([f"Q{i}" for i in range(1, 52)], transport, "")
    with pytest.raises(ValueError):
        discovery.entity_body(["x"], transport, "")


def test_paced_requests():
    waits, script = [], [discovery.HttpStatus(429, 7.0), OSError("net"), {"error": {"code": "maxlag"}}, {"ok": 1}]

    def get(url, params):
        step = script.pop(0)
        if isinstance(step, Exception):
            raise step
        return step

    assert discovery.Paced(get, sleep=waits.append, clock=lambda: 0.0)("u", {}) == {"ok": 1} and waits == [7.0, 2.0, 4.0]
    script[:] = [discovery.HttpStatus(404)]
    with pytest.raises(discovery.HttpStatus):
        discovery.Paced(get, sleep=waits.append)("u", {})
    script[:] = [OSError()] * 2
    with pytest.raises(RuntimeError):
        discovery.Paced(get, attempts=2, sleep=waits.append)("u", {})
    # an interval is kept between successful requests too
    waits.clear()
    script[:] = [{"a": 1}, {"a": 2}, [1], {"a": 3}]
    slow = discovery.Paced(get, least=0.5, sleep=waits.append, clock=lambda: 10.0)
    assert [slow("u", {})["a"] for _ in range(3)] == [1, 2, 3] and waits == [0.5, 0.5, 1.0, 0.5]


def test_streaming_append_and_dedup(spark, tmp_path):
    schema = "record_id bigint, qid string, fetched_at timestamp, ingested_at timestamp"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = "timestamp'2024-01-01 00:00:00'"

    def deliver(rows):
        df = spark.createDataFrame(rows, "record_id bigint, qid string")
        df.selectExpr("record_id", "qid", f"{t} as fetched_at", f"{t} + make_interval(0,0,0,record_id) as ingested_at").coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = ingest.arriving(spark, src, spark.read.parquet(src).schema)
        ingest.append_unseen(stream, out, str(tmp_path / "cp")).awaitTermination()
        return sorted((r.qid, r.record_id) for r in spark.read.parquet(out).collect())

    deliver([(1, "Q1"), (2, "Q1"), (3, "Q2"), (4, None)])
    assert run() == [("Q1", 1), ("Q2", 3)]
    deliver([(5, "Q2"), (6, "Q3")])
    assert run() == [("Q1", 1), ("Q2", 3), ("Q3", 6)]
    assert schema


def test_streaming_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", f"2024-01-0{d} 0{h}:00:00", f"2024-01-0{min(9, d + late)} 0{h}:00:00") for d, h, late in ((1, 1, 0), (1, 2, 3), (2, 1, 0), (8, 0, 0))]
    df = spark.createDataFrame(rows, "source string, f string, i string").selectExpr("source", "cast(f as timestamp) fetched_at", "cast(i as timestamp) ingested_at")
    df.coalesce(1).write.parquet(src)
    stream = ingest.arriving(spark, src, df.schema)
    counted = ingest.arrivals_per_window(stream, "fetched_at", "source", "1 day", "1 day")
    q = counted.writeStream.outputMode("append").format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.start), r.n, r.late) for r in spark.table("arrivals").collect()) == [("2024-01-01 00:00:00", 2, 1), ("2024-01-02 00:00:00", 1, 0)]
    once = ingest.once_within(stream, ["source"], "fetched_at", "30 days")
    q = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 1


def test_pages_links_and_messages(spark):
    rows = [
        ("docs/a.md", "x Language / Ngôn ngữ [v](a.vi.md) [m](mailto:x@y) [w](https://x) ![i](none.png) [h](#top)"), ("docs/a.vi.md", None), ("docs/b.md", "[up](../README.md#x) [no](sub/./c.md) [out](../../x)"),
        ("README.md", "[d](docs/b.md) [d](docs/b.md) [abs](/etc)"), ("LICENSE", "Language / Ngôn ngữ"), (None, "[x](y)"), ("docs/a.md", ""),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumns({c: F.lit(1) for c in ("peer", "leads", "raw", "target", "to")})
    got = {r.path: r.problem for r in pages.unpaired(df).collect()}
    assert got == {"docs/a.vi.md": "missing language switch", "docs/b.md": "missing counterpart", "README.md": "missing counterpart", "LICENSE": "missing counterpart"}
    links = {(r.path, r.target, r.problem) for r in pages.broken_links(df.where("path is not null"), df.select("path")).collect()}
    assert links == {("docs/b.md", "sub/./c.md", "missing"), ("docs/b.md", "../../x", "outside"), ("README.md", "/etc", "outside")}
    assert pages.unpaired(df.limit(0)).count() == 0 and pages.broken_links(df.limit(0), df).count() == 0
    messages = ["Subject\n\n- one\n- two\n- \n", " \n- a\n- b", "Only\n- a", "", None, "S\r\n- a\r\n- b\r\n"]
    m = spark.createDataFrame([(i, x) for i, x in enumerate(messages)], "i int, m string")
    forms = {r.i: (r.f.bullets, r.f.valid) for r in m.select("i", pages.message_form(F.col("m")).alias("f")).collect()}
    assert forms == {0: (2, True), 1: (2, False), 2: (1, False), 3: (0, False), 4: (0, False), 5: (2, True)}


def test_archive_and_telemetry(spark, tmp_path):
    folder = tmp_path / "run"
    (folder / "in").mkdir(parents=True)
    write(folder / "b.txt", "b")
    write(folder / "in" / "a.txt", "ấ")
    first = dataset.write_archive(str(folder), str(tmp_path / "x.tar.gz"))
    assert (tmp_path / "x.tar.gz.sha256").read_text() == f"{first}  x.tar.gz\n" and first == dataset.write_archive(str(folder), str(tmp_path / "y.tar.gz"))
    got = {r.member: r.content.decode() for r in files.members(spark, str(tmp_path / "x.tar.gz")).collect()}
    assert got == {"run/b.txt": "b", "run/in/a.txt": "ấ"}
    path = write(tmp_path / "gpu.csv", "ts, used\n1, 10\n2, none\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("ts", T.IntegerType()), T.StructField("used", T.IntegerType())])
    assert sorted(map(tuple, files.telemetry(spark, path, schema).collect())) == [(1, 10), (2, None)]
