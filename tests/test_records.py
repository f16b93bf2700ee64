from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from lexivec import schemas
from lexivec.operators import acquire, dataset, records
from lexivec.sources import files

BERLIN = ("Q64", " Berlin ", None, "capital and largest city of Germany", None, ["Berlin", "Berlin", "City of Berlin"], [], ["Q515", " Q515", ""])


def raw(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in schemas.RAW_RECORD.fields))


def row(**k):
    names = [f.name for f in schemas.RAW_RECORD.fields]
    return tuple(k.get(n) for n in names)


def test_canonical_record(spark):
    r = records.canonicalize(raw(spark, BERLIN)).first()
    assert r.reject_reason is None and r.label_en == "Berlin" and r.aliases_en == ["Berlin", "City of Berlin"]
    assert r.document_en == "Berlin. capital and largest city of Germany. Aliases: Berlin; City of Berlin."
    assert r.document_vi is None and r.instance_of_qids == ["Q515"] and r.quality_flags == []


def test_rejections_in_order(spark):
    df = raw(
        spark,
        row(qid="Q1", label_en=" ", label_vi=None),
        row(qid="Q2", label_en="FranÃ§ois"),
        row(qid="Q3", label_en="a�", label_vi="b\x01"),
        row(qid=" Q4 ", label_vi="b\x01"),
        row(label_en="x", aliases_en=["ok", None]),
        row(),
    )
    got = {r.n: r for r in records.canonicalize(df, ("n",)).collect()}
    assert got[0].reject_reason == "missing_usable_label"
    assert got[1].quality_flags == ["suspicious_mojibake"] and got[1].label_en == "FranÃ§ois"
    assert got[2].reject_reason == "unicode_quality:U+FFFD replacement character is not allowed"
    assert got[3].reject_reason == "unicode_quality:disallowed control character U+0001" and got[3].qid == "Q4"
    assert got[4].reject_reason.endswith("decoded as UTF-8")
    assert got[5].reject_reason == "missing_usable_label" and got[5].qid is None
    counts = {r.reason: r.n for r in records.reject_counts(records.canonicalize(df)).collect()}
    assert counts["missing_usable_label"] == 2
    assert records.flag_counts(records.accepted(records.canonicalize(df))).first().n == 1


def test_empty_table_and_extra_columns(spark):
    empty = raw(spark, BERLIN).limit(0)
    assert records.canonicalize(empty).count() == 0
    clash = raw(spark, BERLIN).withColumn("_error", F.lit("x")).withColumn("reject_reason", F.lit("y"))
    assert records.canonicalize(clash).first().reject_reason is None


ENTITY = {
    "id": " Q64 ",
    "labels": {"en": {"language": "en", "value": "Berlin"}, "vi": {"language": "vi", "value": " "}, "de": {"language": "de", "value": "x"}},
    "descriptions": {},
    "aliases": {"en": [{"language": "en", "value": v} for v in ("B", "B", " ", "C")]},
    "claims": {
        "P31": [
            {"rank": "normal", "mainsnak": {"snaktype": "value", "datavalue": {"value": {"id": "Q515"}}}},
            {"rank": "deprecated", "mainsnak": {"snaktype": "value", "datavalue": {"value": {"id": "Q1"}}}},
            {"rank": "normal", "mainsnak": {"snaktype": "novalue"}},
            {"rank": "normal", "mainsnak": {"snaktype": "value", "datavalue": {"value": {"id": "L1"}}}},
        ]
    },
}


def test_entities(spark):
    df = spark.createDataFrame([(json.dumps(ENTITY),), (json.dumps({"id": "P5"}),)], "j string")
    good, bad = records.from_entities(df.select(F.from_json("j", schemas.ENTITY).alias("e")).select("e.*")).collect()
    assert (good.qid, good.label_en, good.label_vi, good.aliases_en) == ("Q64", "Berlin", None, ["B", "C"])
    assert good.instance_of_qids == ["Q515"] and good.error is None and good.description_en is None
    assert bad.qid is None and bad.error == "invalid entity id"


def test_orders_and_limits(spark):
    q = spark.createDataFrame([("Q10",), ("Q9",), ("x",), ("Q0",)], "qid string")
    assert [r.qid for r in q.orderBy(records.qid_number("qid"), "qid").collect()] == ["Q9", "Q10", "Q0", "x"]
    df = raw(spark, *[row(qid=f"Q{i}", label_en="a" if i % 2 else None) for i in range(1, 11)])
    c = records.canonicalize(df, ("n",))
    assert [r.qid for r in records.first_accepted(c, 2, "n").collect()] == ["Q1", "Q3"]
    assert records.scanned_until(c, 2, "n").first().scanned == 3
    assert records.scanned_until(c, 99, "n").first().scanned == 10


def test_build(spark, tmp_path):
    df = raw(spark, BERLIN, row(qid="Q2", label_en="FranÃ§ois"), row(qid="Q3"))
    report = dataset.build(df.drop("n"), str(tmp_path), "in.json")
    assert (report["scanned_rows"], report["accepted_rows"], report["rejected_rows"]) == (3, 2, 1)
    assert report["flag_counts"] == {"suspicious_mojibake": 1} and report["null_rates"]["label_vi"] == 1.0
    with open(tmp_path / "SHA256SUMS") as f:
        assert any("data-quality-report.json" in line for line in f)
    assert [r.qid for r in spark.read.parquet(str(tmp_path / dataset.CANONICAL_NAME)).collect()] == ["Q2", "Q64"]
    limited = dataset.build(df, str(tmp_path / "two"), "in.json", 1, "n")
    assert (limited["scanned_rows"], limited["accepted_rows"]) == (1, 1)
    manifest = dataset.run_manifest(str(tmp_path), "r", "smoke", {"a": 1})
    assert "run-manifest.json" not in manifest["files"]
    with pytest.raises(ValueError):
        dataset.run_manifest(str(tmp_path), "r", "", {})


def pages(spark, rows):
    return spark.createDataFrame(
        rows, "seed_name string, seed_qid string, page_offset long, item_pos int, qid string, discovered_at timestamp, ingested_at timestamp"
    )


def test_discovery_quota_provenance(spark):
    rows = [("city", "Q515", 0, i, q, None, None) for i, q in enumerate(["Q1", "Q2", "Q2", " Q3 ", "bad", None])]
    rows += [("human", "Q5", 0, 0, "Q2", None, None), ("human", "Q5", 0, 0, "Q2", None, None)]
    found = acquire.discovered(pages(spark, rows))
    assert found.count() == 5
    assert {(r.seed_name, r.qids) for r in acquire.attributed(found).collect()} == {("city", 3), ("human", 1)}
    p = {r.qid: r for r in acquire.provenance(found).collect()}
    assert p["Q2"].seed_names == ["city", "human"] and p["Q2"].seed_instance_of_qids == ["Q5", "Q515"]
    seeds = spark.createDataFrame([("city", "Q515", 3), ("human", "Q5", 1)], "seed_name string, instance_of_qid string, weight int")
    quotas = acquire.quotas(seeds, 2, 1.0)
    assert {r.seed_name: r.quota for r in quotas.collect()} == {"city": 2, "human": 1}
    kept = acquire.within_quota(found, quotas)
    assert {(r.seed_name, r.qid) for r in kept.collect()} == {("city", "Q1"), ("city", "Q2"), ("human", "Q2")}
    fetched = spark.createDataFrame([("Q1",), (None,)], "qid string")
    assert {r.qid for r in acquire.unseen(found.select("qid").distinct(), fetched).collect()} == {"Q2", "Q3"}


def test_zero_weights_raise(spark):
    seeds = spark.createDataFrame([("a", "Q1", 0)], "seed_name string, instance_of_qid string, weight int")
    with pytest.raises(Exception, match="positive"):
        acquire.quotas(seeds, 2, 1.0).collect()


def test_stop_at_target_completes_batches(spark):
    df = spark.createDataFrame([(i // 3, i % 2 == 0, i) for i in range(12)], "batch int, is_accepted boolean, i int")
    assert sorted(r.i for r in acquire.stop_at_target(df, 3).collect()) == list(range(6))


def test_crawl_resumes_and_spills_over(spark, tmp_path):
    calls = []
    listed = {"Q515": ["Q1", "Q2", "Q3"], "Q5": ["Q2", "Q4", "Q6"]}

    def discover(seed, offset, limit):
        calls.append((seed, offset, limit))
        return listed[seed][offset : offset + limit]

    def fetch(ids):
        return [{"id": i, "labels": {"en": {"language": "en", "value": i}} if i != "Q3" else {}} for i in ids]

    seeds = [("city", "Q515", 1), ("human", "Q5", 1)]
    out = str(tmp_path)
    state = acquire.crawl(spark, seeds, discover, fetch, out, target_rows=3, overfetch=1.0, page_size=2)
    assert state.accepted_rows >= 3 and ("Q515", 0, 2) in calls
    n = len(calls)
    again = acquire.crawl(spark, seeds, discover, fetch, out, target_rows=3, overfetch=1.0, page_size=2)
    assert len(calls) == n and again.accepted_rows == state.accepted_rows
    ids = [r.qid for r in spark.read.parquet(f"{out}/entities.parquet").collect()]
    assert len(ids) == len(set(ids))
    with pytest.raises(acquire.AcquisitionShortfall):
        acquire.crawl(spark, seeds, discover, fetch, out, target_rows=50, page_size=2)
    batches = []

    def counted(ids):
        batches.append(len(ids))
        return fetch(ids)

    more = {"Q1": [f"Q{i}" for i in range(1, 301)]}
    state = acquire.crawl(spark, [("x", "Q1", 1)], lambda s, o, n: more[s][o : o + n], counted, f"{out}/b", target_rows=120, overfetch=2.0, page_size=200)
    assert batches == [50, 50, 50] and state.accepted_rows == 149  # it ends with the batch that reaches the target
    dataset.write_provenance(spark.read.parquet(f"{out}/pages.parquet").withColumn("ingested_at", F.lit(None).cast("timestamp")).withColumn("discovered_at", F.lit(None).cast("timestamp")), f"{out}/prov")
    assert files.json_lines(spark, f"{out}/prov", schemas.PROVENANCE).count() >= 3


def test_state_and_agent(tmp_path):
    path = os.path.join(tmp_path, "s.json")
    assert acquire.State.load(path) == acquire.State()
    with open(path, "w") as f:
        json.dump({"accepted_rows": 3, "unknown": 1}, f)
    assert acquire.State.load(path).accepted_rows == 3
    assert acquire.checked_user_agent("Reader/1.0 (mailto:a@b.c)")
    for bad in ("", "curl/8 (https://x)", "Reader/1.0 no contact", None):
        with pytest.raises(ValueError):
            acquire.checked_user_agent(bad)


def test_positions_of_the_whole_table(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("n"), (F.col("id") % 3).alias("id"))
    got = records.numbered(df.repartition(7), F.col("n").desc()).collect()
    assert sorted(r.position for r in got) == list(range(1, 5001)) and all(r.position == 5000 - r.n for r in got)
    assert records.numbered(df.limit(0), "n").count() == 0


def test_sorts_give_every_row(spark):
    data = os.path.join("/root/testdata", "sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    from lexivec.plans import texts

    for whole, first in (("x01_canonical_positions", "x01_canonical_order"), ("x02_numeric_positions", "x02_numeric_order")):
        rows = sorted(texts.QUERIES[whole](spark, data).collect(), key=lambda r: r.position)
        assert len(rows) > 250 and [r.position for r in rows] == list(range(1, len(rows) + 1))
        assert [tuple(r)[:-1] for r in rows[:100]] == [tuple(r) for r in texts.QUERIES[first](spark, data).collect()]


def built(spark, folder, rows=3):
    raw = spark.createDataFrame([(f"Q{i}", f"label {i}") for i in range(1, rows + 1)], "qid string, label_en string")
    full = raw.select("qid", "label_en", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.RAW_RECORD.fields if f.name not in ("qid", "label_en")])
    dataset.build(full, str(folder), "in.json")
    return folder


def test_datasets_are_validated_and_resolved(spark, tmp_path):
    root = tmp_path / "input"
    other, named = built(spark, root / "other"), built(spark, root / "deep" / "records-EN-vi")
    manifest = dataset.validated_dataset(str(named), spark)
    assert manifest == dataset.validated_dataset(str(named)) and manifest["content_policy"] and (named / "LICENSE-DATA.md").is_file()
    assert dataset.resolved_dataset(str(root), prefer="records-en-vi") == str(named)
    assert dataset.resolved_dataset(str(root), str(other)) == str(other)
    with pytest.raises(ValueError, match="2 valid"):
        dataset.resolved_dataset(str(root))
    with pytest.raises(ValueError, match="not below"):
        dataset.resolved_dataset(str(root), str(tmp_path))
    part = next((other / dataset.CANONICAL_NAME).glob("*.parquet"))
    keep = part.read_bytes()
    part.write_bytes(b"tampered")
    with pytest.raises(ValueError, match="checksum"):
        dataset.validated_dataset(str(other))
    assert dataset.resolved_dataset(str(root)) == str(named)
    part.write_bytes(keep)
    path = other / dataset.MANIFEST
    for change in ({"source": "x"}, {"source_license": None}, {"canonical_sha256": None}, {"canonical_filename": "none"}):
        path.write_text(json.dumps({**manifest, **change}))
        with pytest.raises(ValueError):
            dataset.validated_dataset(str(other))
    path.write_text("{")
    with pytest.raises(ValueError):
        dataset.validated_dataset(str(other))
    (named / dataset.QUALITY).unlink()
    with pytest.raises(ValueError, match="missing"):
        dataset.validated_dataset(str(named))
    with pytest.raises(ValueError, match="0 valid"):
        dataset.resolved_dataset(str(root))


def test_published_metadata(spark, tmp_path):
    folder = built(spark, tmp_path / "d")
    report = json.loads((folder / dataset.QUALITY).read_text())
    raw = tmp_path / "raw.jsonl"
    raw.write_text("{}\n")
    out = dataset.publish_metadata(str(folder), {"page_size": 5}, [{"name": "x"}], [str(raw)], 3, report, "A title", "me/things", spark)
    assert out["canonical_sha256"] and out["acquisition"]["raw_files"]["raw.jsonl"]["sha256"] and out["source_license"] == "CC0-1.0"
    assert json.loads((folder / "dataset-metadata.json").read_text()) == {"id": "me/things", "licenses": [{"name": "CC0-1.0"}], "title": "A title"}
    assert "provenance-metadata.json" in (folder / dataset.CHECKSUMS).read_text()
    for bad in ({"expected_rows": 4}, {"title": " "}, {"identifier": "me/"}):
        with pytest.raises(ValueError):
            dataset.publish_metadata(**{"folder": str(folder), "parameters": {}, "seeds": [], "raw_files": [], "expected_rows": 3, "report": report, **bad})
