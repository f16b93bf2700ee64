"""The dataset build: canonical Parquet, quality report, manifest, checksums, provenance."""

from __future__ import annotations

import gzip
import json
import os
import tarfile
from datetime import datetime, timezone
from hashlib import file_digest, sha256

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.operators import acquire, records
from lexivec.session import cut_lineage, read_text, write_text
from lexivec.sources import files

CANONICAL_NAME = "canonical.parquet"
MANIFEST, QUALITY, CHECKSUMS = "dataset-manifest.json", "data-quality-report.json", "SHA256SUMS"
LICENSE = "LICENSE-DATA.md"
LICENSE_TEXT = f"""# Licence of the data

The records are structured data of the source named in `{MANIFEST}` and are published under CC0 1.0
(public domain dedication): https://creativecommons.org/publicdomain/zero/1.0/
"""

# What a manifest says of the records' content.
CONTENT_POLICY = "structured_wikidata_only"
PUBLISHED_POLICY = "structured_wikidata_only_no_wikipedia_article_bodies"
# The keys of reports, manifests and metadata below are fixed names of their formats.


def _hash(path: str) -> str:
    with open(path, "rb") as f:
        return file_digest(f, "sha256").hexdigest()


def _write_json(path: str, value: dict) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def hashes(path: str, spark: SparkSession | None = None) -> dict[str, dict]:
    """``{relative path: {sha256, bytes}}`` of all files below a folder or of one file, sorted.

    With a session the files are hashed where they are read, and only names and hashes come back; names that
    begin with a dot or an underscore are left out then.
    """
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        top = status.getPath() if status.isDirectory() else status.getPath().getParent()
        base = top.toUri().getPath()
        rows = files.with_hashes(files.tree(spark, path)).collect()  # a row for each file of a dataset
        inner = {os.path.relpath(urlparse(r.path).path, base): {"sha256": r.sha256, "bytes": r.bytes} for r in rows}
        return dict(sorted(inner.items()))
    found = [path] if os.path.isfile(path) else sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs)
    base = os.path.dirname(path) if os.path.isfile(path) else path
    return {os.path.relpath(f, base): {"sha256": _hash(f), "bytes": os.path.getsize(f)} for f in found}


def combined(parts: dict[str, dict]) -> str | None:
    """One hash for a file, or for all files of a table by name; None where there is none."""
    if len(parts) < 2:
        return next((v["sha256"] for v in parts.values()), None)
    return sha256("".join(f"{v['sha256']}  {k}\n" for k, v in sorted(parts.items())).encode()).hexdigest()


def write_canonical(accepted: DataFrame, path: str, single_file: bool = False) -> None:
    """Sorted zstd Parquet: range-partitioned files that follow each other, or one file where asked for."""
    ordered = accepted.orderBy(*records.canonical_order())
    (ordered.coalesce(1) if single_file else ordered).write.mode("overwrite").option("compression", "zstd").parquet(path)


def build(raw: DataFrame, out_dir: str, input_name: str, limit: int | None = None, ordinal: str | None = None,
          single_file: bool = False, input_path: str | None = None) -> dict:
    """Write canonical records, the quality report, the manifest and checksums; returns the report.

    With ``limit`` only the first accepted records by ``ordinal`` are kept and scanning ends at the last of
    them.  Records are canonicalised once; all counts come from that table.  With ``input_path`` the manifest has the
    input's hash.
    """
    canonical = records.canonicalize(raw, (ordinal,) if ordinal else ())
    if limit is not None:
        if ordinal is None:
            raise ValueError("a limit needs an ordinal")
        canonical = cut_lineage(canonical)
        last = records.first_accepted(canonical, limit, ordinal).agg(F.max(ordinal), F.count("*")).first()
        if last[1] >= limit:
            canonical = canonical.where(F.col(ordinal) <= last[0])
    else:
        canonical = cut_lineage(canonical)
    accepted = records.accepted(canonical).drop(*([ordinal] if ordinal else []))
    write_canonical(accepted, f"{out_dir}/{CANONICAL_NAME}", single_file)
    stored = raw.sparkSession.read.parquet(f"{out_dir}/{CANONICAL_NAME}")
    columns = tuple(stored.columns)
    reasons = {r.reason: r.n for r in records.reject_counts(canonical).orderBy("reason").collect()}
    kept = stored.count()
    report = {
        "scanned_rows": kept + sum(reasons.values()),
        "accepted_rows": kept,
        "rejected_rows": sum(reasons.values()),
        "rejected_by_reason": reasons,
        "flag_counts": {r.flag: r.n for r in records.flag_counts(stored).orderBy("flag").collect()},
        "null_rates": records.null_rates(stored, columns).first().asDict() if kept else {},
    }
    _write_json(f"{out_dir}/{QUALITY}", report)
    spark = raw.sparkSession
    parts = {k: v for k, v in hashes(f"{out_dir}/{CANONICAL_NAME}", spark).items() if k.endswith(".parquet")}
    manifest = {
        "format_version": 1,
        "source": records.SOURCE,
        "source_license": records.SOURCE_LICENSE,
        "derived_license": records.SOURCE_LICENSE,
        "built_at_utc": datetime.now(timezone.utc).isoformat(),
        "input_filename": input_name,
        "input_sha256": combined(hashes(input_path, spark)) if input_path else None,
        "canonical_filename": CANONICAL_NAME,
        "canonical_sha256": combined(parts),
        "canonical_files": parts,
        "row_count": kept,
        "rejected_row_count": report["rejected_rows"],
        "languages": ["en", "vi"],
        "content_policy": CONTENT_POLICY,
        "null_rates": report["null_rates"],
    }
    _write_json(f"{out_dir}/{MANIFEST}", manifest)
    write_text(f"{out_dir}/{LICENSE}", LICENSE_TEXT)
    write_checksums(out_dir, spark)
    return report


def write_checksums(folder: str, spark: SparkSession | None = None) -> None:
    """``<sha256>  <path>`` of every file but the list itself, sorted."""
    rows = [f"{v['sha256']}  {k}" for k, v in hashes(folder, spark).items() if k != CHECKSUMS and not k.endswith(".crc")]
    write_text(f"{folder}/{CHECKSUMS}", "".join(r + "\n" for r in rows))


def write_provenance(pages: DataFrame, path: str) -> None:
    """Provenance rows as JSON lines in the numeric order of their ids."""
    rows = acquire.provenance(acquire.discovered(pages))
    rows.orderBy(records.qid_number("qid"), "qid").write.mode("overwrite").json(path)


def run_manifest(folder: str, run_id: str, run_kind: str, identity: dict, config: dict | None = None) -> dict:
    """A manifest of all files of a run but itself and the checksum list."""
    if not run_kind:
        raise ValueError("run_kind is required")
    files = {k: v for k, v in hashes(folder).items() if k not in ("run-manifest.json", "SHA256SUMS")}
    manifest = {"schema_version": 2, "run_id": run_id, "run_kind": run_kind, **identity, "runtime_config": config or {}, "files": files}
    _write_json(f"{folder}/run-manifest.json", manifest)
    return manifest


def publish_metadata(folder: str, parameters: dict, seeds: list[dict], raw_files: list[str], expected_rows: int, report: dict,
                     title: str = "dataset", identifier: str = "owner/dataset", spark: SparkSession | None = None) -> dict:
    """Provenance and listing of a published dataset; another number of rows than expected is an error."""
    if report["accepted_rows"] != expected_rows:
        raise ValueError(f"expected {expected_rows} rows, got {report['accepted_rows']}")
    owner, _, slug = (part.strip() for part in identifier.partition("/"))
    if not (title.strip() and owner and slug):
        raise ValueError("title, owner and name must not be empty")
    built = json.loads(read_text(f"{folder}/{MANIFEST}"))
    out = {
        "format_version": 1,
        "source": built["source"],
        "source_license": built["source_license"],
        "derived_license": built["derived_license"],
        "content_policy": PUBLISHED_POLICY,
        "languages": built["languages"],
        "target_rows": expected_rows,
        "canonical_rows": report["accepted_rows"],
        "canonical_filename": built["canonical_filename"],
        "canonical_sha256": built["canonical_sha256"],
        "built_at_utc": datetime.now(timezone.utc).isoformat(),
        "language_null_rates": report["null_rates"],
        "acquisition": {**parameters, "raw_files": {os.path.basename(f): {"sha256": combined(hashes(f, spark))} for f in raw_files}},
        "seed_categories": seeds,
    }
    _write_json(f"{folder}/provenance-metadata.json", out)
    _write_json(f"{folder}/dataset-metadata.json", {"title": title, "id": f"{owner}/{slug}", "licenses": [{"name": built["source_license"]}]})
    write_checksums(folder, spark)
    return out


def validated_dataset(folder: str, spark: SparkSession | None = None) -> dict:
    """The manifest of a built dataset that is complete, of the expected source and licence, and whose data has its hash."""
    for name in (MANIFEST, QUALITY):
        if not os.path.isfile(f"{folder}/{name}"):
            raise ValueError(f"missing {name}: {folder}")
    manifest = json.loads(read_text(f"{folder}/{MANIFEST}"))  # a JSON error is a ValueError
    if (manifest.get("source"), manifest.get("source_license")) != (records.SOURCE, records.SOURCE_LICENSE):
        raise ValueError(f"dataset must declare source {records.SOURCE} and licence {records.SOURCE_LICENSE}")
    name, sha = manifest.get("canonical_filename"), manifest.get("canonical_sha256")
    if not name or not sha:
        raise ValueError("manifest without canonical filename or checksum")
    if not os.path.exists(f"{folder}/{name}"):
        raise ValueError(f"canonical data is missing: {name}")
    have = {k: v for k, v in hashes(f"{folder}/{name}", spark).items() if k.endswith(".parquet")}
    if combined(have) != sha:
        raise ValueError(f"canonical checksum mismatch: {name}")
    return manifest


def resolved_dataset(root: str, explicit: str | None = None, prefer: str = "", depth: int = 7) -> str:
    """The one valid dataset below ``root``: of several, those whose path has ``prefer`` come first; else an error.

    A folder that is named must lie below ``root`` and be valid.
    """
    base = os.path.realpath(root)
    if explicit:
        path = os.path.realpath(os.path.expanduser(explicit))
        if os.path.commonpath([base, path]) != base:
            raise ValueError(f"{path} is not below {base}")
        validated_dataset(path)
        return path
    valid = []
    for d in folders_with(base, MANIFEST, depth):
        try:
            validated_dataset(d)
            valid.append(d)
        except ValueError:
            pass
    named = [d for d in valid if prefer and prefer.lower() in d.lower()]
    return _only(named or valid, "valid datasets", root)


def write_archive(folder: str, path: str) -> str:
    """Pack a folder of evidence as a ``.tar.gz``, with its checksum beside it; returns the checksum.

    Files come in the order of their names and without times or owners, so the same folder gives the same archive.
    """
    inside = os.path.basename(os.path.normpath(folder))

    def plain(info: tarfile.TarInfo) -> tarfile.TarInfo:
        info.mtime, info.uid, info.gid, info.uname, info.gname = 0, 0, 0, "", ""
        return info

    with open(path, "wb") as raw, gzip.GzipFile(filename="", fileobj=raw, mode="wb", mtime=0) as packed, tarfile.open(fileobj=packed, mode="w") as out:
        for name in hashes(folder):
            out.add(os.path.join(folder, name), os.path.join(inside, name), filter=plain)
    digest = _hash(path)
    write_text(f"{path}.sha256", f"{digest}  {os.path.basename(path)}\n")
    return digest


def package_index(index_dir: str, out_dir: str, artifact_type: str) -> dict:
    """Copy an index with a manifest and checksums, then validate the copy."""
    import shutil

    if os.path.exists(out_dir) and os.listdir(out_dir):
        raise FileExistsError(out_dir)
    shutil.copytree(index_dir, out_dir, dirs_exist_ok=True)
    meta = json.loads(read_text(f"{out_dir}/index-metadata.json"))
    _write_json(f"{out_dir}/manifest.json", {"schema_version": 1, "artifact_type": artifact_type, **meta})
    write_checksums(out_dir)
    return validated_artifact(out_dir, artifact_type)


def validated_artifact(folder: str, artifact_type: str, fingerprint: str | None = None, shape: tuple[int, int] | None = None) -> dict:
    """The manifest of a packaged index whose files, checksums and metadata all agree, else an error."""
    manifest = json.loads(read_text(f"{folder}/manifest.json"))
    if manifest.get("schema_version") != 1 or manifest.get("artifact_type") != artifact_type:
        raise ValueError("unsupported artifact")
    if shape is not None and (manifest.get("row_count"), manifest.get("dimensions")) != shape:
        raise ValueError("artifact of another shape")
    if fingerprint is not None and manifest.get("model_fingerprint") != fingerprint:
        raise ValueError("model fingerprint mismatch")
    listed = dict(reversed(line.split(None, 1)) for line in read_text(f"{folder}/{CHECKSUMS}").splitlines() if line.strip())
    have = {k: v["sha256"] for k, v in hashes(folder).items()}
    unlisted = {k for k in have if k != CHECKSUMS and not k.endswith(".crc")} - listed.keys()
    if unlisted or not {"manifest.json", "index-metadata.json"} <= listed.keys():
        raise ValueError(f"files without a checksum: {sorted(unlisted)}")
    for name, sha in listed.items():
        if have.get(name) != sha:
            raise ValueError(f"checksum mismatch: {name}")
    meta = json.loads(read_text(f"{folder}/index-metadata.json"))
    for key in ("model_fingerprint", "dataset_sha256", "row_count", "dimensions"):
        if meta.get(key) != manifest.get(key) or key not in meta:
            raise ValueError(f"manifest and metadata differ: {key}")
    return manifest


def resolved(root: str, marker: str, explicit: str | None = None, depth: int = 4) -> str:
    """The one folder below ``root`` that holds the file ``marker``; none or several are errors."""
    base = os.path.realpath(root)
    if explicit:
        path = os.path.realpath(explicit)
        if os.path.commonpath([base, path]) != base or not os.path.isfile(f"{path}/{marker}"):
            raise ValueError(f"not a valid folder below {root}: {explicit}")
        return path
    return _only(folders_with(base, marker, depth), f"folders with {marker}", root)


def folders_with(base: str, marker: str, depth: int) -> list[str]:
    """The folders that hold the file ``marker``, at most ``depth`` levels down."""
    out = []
    for d, subs, names in os.walk(base):
        if os.path.relpath(d, base).count(os.sep) + 1 >= depth:
            subs[:] = []
        if marker in names:
            out.append(os.path.realpath(d))
    return sorted(set(out))


def _only(found: list[str], what: str, root: str) -> str:
    if len(found) != 1:
        raise ValueError(f"{len(found)} {what} below {root}: {found}")
    return found[0]
