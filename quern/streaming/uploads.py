"""Uploaded packages: validation of archives and analyses, landing of approved ones, and recomputation into a staged version."""

from __future__ import annotations

import hashlib
import io
import json
import stat
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.media import IMAGE, VIDEO
from quern.sources.sinks import publish, write_files

MOST_FILES, MOST_BYTES = 50, 25_000_000
CHECKED = "submission_id string, status string, reason string, files array<struct<path: string, sha256: string, size_bytes: long>>"


def _object(payload: bytes, sections: dict) -> None:
    data = json.loads(payload.decode("utf-8"))
    if not isinstance(data, dict) or not any(isinstance(data.get(s), list) for s in sections):
        raise ValueError("no supported section in the analysis")


def _safe(member: zipfile.ZipInfo) -> PurePosixPath:
    path = PurePosixPath(member.filename)
    bad = member.flag_bits & 1 or stat.S_ISLNK(member.external_attr >> 16) or "\\" in member.filename or path.is_absolute() or not path.parts
    if bad or any(p in ("", ".", "..") or len(p) > 240 or any(ord(c) < 32 or ord(c) == 127 for c in p) for p in path.parts) or ":" in path.parts[0]:
        raise ValueError(f"unsafe path {member.filename!r}")
    return path


def check_archive(payload: bytes) -> list[dict]:
    """Files of a page bundle: one page, optionally its sidecar and one image analysis, in one folder; raises ValueError."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(payload))
    except zipfile.BadZipFile as e:
        raise ValueError("not a ZIP file") from e
    with archive:
        members = [m for m in archive.infolist() if not m.is_dir()]
        if not 1 <= len(members) <= MOST_FILES:
            raise ValueError(f"{len(members)} files")
        paths = [_safe(m) for m in members]
        if len(paths[0].parts) > 1 and all(len(p.parts) > 1 and p.parts[0] == paths[0].parts[0] for p in paths):
            paths = [PurePosixPath(*p.parts[1:]) for p in paths]
        names = [p.name for p in paths]
        pages = [n for n in names if n.lower().endswith(".html")]
        if any(len(p.parts) != 1 for p in paths) or len(set(names)) != len(names) or len(pages) != 1 or set(names) - {pages[0], "SOURCE_INFO.md", "image_01.json"}:
            raise ValueError("expected one page, SOURCE_INFO.md and image_01.json in one folder")
        if sum(m.file_size for m in members) > MOST_BYTES:
            raise ValueError("too large when unpacked")
        out = []
        for m, name in zip(members, names, strict=True):
            content = archive.read(m)
            if name == "image_01.json":
                _object(content, IMAGE)
            else:
                content.decode("utf-8")
            out.append({"path": name, "sha256": hashlib.sha256(content).hexdigest(), "size_bytes": len(content)})
        return sorted(out, key=lambda x: x["path"])


def check_upload(name: str, payload: bytes) -> tuple[str, str | None, list[dict]]:
    """(status, reason, files): pending, or invalid with the reason."""
    try:
        if name.lower().endswith(".zip"):
            return "pending", None, check_archive(payload)
        if name.lower().endswith(".json"):
            _object(payload, VIDEO)
            return "pending", None, [{"path": "video.json", "sha256": hashlib.sha256(payload).hexdigest(), "size_bytes": len(payload)}]
        return "invalid", "neither a ZIP nor a JSON file", []
    except (ValueError, RuntimeError, NotImplementedError, zipfile.BadZipFile) as e:
        return "invalid", str(e)[:300], []


def checked_uploads(files: DataFrame) -> DataFrame:
    """Rows or a stream of binary files (path, content) -> one row for each upload.  Files over the limit aren't unpacked."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b.path, b.content, strict=True):
                payload = bytes(content)
                status, reason, found = ("invalid", "too large", []) if len(payload) > MOST_BYTES else check_upload(path, payload)
                out.append((_submission(payload), status, reason, found))
            yield pd.DataFrame(out, columns=["submission_id", "status", "reason", "files"])

    return files.select("path", "content").mapInPandas(check, CHECKED)


def layered(*layers: DataFrame, key: str = "path") -> DataFrame:
    """Union of layers in which a later one replaces an earlier one's row of the same key."""
    rows = [d.withColumn("_layer", F.lit(k)) for k, d in enumerate(layers)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    rest = [c for c in layers[0].columns if c != key]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "_layer").alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def recompute(spark: SparkSession, root: str, name: str, compute: Callable[[], DataFrame], check: Callable[[DataFrame], DataFrame]) -> str:
    """Compute a new version, check it, and point to it only if there are no issues; else the published one stays."""
    made = compute()
    issues = check(made)
    found = issues.limit(5).collect()
    if found:
        raise ValueError(f"not published: {found}")
    return publish(made, root, name)


def members(name: str, payload: bytes) -> list[tuple[str, bytes]]:
    """Names and contents of a valid upload's files."""
    if name.lower().endswith(".json"):
        return [("video.json", payload)]
    with zipfile.ZipFile(io.BytesIO(payload)) as archive:
        return [(PurePosixPath(m.filename).name, archive.read(m)) for m in archive.infolist() if not m.is_dir()]


def landed(files: DataFrame, approved: DataFrame, folder: str) -> DataFrame:
    """Files of approved uploads (submission_id), each upload in a folder of its own: path, sha256, size_bytes, outcome."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b.path, b.content, strict=True):
                payload = bytes(content)
                if len(payload) <= MOST_BYTES and check_upload(path, payload)[0] == "pending":
                    out += [(_submission(payload), name, body) for name, body in members(path, payload)]
            yield pd.DataFrame(out, columns=["submission_id", "name", "content"])

    rows = files.select("path", "content").mapInPandas(unpack, "submission_id string, name string, content binary")
    kept = rows.join(approved.select("submission_id").distinct(), "submission_id", "left_semi")
    return write_files(kept.select(F.concat_ws("/", "submission_id", "name").alias("path"), "content"), folder)


def _submission(payload: bytes) -> str:
    return "sub_" + hashlib.sha256(payload).hexdigest()[:16]
