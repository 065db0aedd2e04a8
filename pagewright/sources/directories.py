"""Page directories: scanned with Spark's file sources, checked before use, published all or nothing."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guards
from ..operators.guards import Refused


def checked_root(root: str) -> Path:
    """The directory, if it is one and holds regular files and directories only (no links)."""
    path = Path(root)
    if path.is_symlink() or not path.is_dir():
        raise Refused(f"not a directory: {root}")
    for at in path.rglob("*"):
        if at.is_symlink() or not (at.is_file() or at.is_dir()):
            raise Refused(f"not a regular file: {at}")
        if at.name.startswith((".", "_")):
            raise Refused(f"name that Spark's readers skip: {at}")
    return path


def files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content)`` of every file below ``root``, path relative to it."""
    base = checked_root(root).resolve()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base.as_uri())
    prefix = base.as_posix().rstrip("/") + "/"
    plain = F.url_decode(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), r"\+", "%2B"))
    return rows.select(F.substring(plain, F.lit(len(prefix) + 1), F.length(plain)).alias("path"), "content")


def texts(found: DataFrame, suffix: str = ".md") -> DataFrame:
    """``(page, path, text)`` of the text files among ``files``."""
    from ..operators.pages import by_stem

    return by_stem(found, suffix).join(found, "path").select("page", "path", F.decode("content", "UTF-8").alias("text"))


BLOCKS = "parsing_res_list array<struct<block_id:string,block_label:string,block_content:string>>, model_settings struct<markdown_ignore_labels:array<string>>"


def blocks(found: DataFrame, suffix: str = "_res.json") -> tuple[DataFrame, DataFrame]:
    """Blocks ``(page, block_id, label, content)`` that are not ignored, and ``(page)`` of files that are no JSON."""
    from ..operators.pages import by_stem

    rows = by_stem(found, suffix).join(found, "path").select("page", F.decode("content", "UTF-8").alias("raw"))
    parsed = rows.select("page", F.from_json("raw", f"{BLOCKS}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    good = parsed.filter("j IS NOT NULL AND j._bad IS NULL").select("page", F.coalesce("j.model_settings.markdown_ignore_labels", F.array().cast("array<string>")).alias("skip"), F.explode("j.parsing_res_list").alias("b"))
    label = F.coalesce("b.block_label", F.lit("unknown"))
    out = good.filter(~F.array_contains("skip", label)).select("page", F.col("b.block_id").alias("block_id"), label.alias("label"), F.col("b.block_content").alias("content"))
    return out, parsed.filter("j IS NULL OR j._bad IS NOT NULL").select("page")


def read_strict(path: str) -> tuple[dict, str]:
    """A small JSON document and its digest; repeated keys are refused."""

    def unique(pairs: list) -> dict:
        found = dict(pairs)
        if len(found) < len(pairs):
            raise Refused(f"duplicate JSON key in {path}")
        return found

    raw = Path(path).read_bytes()
    return json.loads(raw, object_pairs_hook=unique), hashlib.sha256(raw).hexdigest()


def batches(folder: str) -> list[tuple[str, dict]]:
    """The ``.json`` reports in a folder by name; at least one, and nothing else in it."""
    found = sorted(checked_root(folder).iterdir())
    if not found or any(p.suffix != ".json" or not p.is_file() for p in found):
        raise Refused(f"expected JSON reports only: {folder}")
    return [(p.name, read_strict(str(p))[0]) for p in found]


def manifest(path: str) -> list[dict]:
    """Books of a manifest: unique names, four different artifacts each, paths relative to the manifest."""
    books, names = read_strict(path)[0]["books"], set()
    for book in books:
        paths = [(Path(path).parent / book[k]).resolve() for k in ("probe2", "proposals", "reviewed", "progress")]
        if book["name"] in names or len(set(paths)) < 4:
            raise Refused(f"repeated book or artifact: {book['name']}")
        names.add(book["name"])
        book.update(zip(("probe2", "proposals", "reviewed", "progress"), map(str, paths), strict=True))
    return books


def name_list(spark: SparkSession, path: str, most_bytes: int = 10_000_000) -> DataFrame:
    """``(name, key)`` of a list with one capitalised word a line; ``#`` and blank lines are skipped, others refused."""
    from ..functions import text as T

    if os.path.getsize(path) > most_bytes:
        raise Refused(f"name list is too large: {path}")
    rows = spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> '' AND NOT startswith(name, '#')")
    bad = ~(T.valid_word(F.col("name")) & F.col("name").rlike(r"^\p{Lu}") & (F.length("name") >= 4))
    keyed = rows.withColumn("key", T.canonical("name"))
    guards.require(guards.violations(rows, "invalid name", "name", bad), guards.violations(guards.duplicates(keyed, "key"), "duplicate name", "key"))
    return keyed


# ---- sinks -------------------------------------------------------------------------


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def folder_digest(root: str | Path) -> str:
    """The digest of a directory read by the driver, equal to that of ``pages.snapshot_digest``."""
    base = Path(root)
    lines = {p.relative_to(base).as_posix(): sha256(p.read_bytes()) for p in base.rglob("*") if p.is_file()}
    return sha256(json.dumps(lines, sort_keys=True, ensure_ascii=False).encode())


def ledger_of(pages: DataFrame, edits: DataFrame, about: dict, *extra: str) -> tuple[dict, DataFrame]:
    """The ledger of ``edits`` applied to ``pages(page, text)`` with ``page`` a path, and ``(path, derived)`` of the pages that change.

    ``about`` goes before the counts; ``extra`` names further columns of the edits that the ledger lists.
    """
    from ..operators import repairs

    done = repairs.apply_repairs(pages, edits)
    digests = done.select("page", F.sha2(F.encode("text", "UTF-8"), 256).alias("source_md_sha256"), F.sha2(F.encode("derived", "UTF-8"), 256).alias("derived_md_sha256"))
    rows = edits.select("id", F.col("page").alias("paddle_markdown"), "start_byte", "end_byte", "observed", "proposed", *extra).join(digests.withColumnRenamed("page", "paddle_markdown"), "paddle_markdown")
    source = edits.select("page", "id", "start_byte", "end_byte", "observed", "proposed").join(digests.select("page", F.col("source_md_sha256").alias("source_sha256")), "page")
    guards.require(repairs.provenance_violations(done, source))
    names = ["id", "paddle_markdown", "start_byte", "end_byte", "observed", "proposed", *extra, "source_md_sha256", "derived_md_sha256"]
    listed = [r.asDict(True) for r in rows.select(*names).orderBy("paddle_markdown", "start_byte").collect()]  # a book's approved edits: the ledger file itself
    report = about | repairs.repair_totals(done, edits).first().asDict() | {"changes": listed}
    return report, done.filter("derived <> text").select(F.col("page").alias("path"), "derived")


def new_place(target: str, *inputs: str) -> Path:
    """The target, if it does not exist and lies in none of the inputs."""
    path = Path(target).resolve()
    if path.exists() or any(path.is_relative_to(Path(i).resolve()) for i in inputs):
        raise Refused(f"refusing to write: {target}")
    path.parent.mkdir(parents=True, exist_ok=True)
    return path


def write_report(document: dict, target: str) -> None:
    """A small report as JSON, never over another."""
    with open(target, "x", encoding="utf-8", newline="\n") as f:
        json.dump(document, f, ensure_ascii=False, indent=2)
        f.write("\n")


def publish_pair(documents: dict[str, dict]) -> None:
    """Several reports, all or none: written aside, linked into place, undone if one cannot be."""
    done: list[str] = []
    aside = {t: f"{t}.{uuid.uuid4().hex}.tmp" for t in documents}
    try:
        for target, document in documents.items():
            write_report(document, aside[target])
        for target in documents:
            os.link(aside[target], target)
            done.append(target)
    except OSError:
        for target in done:
            os.unlink(target)
        raise
    finally:
        for x in aside.values():
            Path(x).unlink(missing_ok=True)


def publish_pages(source: str, changed: DataFrame, ledger: dict, target: str, ledger_name: str = "execution_report.json", expected_sha256: str | None = None) -> None:
    """A copy of ``source`` with ``changed(path, derived)`` written over, and the ledger; renamed into place when whole.

    With ``expected_sha256``, the copy must have that digest before it is changed.
    """
    path = new_place(target, source)
    stage = path.parent / f".{path.name}.{uuid.uuid4().hex}"
    shutil.copytree(source, stage)
    try:
        if expected_sha256 and folder_digest(stage) != expected_sha256:
            raise Refused(f"source changed while it was copied: {source}")
        for r in changed.toLocalIterator():  # one page at a time
            (stage / r["path"]).write_bytes(r["derived"].encode())
        write_report(ledger, str(stage / ledger_name))
        if path.exists():
            raise Refused(f"appeared meanwhile: {target}")
        stage.rename(path)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise


def swap(path: str, expected_sha256: str, document: dict) -> bool:
    """Replace a small JSON file if it still has the expected digest; False if it already holds the document."""
    raw = Path(path).read_bytes()
    new = (json.dumps(document, ensure_ascii=False, indent=2) + "\n").encode()
    if raw == new:
        return False
    if hashlib.sha256(raw).hexdigest() != expected_sha256:
        raise Refused(f"stale: {path}")
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(aside, "xb") as f:
        f.write(new)
        f.flush()
        os.fsync(f.fileno())
    os.replace(aside, path)
    return True
