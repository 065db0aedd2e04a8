"""Review reports, the lexicon and its approvals: JSON files, read strictly and bound to each other by digests."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import guards, review
from ..operators.guards import Refused
from . import directories as d

# Names and formats of the files.
LEXICON, LEXICAL_REPORT, APPROVALS, WORDS_ONLY = "normalize_lexicon_v1", "lexical_review_v1", "human_lexical_approvals_v2", "human_lexicon_approvals_v1"
WHITESPACE_LEDGER, LEXICAL_LEDGER = "execution_report.json", "lexical_execution_report.json"
WHITESPACE_STAGE, LEXICAL_STAGE = "punctuation_whitespace_v1", "lexical_repairs_v1"
REVERSED = "reverse_executed_punctuation_spaces"
FIELDS = {
    "id": "string", "paddle_markdown": "string", "source_md_sha256": "string", "start_byte": "int", "end_byte": "int", "observed": "string", "triggers": "array<string>", "proposed": "string",
    "proposal_source": "string", "evidence": "string", "proposal_note": "string", "lexicon_suggestion": "boolean", "review": "struct<status:string,note:string>",
}
ENTRY, APPROVED, OVERRIDE = ("word", "approval", "note"), ("word", "finding_id", "approved", "note"), ("finding_id", "observed", "decision", "replacement", "note")
APPROVAL = ("finding_id", "source_report_sha256", "source_scans_sha256")
BOUND = {"source_report_sha256": "baseline", "source_proposals_sha256": "proposals", "source_reviewed_sha256": "reviewed", "source_scans_sha256": "scans", "lexicon_sha256": "lexicon"}


def findings(spark: SparkSession, path: str) -> tuple[dict, str, DataFrame]:
    """A report's other parts, its digest, and its findings in order.

    Rows have ``position``, ``page`` (path of the text), the typed fields, and ``rest``: all other fields as
    JSON, by name, so that reports can be compared whole.
    """
    head, sha = d.read_strict(path)
    if not isinstance(head, dict) or not isinstance(head.pop("findings", None), list):
        raise Refused(f"no report: {path}")
    rows = spark.read.schema("findings array<string>").option("multiLine", True).json(Path(path).resolve().as_uri())
    rows = rows.select(F.posexplode("findings").alias("position", "raw"))
    typed = F.from_json("raw", ", ".join(f"{c} {t}" for c, t in FIELDS.items()))
    other = F.map_filter(F.from_json("raw", "map<string,string>"), lambda k, _: ~k.isin(*FIELDS))
    parts = F.array_sort(F.map_keys(F.from_json(F.get_json_object("raw", "$.review"), "map<string,string>")))
    rows = rows.select("position", typed.alias("f"), F.array_sort(F.map_entries(other)).alias("rest"), parts.alias("review_parts"))
    plain = [F.col(f"f.{c}").alias({"paddle_markdown": "page", "source_md_sha256": "source_sha256"}.get(c, c)) for c in FIELDS if c != "review"]
    return head, sha, rows.select("position", *plain, F.col("f.review.status").alias("status"), F.col("f.review.note").alias("note"), "review_parts", "rest")


def lexicon(spark: SparkSession, path: str) -> tuple[dict, str, DataFrame]:
    """The lexicon's document, its digest, and its entries with ``key``; malformed ones and repeated words are refused."""
    document, sha = d.read_strict(path)
    return document, sha, lexicon_entries(spark, document)


def lexicon_entries(spark: SparkSession, document: dict) -> DataFrame:
    """``(word, finding_id, source_report_sha256, source_scans_sha256, note, key)`` of a lexicon document that holds nothing else."""
    listed = document.get("entries") if isinstance(document, dict) else None
    if not isinstance(listed, list) or set(document) != {"format", "entries"} or document["format"] != LEXICON:
        raise Refused("no lexicon")
    if any(not isinstance(e, dict) or set(e) != set(ENTRY) or not isinstance(e["approval"], dict) or set(e["approval"]) != set(APPROVAL) for e in listed):
        raise Refused("malformed lexicon entry")
    rows = [(e["word"], *(e["approval"][k] for k in APPROVAL), e["note"]) for e in listed]
    entries = _table(spark, rows, [*ENTRY[:1], *APPROVAL, "note"])
    guards.require(review.lexicon_guards(entries))
    return entries.withColumn("key", T.canonical("word"))


def serialized(document: dict) -> bytes:
    """A document as its file holds it."""
    return (json.dumps(document, ensure_ascii=False, indent=2) + "\n").encode()


def approvals(spark: SparkSession, path: str | None, digests: dict[str, str]) -> tuple[DataFrame, DataFrame, str | None]:
    """Admissions ``(word, finding_id, approved, note)``, overrides ``(id, observed, decision, replacement, human_note)`` and the digest.

    ``digests`` are those of baseline, proposals, reviewed, scans and lexicon: the file must be bound to all of
    them, or, if it only admits words, to the report and the lexicon. No file: nothing approved.
    """
    document, sha = d.read_strict(path) if path else ({"format": WORDS_ONLY, "entries": []}, None)
    words_only = isinstance(document, dict) and document.get("format") == WORDS_ONLY
    bound = {k: v for k, v in BOUND.items() if not words_only or v in ("baseline", "lexicon")}
    if path:
        lists = ["entries"] if words_only else ["entries", "repairs"]
        if not isinstance(document, dict) or document.get("format") not in (APPROVALS, WORDS_ONLY) or set(document) != {"format", *bound, *lists} or not all(isinstance(document[k], list) for k in lists):
            raise Refused(f"no approvals: {path}")
        if wrong := [k for k, v in bound.items() if document[k] != digests[v]]:
            raise Refused(f"approvals are not bound to these inputs: {wrong[0]}")
    listed = lambda rows, fields: [tuple(r[f] for f in fields) if isinstance(r, dict) and set(r) == set(fields) else (None,) * len(fields) for r in rows]
    entries = _table(spark, listed(document["entries"], APPROVED), APPROVED, "approved boolean")
    return entries, _table(spark, listed(document.get("repairs", []), OVERRIDE), ["id", "observed", "decision", "replacement", "human_note"]), sha


def _table(spark: SparkSession, rows: list[tuple], names: list[str] | tuple[str, ...], *kinds: str) -> DataFrame:
    """Small rows of a JSON file as a table of strings, unless ``kinds`` says otherwise; other types are refused."""
    kind = {k.split()[0]: k.split()[1] for k in kinds}
    for row in rows:
        for name, value in zip(names, row, strict=True):
            if value is not None and not isinstance(value, {"boolean": bool, "int": int}.get(kind.get(name, ""), str)):
                raise Refused(f"wrong type of {name}")
    return spark.createDataFrame(rows, ", ".join(f"{n} {kind.get(n, 'string')}" for n in names))


def changes(spark: SparkSession, ledger: dict) -> DataFrame:
    """``(page, id, start_byte, end_byte, observed, proposed, source_sha256, derived_sha256)`` of a ledger, one row an executed edit."""
    names = ["paddle_markdown", "id", "start_byte", "end_byte", "observed", "proposed", "source_md_sha256", "derived_md_sha256"]
    listed = ledger.get("changes")
    if not isinstance(listed, list) or ledger.get("approved_findings") != len(listed) or any(not isinstance(c, dict) or c.get(n) is None for c in listed for n in names):
        raise Refused("malformed ledger")
    rows = _table(spark, [tuple(c[n] for n in names) for c in listed], names, "start_byte int", "end_byte int")
    return rows.toDF("page", "id", "start_byte", "end_byte", "observed", "proposed", "source_sha256", "derived_sha256")


def dictionaries(spark: SparkSession, folder: str, locales: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``(locale, word)``: stems of spelling dictionaries, and the digest of each file. Affix rules are not expanded.

    Each locale (``en_US``) needs its pair of ``.aff`` and ``.dic`` files and may be asked for once.
    """
    if not locales or len(set(locales)) < len(locales) or not all(re.fullmatch(r"[a-z]{2,3}_[A-Z]{2}", x) for x in locales):
        raise Refused(f"malformed or repeated locale: {locales}")
    paths = [Path(folder) / f"{x}.{kind}" for x in sorted(locales) for kind in ("aff", "dic")]
    if gone := [p.name for p in paths if p.is_symlink() or not p.is_file()]:
        raise Refused(f"dictionary file is missing: {gone[0]}")
    lines = spark.read.text([p.resolve().as_uri() for p in paths if p.suffix == ".dic"])
    stem = F.trim(F.regexp_extract("value", r"^((?:[^/\\\t]|\\.)+)", 1))
    words = lines.select(F.regexp_extract("_metadata.file_name", r"^(\w+)\.dic$", 1).alias("locale"), F.regexp_replace(stem, r"\\(.)", "$1").alias("word"))
    return words.filter("word <> '' AND NOT word RLIKE '^[0-9]+$'"), {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in paths}
