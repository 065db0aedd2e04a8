"""The lexical stage: verify what the stage before left, execute reviewed replacements, admit words, resume."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import guards, pages, repairs, review, spans
from ..operators.guards import Refused
from ..session import positions, written
from ..sources import directories as d
from ..sources import reports as r


def digest(found: DataFrame) -> str:
    """The digest of a directory's ``(path, content)``."""
    return pages.snapshot_digest(pages.file_digests(found)).first()["snapshot_sha256"]


def undone(spark: SparkSession, found: DataFrame, name: str, ledger: dict, source_sha256: str) -> DataFrame:
    """``(path, content)`` as they were before the stage that wrote ``ledger`` under ``name``.

    Refused unless every edit can be reversed and the whole directory then has the digest ``source_sha256``.
    """
    edits = r.changes(spark, ledger)
    derived = found.join(edits.select(F.col("page").alias("path")).distinct(), "path", "left_semi").filter("lower(path) LIKE '%.md'")
    derived = derived.select(F.col("path").alias("page"), F.decode("content", "UTF-8").alias("derived"), F.sha2("content", 256).alias("_now"))
    both = edits.join(derived, "page", "left")
    guards.require(
        guards.violations(guards.duplicates(edits, "id"), "edit executed twice", "id"),
        guards.violations(both, "no such page", "id", F.col("derived").isNull()),
        guards.violations(both, "page changed since", "id", F.col("_now") != F.col("derived_sha256")),
        guards.violations(edits, "edit without effect", "id", F.col("observed") == F.col("proposed")),
        guards.violations(edits.groupBy("page").agg(F.count_distinct("source_sha256").alias("n")), "sources of a page differ", "page", F.col("n") > 1),
        repairs.provenance_violations(derived, edits),
    )
    back = repairs.reverse_repairs(derived, edits).select(F.col("page").alias("path"), F.encode("restored", "UTF-8").alias("_old"))
    before = found.filter(F.col("path") != name).join(back, "path", "left").select("path", F.coalesce("_old", "content").alias("content"))
    if digest(before) != source_sha256:
        raise Refused(f"directory before {name} cannot be restored")
    return before


def verified(spark: SparkSession, artifacts: str, scans_sha256: str) -> tuple[DataFrame, dict]:
    """The raw ``(path, content)`` behind a directory of either stage, or of none, and what was verified on the way."""
    found, root, about = d.files(spark, artifacts), Path(artifacts), {"mode": "raw", "execution_report_sha256": None}
    stages = [(r.LEXICAL_LEDGER, r.LEXICAL_STAGE, "source_artifact_dir_sha256"), (r.WHITESPACE_LEDGER, r.WHITESPACE_STAGE, "source_paddle_dir_sha256")]
    seen = {}
    for name, stage, source in stages:
        if not (root / name).exists():
            continue
        ledger, sha = d.read_strict(str(root / name))
        if ledger.get("execution_format") != stage or ledger.get("source_dir_sha256") != scans_sha256:
            raise Refused(f"ledger of another stage or book: {name}")
        if stage == r.WHITESPACE_STAGE:
            listed = [(c.get("id"), c.get("observed"), c.get("proposed"), c.get("triggers"), c.get("json_markdown_comparison")) for c in ledger["changes"]]
            rows = spark.createDataFrame(listed, "id string, observed string, proposed string, triggers array<string>, how string")
            fits = F.col("proposed").eqNullSafe(T.whitespace_proposal(F.col("observed"), F.col("triggers"))) & (F.col("how") == r.REVERSED)
            guards.require(guards.violations(rows, "no edit of this stage", "id", ~F.coalesce(fits, F.lit(False))))
        found = undone(spark, found, name, ledger, ledger[source])
        seen[stage] = ledger, sha
    if r.WHITESPACE_STAGE in seen:
        ledger, sha = seen[r.WHITESPACE_STAGE]
        about = {"mode": "verified_executed_whitespace", "execution_report_sha256": sha, "source_paddle_dir_sha256": ledger["source_paddle_dir_sha256"], "executed_findings": len(ledger["changes"])}
    if r.LEXICAL_STAGE in seen:
        ledger, sha = seen[r.LEXICAL_STAGE]
        about |= {"mode": "verified_executed_lexical_and_whitespace", "lexical_execution_report_sha256": sha, "lexical_executed_findings": len(ledger["changes"]), "source_lexicon_sha256": ledger["source_lexicon_sha256"]}
    return found, about


class Handoff:
    """The three reports of a book's lexical review with its lexicon and approvals, checked against each other.

    ``edits`` are the approved replacements, ``admitted`` the new lexicon entries, ``lexicon`` the document with them.
    """

    def __init__(self, spark: SparkSession, scans: str, baseline: str, proposals: str, reviewed: str, lexicon: str, approvals: str | None = None):
        head, base_sha, base = r.findings(spark, baseline)
        after, proposals_sha, proposed = r.findings(spark, proposals)
        last, reviewed_sha, verdicts = r.findings(spark, reviewed)
        base, proposed, verdicts = (written(spark, df, "findings") for df in (base, proposed, verdicts))  # read by every guard
        document, self.lexicon_sha256, known = r.lexicon(spark, lexicon)
        self.inputs = head["inputs"]
        self.digests = {"baseline": base_sha, "proposals": proposals_sha, "reviewed": reviewed_sha, "scans": digest(d.files(spark, scans)), "lexicon": self.lexicon_sha256}
        if self.digests["scans"] != self.inputs["source_dir_sha256"]:
            raise Refused("scans changed since the probe")
        guards.require(*spans.lexical_guards(base, self.inputs.get("lexicon_sha256")))
        expected = positions(spark, spans.extract_lexical(base).withColumnRenamed("position", "_was"), "_was").drop("_was")
        listed = [{"word": w["word"], "count": w["n"], "finding_ids": w["ids"]} for w in review.vocabulary(expected).collect()]  # as long as the report's own list
        if after != {"format": r.LEXICAL_REPORT, "inputs": self.inputs, "vocabulary": listed} or last != after:
            raise Refused("report heads differ")
        changed = lambda a, b, fields: guards.violations(review.handoff_violations(a, b.select(*a.columns), fields), "field may not change", F.concat_ws(":", F.col("position").cast("string"), "field"))
        guards.require(changed(expected, proposed, review.PROPOSAL_FIELDS), changed(proposed, verdicts, review.REVIEW_FIELDS), review.verdict_guards(verdicts))
        entries, overrides, self.approvals_sha256 = r.approvals(spark, approvals, self.digests)
        guards.require(review.override_guards(verdicts, overrides))
        effective = review.effective_review(verdicts, overrides)
        guards.require(review.admission_refusals(entries, effective, known, corrected=bool(approvals) and d.read_strict(approvals)[0]["format"] == r.APPROVALS))
        self.overrides = [dict(zip(r.OVERRIDE, o, strict=True)) for o in overrides.collect()]
        self.admitted = [
            {"word": e["word"], "approval": {"finding_id": e["finding_id"], "source_report_sha256": base_sha, "source_scans_sha256": self.digests["scans"]}, "note": e["note"]} for e in entries.collect()
        ]
        self.lexicon = document | {"entries": document["entries"] + self.admitted}
        r.lexicon_entries(spark, self.lexicon)
        raw = r.serialized(self.lexicon) if self.admitted else Path(lexicon).read_bytes()
        self.target_sha256 = d.sha256(raw)
        self.edits = written(spark, effective.filter("status = 'approved'"), "edits")

    def recorded(self) -> dict:
        """What the ledger holds of the inputs."""
        return {
            "source_dir_sha256": self.digests["scans"], "source_lexicon_sha256": self.lexicon_sha256, "target_lexicon_sha256": self.target_sha256, "human_approved_lexicon_entries": self.admitted,
            "human_occurrence_repair_decisions": self.overrides, "source_baseline_sha256": self.digests["baseline"], "source_proposals_sha256": self.digests["proposals"],
            "source_reviewed_sha256": self.digests["reviewed"], "source_lexicon_approvals_sha256": self.approvals_sha256,
        }


def execute(spark: SparkSession, artifacts: str, lexicon: str, target: str, handoff: Handoff, dry_run: bool = False) -> dict:
    """Apply a handoff's edits to a copy of the punctuation stage's directory, then admit its words; returns the ledger.

    Nothing is written if a guard finds fault. The lexicon is replaced last, and only if it is still the one reviewed.
    """
    places = [Path(p).resolve() for p in (artifacts, target, lexicon)]
    if any(a.is_relative_to(b) for a, b in ((places[1], places[0]), (places[0], places[1]), (places[2], places[0]), (places[2], places[1]))):
        raise Refused("artifacts, target and lexicon must not lie in each other")
    d.new_place(target, artifacts)
    found, inputs = d.files(spark, artifacts), handoff.inputs
    if (Path(artifacts) / r.LEXICAL_LEDGER).exists() or not (Path(artifacts) / r.WHITESPACE_LEDGER).exists():
        raise Refused("not a directory of the punctuation stage")
    if digest(found) != inputs["paddle_dir_sha256"] or inputs.get("lexicon_sha256") != handoff.lexicon_sha256:
        raise Refused("directory or lexicon changed since the probe")
    if verified(spark, artifacts, handoff.digests["scans"])[1] != inputs["json_markdown_comparison"]:
        raise Refused("the probe was not made of this directory")
    texts = found.filter("lower(path) LIKE '%.md'").select(F.col("path").alias("page"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("source_md_sha256"))
    other = handoff.edits.join(texts.select("page", "source_md_sha256"), "page").filter(F.col("source_md_sha256") != F.col("source_sha256"))
    guards.require(*repairs.edit_guards(texts, handoff.edits), guards.violations(other, "page changed since the probe", "id"))
    decided = [o["finding_id"] for o in handoff.overrides]
    authority = F.when(F.col("id").isin(*decided) if decided else F.lit(False), "human_scan_approval").otherwise("codex_independent_verification")
    ledger = {"execution_format": r.LEXICAL_STAGE, "source_artifact_dir_sha256": inputs["paddle_dir_sha256"]} | handoff.recorded()
    report, changed = d.ledger_of(texts, handoff.edits.withColumn("authority", authority), ledger, "authority")
    if not dry_run:
        d.publish_pages(artifacts, changed, report, target, r.LEXICAL_LEDGER, inputs["paddle_dir_sha256"])
        _admit(lexicon, handoff)
    return report


def _admit(lexicon: str, handoff: Handoff) -> bool:
    return bool(handoff.admitted) and d.swap(lexicon, handoff.lexicon_sha256, handoff.lexicon)


def resume(spark: SparkSession, lexicon: str, target: str, scans: str, baseline: str, proposals: str, reviewed: str, approvals: str | None = None) -> bool:
    """Finish an execution that published ``target`` but not the lexicon; False if nothing was left to do."""
    ledger = d.read_strict(str(Path(target) / r.LEXICAL_LEDGER))[0]
    now = d.sha256(Path(lexicon).read_bytes())
    given = {"source_baseline_sha256": baseline, "source_proposals_sha256": proposals, "source_reviewed_sha256": reviewed, "source_lexicon_approvals_sha256": approvals}
    if wrong := [k for k, p in given.items() if ledger[k] != (d.sha256(Path(p).read_bytes()) if p else None)]:
        raise Refused(f"ledger was written from other inputs: {wrong[0]}")
    verified(spark, target, ledger["source_dir_sha256"])
    if now == ledger["target_lexicon_sha256"]:
        return False
    if now != ledger["source_lexicon_sha256"]:
        raise Refused("lexicon changed since")
    handoff = Handoff(spark, scans, baseline, proposals, reviewed, lexicon, approvals)
    if any(ledger[k] != v for k, v in handoff.recorded().items()):
        raise Refused("ledger does not bear out these approvals")
    return _admit(lexicon, handoff)
