"""The lexical stage end to end on a book of two pages, and what it refuses."""

import copy
import hashlib
import json
import shutil

import pytest
from pyspark.sql import functions as F

from pagewright.operators import guards, review, spans
from pagewright.plans import lexical, workflow
from pagewright.sources import directories as d
from pagewright.sources import reports

PAGES = {"a.md": "Wrods here.Next page, élan wrods.\n", "b.md": "Quiet zyxword stays.\n"}


def sha(path):
    return hashlib.sha256(path.read_bytes()).hexdigest()


def put(path, document):
    path.write_bytes(reports.serialized(document))
    return str(path)


@pytest.fixture(scope="module")
def stage(spark, tmp_path_factory):
    """A book after the punctuation stage, with the reports of its lexical review."""
    at = tmp_path_factory.mktemp("stage")
    (at / "scans").mkdir(), (at / "raw").mkdir()
    (at / "scans/a.png").write_bytes(b"a")
    for name, text in PAGES.items():
        (at / "raw" / name).write_text(text)
    edits = spark.createDataFrame([("a", "w", 10, 16, ".Next", ". Next", ["period_capital"])], "page string, id string, start_byte int, end_byte int, observed string, proposed string, triggers array<string>")
    edits = edits.withColumn("end_byte", F.col("start_byte") + F.octet_length("observed"))
    workflow.execute(spark, str(at / "raw"), edits, str(at / "white"), str(at / "scans"))
    lexicon = put(at / "lexicon.json", {"format": reports.LEXICON, "entries": []})
    about = lexical.verified(spark, str(at / "white"), d.folder_digest(at / "scans"))[1]
    inputs = {"source_dir_sha256": d.folder_digest(at / "scans"), "paddle_dir_sha256": d.folder_digest(at / "white"), "lexicon_sha256": sha(at / "lexicon.json"), "json_markdown_comparison": about}
    base = []
    for name, word in (("a.md", "Wrods"), ("a.md", "wrods"), ("b.md", "zyxword")):
        raw = (at / "white" / name).read_bytes()
        start = raw.index(word.encode())
        base.append({"id": f"{name}:{start}", "page": name[0], "paddle_markdown": name, "source_md_sha256": hashlib.sha256(raw).hexdigest(), "start_byte": start, "end_byte": start + len(word), "observed": word,
            "triggers": ["unrecognized_token"], "ocr_context": {"text": raw.decode()}, "proposed": None, "proposal_source": None, "evidence": None, "review": {"status": None, "note": None}})
    other = base[0] | {"id": "a.md:x", "triggers": ["lower_upper"], "observed": "xY"}
    baseline = {"format": "probe", "inputs": inputs, "findings": [other, *base]}
    found = [f | {"proposal_note": None, "lexicon_suggestion": None} for f in base]
    words = [{"word": "Wrods", "count": 2, "finding_ids": [base[0]["id"], base[1]["id"]]}, {"word": "zyxword", "count": 1, "finding_ids": [base[2]["id"]]}]
    proposals = {"format": reports.LEXICAL_REPORT, "inputs": inputs, "findings": copy.deepcopy(found), "vocabulary": words}
    for f, fixed in zip(proposals["findings"], ("Words", "words", None), strict=True):
        f.update({"proposed": fixed, "proposal_source": fixed and "codex_scan_proposal", "evidence": fixed and "seen", "proposal_note": "looked"})
    reviewed = copy.deepcopy(proposals)
    for f, status in zip(reviewed["findings"], ("approved", None, None), strict=True):
        f["review"] = {"status": status, "note": "checked"}
    return at, lexicon, baseline, proposals, reviewed


def reports_of(stage, tmp_path, **changed):
    at, _, baseline, proposals, reviewed = stage
    made = {"baseline": baseline, "proposals": proposals, "reviewed": reviewed} | changed
    return [str(at / "scans"), *(put(tmp_path / f"{k}.json", made[k]) for k in ("baseline", "proposals", "reviewed"))]


def bound(stage, paths, entries, repairs):
    at = stage[0]
    digests = dict(zip(("source_report_sha256", "source_proposals_sha256", "source_reviewed_sha256"), (hashlib.sha256(open(p, "rb").read()).hexdigest() for p in paths[1:]), strict=True))
    return {"format": reports.APPROVALS, **digests, "source_scans_sha256": d.folder_digest(at / "scans"), "lexicon_sha256": sha(at / "lexicon.json"), "entries": entries, "repairs": repairs}


def test_execute_verify_resume(spark, stage, tmp_path):
    at, ids = stage[0], [f["id"] for f in stage[3]["findings"]]
    paths = reports_of(stage, tmp_path)
    lexicon = str(shutil.copy(stage[1], tmp_path / "lexicon.json"))
    yes = bound(stage, paths, [{"word": "zyxword", "finding_id": ids[2], "approved": True, "note": "a name"}, {"word": "words", "finding_id": ids[0], "approved": True, "note": "plain"}],
        [{"finding_id": ids[1], "observed": "wrods", "decision": "approved", "replacement": "", "note": "printed twice"}])
    approvals = put(tmp_path / "approvals.json", yes)
    handoff = lexical.Handoff(spark, *paths, lexicon, approvals)
    before = (tmp_path / "lexicon.json").read_bytes()
    ledger = lexical.execute(spark, str(at / "white"), lexicon, str(tmp_path / "out"), handoff)
    assert ledger["approved_findings"] == 2 and {c["id"]: c["authority"] for c in ledger["changes"]} == {ids[0]: "codex_independent_verification", ids[1]: "human_scan_approval"}
    assert (tmp_path / "out/a.md").read_text() == "Words here. Next page, élan .\n" and (tmp_path / "out/b.md").read_text() == PAGES["b.md"]
    assert (ledger["page_count"], ledger["changed_pages"]) == (2, 1) and sha(tmp_path / "lexicon.json") == ledger["target_lexicon_sha256"]
    raw, about = lexical.verified(spark, str(tmp_path / "out"), ledger["source_dir_sha256"])
    assert {r["path"]: bytes(r["content"]).decode() for r in raw.collect()} == PAGES and about["mode"] == "verified_executed_lexical_and_whitespace"
    rest = [lexicon, str(tmp_path / "out"), *paths, approvals]
    (tmp_path / "lexicon.json").write_bytes(before)  # as if the last step had not happened
    assert lexical.resume(spark, *rest) and sha(tmp_path / "lexicon.json") == ledger["target_lexicon_sha256"]
    page = tmp_path / "out/a.md"
    page.write_text(page.read_text() + "more")
    with pytest.raises(guards.Refused, match="page changed"):
        lexical.verified(spark, str(tmp_path / "out"), ledger["source_dir_sha256"])


def test_other_bytes_beside_the_edits_are_noticed(spark, stage, tmp_path):
    copied = shutil.copytree(stage[0] / "white", tmp_path / "white")
    (copied / "b.md").write_text("another page\n")
    with pytest.raises(guards.Refused, match="cannot be restored"):
        lexical.verified(spark, str(copied), d.folder_digest(stage[0] / "scans"))


@pytest.mark.parametrize(("which", "field", "value", "rule"), [
    ("reviewed", "review", {"status": None, "note": "x", "extra": 1}, "field may not change|invalid verdict"), ("proposals", "ocr_context", {"text": "x"}, "field may not change"),
])
def test_handoffs_that_are_refused(spark, stage, tmp_path, which, field, value, rule):
    made = {"proposals": copy.deepcopy(stage[3]), "reviewed": copy.deepcopy(stage[4])}
    made[which]["findings"][0][field] = value
    with pytest.raises(guards.Refused, match=rule):
        lexical.Handoff(spark, *reports_of(stage, tmp_path, **made), stage[1])


def test_approvals_that_are_refused(spark, tmp_path):
    findings = spark.createDataFrame([("a", "Word", None, None), ("b", "wrod", "world", "approved"), ("c", "other", None, None)], "id string, observed string, proposed string, status string")
    findings = findings.withColumn("triggers", F.when(F.col("id") == "c", F.array(F.lit("lower_upper"))).otherwise(F.array(F.lit("unrecognized_token"))))
    known = spark.createDataFrame([("old",)], "key string")
    rows = [("word", "a", True, "n"), ("World", "b", True, "n"), ("other", "c", True, "n"), ("wrod", "b", True, "n"), ("no", "a", False, "n"), ("Old", "a", True, "n"), ("WORD", "a", True, "n"), ("blank", "a", True, " "), (None, "a", True, "n")]
    entries = spark.createDataFrame(rows, "word string, finding_id string, approved boolean, note string")
    got = {(r["rule"], r["key"]) for r in review.admission_refusals(entries, findings, known).collect()}
    formal, evidence = "admission without approval, reason or word", "admission without evidence"
    assert got == {(formal, "no"), (formal, "blank"), (formal, ""), (evidence, "other"), (evidence, "wrod"), (evidence, "Old"), ("word already admitted", "Old"), ("word admitted twice", "word")}
    only = review.admission_refusals(entries.limit(2), findings, known, corrected=False)
    assert [tuple(r) for r in only.collect()] == [(evidence, "World")] and review.admission_refusals(entries.limit(0), findings, known).count() == 0
    digests = dict.fromkeys(reports.BOUND.values(), "1")
    document = {"format": reports.APPROVALS, **dict.fromkeys(reports.BOUND, "1"), "entries": [], "repairs": []}
    assert [x.count() for x in reports.approvals(spark, put(tmp_path / "yes.json", document), digests)[:2]] == [0, 0]
    for n, (change, rule) in enumerate([({"lexicon_sha256": "0"}, "not bound"), ({"more": 1}, "no approvals"), ({"entries": [{"word": 1, "finding_id": "a", "approved": True, "note": "n"}]}, "wrong type")]):
        with pytest.raises(guards.Refused, match=rule):
            reports.approvals(spark, put(tmp_path / f"no{n}.json", document | change), digests)


def test_lexicon_and_dictionaries(spark, tmp_path):
    with pytest.raises(guards.Refused, match="no lexicon"):
        reports.lexicon(spark, put(tmp_path / "l.json", {"format": "x", "entries": []}))
    (tmp_path / "en_US.aff").write_text("SET UTF-8\n")
    (tmp_path / "en_US.dic").write_text("3\nword/AB\nnaïve\nand\\/or/X\tpo:x\n")
    words, digests = reports.dictionaries(spark, str(tmp_path), ["en_US"])
    assert {tuple(r) for r in words.collect()} == {("en_US", "word"), ("en_US", "naïve"), ("en_US", "and/or")} and set(digests) == {"en_US.aff", "en_US.dic"}
    for locales, rule in ((["en"], "locale"), (["en_US", "en_US"], "locale"), (["de_DE"], "missing")):
        with pytest.raises(guards.Refused, match=rule):
            reports.dictionaries(spark, str(tmp_path), locales)


def test_hidden_files_are_refused(tmp_path):
    (tmp_path / "_x.md").write_text("x")
    with pytest.raises(guards.Refused, match="skip"):
        d.checked_root(str(tmp_path))


def test_only_blanks_in_the_punctuation_stage(spark):
    rows = spark.createDataFrame([("a", ",x", ", x", ["punctuation_letter"]), ("b", ",x", "; x", ["punctuation_letter"]), ("c", "x", None, ["lower_upper"])], "id string, observed string, proposed string, triggers array<string>")
    assert [r["key"] for r in spans.proposal_guard(rows).orderBy("key").collect()] == ["b"]
    assert spans.proposal_guard(rows.filter(F.lit(False))).count() == 0
