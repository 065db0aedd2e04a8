"""Operators against plain Python on small hand-made cases."""

import difflib
import json
import re

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import corpus, guards, repairs, review, spans, vocabulary
from pagewright.plans import queries, workflow
from pagewright.sources import directories as d

PAGE = "élan,word.Next U.S.A today,zqxwvv.\r\n"


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([(1, PAGE), (2, "An unchanged page."), (3, ""), (4, "🙂é,a漢.B c;d")], "page long, text string")


def test_islands(page):
    got = {(r["page"], r["start_byte"]): r for r in spans.whitespace_findings(page).collect()}
    assert [(r["observed"], r["proposed"], r["rule"]) for k, r in sorted(got.items()) if k[0] == 1] == [(",word.Next", ", word. Next", "punctuation_letter"), (".S.A", ". S. A", "period_capital"), (",zqxwvv", ", zqxwvv", "punctuation_letter")]
    for (p, start), r in got.items():
        raw = {1: PAGE, 4: "🙂é,a漢.B c;d"}[p].encode()
        assert raw[start : r["end_byte"]].decode() == r["observed"]
    assert {r["rule"]: r["n"] for r in spans.counts_by_rule(spans.whitespace_findings(page)).collect()} == {"punctuation_letter": 4, "period_capital": 3}


def test_generic_merge_equals_islands(page):
    hits = spans.adjacency_hits(page).filter(F.col("rule") != "lower_upper")
    merged = {(r["page"], r["start"], r["end"]) for r in spans.combine_spans(hits).collect()}
    assert merged == {(r["page"], r["start"], r["end"]) for r in spans.whitespace_findings(page).collect()}


def test_round_trip(page):
    edits = spans.whitespace_findings(page)
    derived = repairs.apply_repairs(page, edits)
    assert {r["page"]: r["derived"] for r in derived.collect()}[1] == "élan, word. Next U. S. A today, zqxwvv.\r\n"
    back = {r["page"]: r["restored"] for r in repairs.reverse_repairs(derived, edits).collect()}
    assert back == {r["page"]: r["text"] for r in page.collect()}
    assert repairs.repair_totals(derived, edits).first().asDict() == {"approved_findings": 6, "page_count": 4, "changed_pages": 2}


def test_guards_refuse(page):
    edits = spans.whitespace_findings(page)
    guards.require(*repairs.edit_guards(page, edits))
    with pytest.raises(guards.Refused, match="bytes"):
        guards.require(*repairs.edit_guards(page, edits.withColumn("observed", F.lit("x"))))
    with pytest.raises(guards.Refused, match="overlapping"):
        guards.require(repairs.edit_guards(page, edits.withColumn("end_byte", F.col("end_byte") + 30))[3])


@pytest.mark.parametrize(("shown", "words"), [
    ("A naïve café Straße 東京大学校 étude", ["naïve", "café", "Straße", "東京大学校", "étude"]), ("<b class='some'>word</b> &eacute; \\emph{text} [link](target) ![alt text](image)", ["word", "text", "link"]),
    ("before\n```\ncode here\n```\nafter", ["before", "after"]), ("text\n~~~\nopen forever", ["text"]), ("`code` and ``more `code` here`` done", ["done"]), ("some_name the2ndeditionofthetreatise", ["ndeditionofthetreatise"]), ("<!-- hidden text --> seen", ["seen"]),
])
def test_letter_runs(shown, words):
    got = T.letter_runs(shown)
    assert [g[4] for g in got if len(g[4]) >= 4] == [w for w in words if w == "étude" or sum(c.isalpha() for c in w) >= 4] or [g[4].replace("é", "é") for g in got] == words
    for start, end, a, b, run in got:
        assert shown[start:end] == run and shown.encode()[a:b].decode() == run


def test_context_and_keys(spark):
    text = "ä" * 300 + "HERE" + "🙂" * 300
    df = spark.createDataFrame([(text, 300, 304)], "text string, start int, end int").select(T.ocr_context(F.col("text"), F.col("start"), F.col("end")).alias("c"))
    c = df.first()["c"]
    assert text.encode()[c["start_byte"] : c["end_byte"]].decode() == c["text"] == "ä" * 160 + "HERE" + "🙂" * 160
    keys = spark.createDataFrame([("Straße",), ("STRASSE",), ("é",), ("é",), (None,)], "w string").select(T.canonical("w").alias("k")).collect()
    assert [r["k"] for r in keys] == ["strasse", "strasse", "é", "é", None]


def test_merge_is_exactly_once(spark):
    source = spark.createDataFrame([(i, f"f{i}", "x", None, None) for i in range(4)], "position long, id string, observed string, status string, note string")
    rows = [("a", 0, "f0", "x", "approved", None), ("a", 1, "f2", "x", None, "no"), ("b", 0, "f1", "x", "approved", None), ("b", 1, "f3", "x", "approved", None)]
    kind = "file string, ordinal long, id string, observed string, status string, note string"
    good = spark.createDataFrame(rows, kind)
    assert review.merge_guards(source, good, review.REVIEW_FIELDS).count() == 0 and review.unreviewed(good).count() == 0
    assert {r["id"] for r in review.review_exceptions(review.merge(source, good, review.REVIEW_FIELDS)).collect()} == {"f2"}
    for change, rule in (
        (rows[:3], "missing finding"), (rows + [("c", 0, "f1", "x", "approved", None)], "duplicate finding"), (rows + [("c", 0, "f9", "x", "approved", None)], "unknown finding"),
        ([("a", 5, *rows[0][2:]), *rows[1:]], "finding order changed"), ([(*rows[0][:3], "y", *rows[0][4:]), *rows[1:]], "unauthorised edit"),
    ):
        assert {r["rule"] for r in review.merge_guards(source, spark.createDataFrame(change, kind), review.REVIEW_FIELDS).collect()} == {rule}
    assert review.unreviewed(spark.createDataFrame([("a", 0, "f0", "x", None, " "), ("a", 0, "f1", "x", "maybe", "n")], kind)).count() == 2


def test_bulk_reject_is_all_or_nothing(spark):
    groups = spark.createDataFrame([("k", 2, 2, 2, 0, False), ("m", 2, 1, 1, 0, False)], "key string, n long, repairs long, verified long, source_faithful long, already_known boolean")
    decisions = spark.createDataFrame([], "key string, decision string, finding_id string, note string")
    ask = lambda *k: review.bulk_reject(groups, decisions, spark.createDataFrame([(x,) for x in k], "key string"), "n")
    bad, new = ask("k")
    assert bad.count() == 0 and new.first()["decision"] == "rejected"
    assert ask("k", "m")[0].count() == 1 and ask("nowhere")[0].count() == 1
    rules = lambda keys: {r["rule"] for r in review.bulk_reject(groups, decisions, keys, "n")[0].collect()}
    asked = spark.createDataFrame([("k",), ("k",)], "key string")
    assert rules(asked) == {"form named twice"} and rules(asked.limit(0)) == {"number of forms"}
    assert rules(spark.range(review.MOST_FORMS + 1).selectExpr("CAST(id AS STRING) AS key")) == {"form not ready for bulk rejection", "number of forms"}


def test_segments():
    known = {"of": 9, "the": 20, "priori": 2, "a": 1, "pri": 1, "ori": 1}
    assert vocabulary.segmentations("ofthe", known)[0][1] == ("of", "the")
    assert vocabulary.segmentations("priori", known) == [] and vocabulary.segmentations("x" * 97, known) == [] and vocabulary.segmentations("", known) == []
    assert ("a", "priori") in [s[1] for s in vocabulary.segmentations("apriori", known)]


def test_segment_hints_of_a_large_dictionary(spark):
    """Joining the dictionary gives what broadcasting it gives, repeated, empty and null words included."""
    counts = spark.createDataFrame([("of", 9), ("the", 20), ("priori", 2), ("a", 1), ("straße", 4), ("strasse", 5), ("x" * 40, 3)], "key string, n long")
    forms = spark.createDataFrame([(w,) for w in ["ofthe", "ofthe", "OfThe", "apriori", "the", "", None, "a" * 97, "aofa", "thestrasse", "x" * 40, "zz"]], "observed string")
    small, large = (sorted(map(tuple, vocabulary.segment_hints(spark, forms, counts, limit=n).collect())) for n in (10, 0))
    assert small == large and len([r for r in small if r[0] == "ofthe"]) == 2 and any(r[0] == "apriori" for r in small)
    assert vocabulary.segment_hints(spark, forms.limit(0), counts, limit=0).count() == 0


def test_short_known_words_are_counted_and_split(spark):
    """Known words of every length count where they are visible, also beside an underscore, and serve as pieces."""
    words = vocabulary.known_words(spark.createDataFrame([("A man of the Élan a priori",)], "text string"), least=1)
    texts = spark.createDataFrame([("Of the_man <a of='the'>the</a> `of` ÉLAN a2a unknown",), ("a priori man",), (None,)], "text string")
    counts = vocabulary.known_counts(texts, words)
    assert {r["key"]: r["n"] for r in counts.collect()} == {"of": 1, "the": 2, "man": 2, "élan": 1, "a": 3, "priori": 1}
    forms = spark.createDataFrame([("ofthe",), ("apriori",), ("ofaman",)], "observed string")
    best = {r["observed"]: r["proposed"] for r in vocabulary.segment_hints(spark, forms, counts).collect() if r["rank"] == 0}
    assert best == {"ofthe": "of the", "apriori": "a priori", "ofaman": "of a man"}


def test_segment_hints_query_splits_the_documents(spark, tmp_path):
    """Unknown forms of the documents with counts over the documents, against plain Python."""
    texts = ["We went to The inn.OfThe café unaofthe <b>ofofof</b>", "Soit is of the cafétable zzzz of", None]
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "we went to the inn of café una so it is a table un")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pages = ["We went toThe inn.OfThe café unaofthe       ofofof    ", "Soit is of the cafétable zzzz of"]
    words = set("we went to the inn of café una so it is a table un".split())
    runs = [r for p in pages for r in re.findall(r"[^\W\d_]+", p)]
    known = {w: sum(r.lower() == w for r in runs) for w in words}
    unknown = {r for r in runs if len(r) >= 4 and r.lower() not in words}
    want = {(w, k, " ".join(p), round(s, 4)) for w in unknown for k, (s, p) in enumerate(vocabulary.segmentations(w, known))}
    got = queries.QUERIES["segment_hints"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {("OfThe", 0, "Of The"), ("toThe", 0, "to The"), ("cafétable", 0, "café table")} <= {g[:3] for g in want} and {"unaofthe", "ofofof", "Soit"} <= {g[0] for g in want}


def test_edit_operations(spark):
    pairs = spark.createDataFrame([("mistkae", "mistake", 2), ("ab", "ab", 1)], "observed string, replacement string, n long")
    want = {}
    for op, i, j, k, m in difflib.SequenceMatcher(None, "mistkae", "mistake", autojunk=False).get_opcodes():
        if op != "equal":
            want[op, "mistkae"[i:j], "mistake"[k:m]] = 2
    assert {(r["operation"], r["old"], r["new"]): r["n"] for r in corpus.edit_operations(pairs).collect()} == want


def test_signals_and_routes(spark):
    rows = [("doesn", "don ", "'t go", "doesn't", "codex_verified_repair"), ("didnt", "x ", " y", None, "no_verified_repair"), ("σkiεpov", "", "x", None, "no_verified_repair"), ("XIVI", "a ", " b", None, "no_verified_repair"), ("ab1c", "a ", " b", None, "source_faithful_nonlexical")]
    df = spark.createDataFrame([(*r, corpus.PENDING, None, "no apostrophe", "b") for r in rows], "observed string, before string, after string, replacement string, repair_state string, disposition string, proposal_note string, note string, book string")
    df = df.withColumn("s", T.scripts("observed"))
    df = df.withColumn("signals", corpus.signals(F.col("observed"), T.canonical("observed"), F.col("before"), F.col("after"), F.col("s.latin"), F.col("s.greek")))
    got = {r["observed"]: (r["signals"], r["route"], r["duplicate_suffix"]) for r in corpus.classify(df).collect()}
    assert got["doesn"] == (["adjacent_apostrophe"], "repair_span_safety_audit", True)
    assert got["didnt"] == (["contraction_like"], "book_scoped_recognition_experiment", False)
    assert got["σkiεpov"][0] == ["adjacent_apostrophe", "mixed_greek_latin"]  # the very edge of a context counts
    assert got["XIVI"][0] == ["roman_numeral_like"] and got["ab1c"] == (["mixed_digits_letters"], "source_faithful_nonlexical_candidate", False)


def book(tmp_path):
    scans, art = tmp_path / "scans", tmp_path / "art"
    scans.mkdir(), (art / "pages").mkdir(parents=True)
    for name in ("page001.JPG", "page002.jpg", "page009.png"):
        (scans / name).write_bytes(b"image")
    (art / "pages/page001.md").write_bytes(PAGE.encode())
    (art / "pages/page002.md").write_bytes("An unchangedPage.\r\n".encode())
    (art / "pages/page001_res.json").write_text(json.dumps({"parsing_res_list": [{"block_id": 1, "block_label": "text", "block_content": "élan, word"}, {"block_id": 2, "block_label": "number", "block_content": "7"}], "model_settings": {"markdown_ignore_labels": ["number"]}}))
    (art / "pages/page002_res.json").write_text("{")
    (art / "crop one+two.png").write_bytes(b"\0\1")
    return scans, art


def test_probe_and_execute(spark, tmp_path):
    scans, art = book(tmp_path)
    words = spark.createDataFrame([("élan",), ("word",), ("next",), ("today",), ("page",)], "key string")
    got = {(r["page"], r["rule"], r["observed"]) for r in workflow.probe(spark, str(scans), str(art), words).collect()}
    assert {("page001", "json_markdown_difference:text", "élan, word"), ("page002", "invalid_json", None), ("page009", "missing_markdown", None), ("page009", "missing_json", None), ("page001", "unrecognized_token", "zqxwvv"), ("page002", "lower_upper", "unchangedPage")} <= got
    edits = spans.whitespace_findings(d.texts(d.files(spark, str(art)))).filter("observed = ',zqxwvv'")
    report = workflow.execute(spark, str(art), edits, str(tmp_path / "out"))
    assert (tmp_path / "out/pages/page001.md").read_bytes() == PAGE.replace(",z", ", z").encode()
    assert (report["approved_findings"], report["page_count"], report["changed_pages"]) == (1, 2, 1) and len(report["changes"]) == 1
    assert (tmp_path / "out/crop one+two.png").read_bytes() == b"\0\1"
    with pytest.raises(guards.Refused):
        workflow.execute(spark, str(art), edits, str(tmp_path / "out"))


def test_readers_and_sinks(tmp_path, spark):
    (tmp_path / "twice.json").write_text('{"a": 1, "a": 2}')
    with pytest.raises(guards.Refused, match="duplicate"):
        d.read_strict(str(tmp_path / "twice.json"))
    d.write_report({"k": "é"}, str(tmp_path / "r.json"))
    with pytest.raises(FileExistsError):
        d.write_report({}, str(tmp_path / "r.json"))
    with pytest.raises(FileExistsError):
        d.publish_pair({str(tmp_path / "n.json"): {}, str(tmp_path / "r.json"): {}})
    assert not (tmp_path / "n.json").exists() and not list(tmp_path.glob("*.tmp"))
    doc, sha = d.read_strict(str(tmp_path / "r.json"))
    assert d.swap(str(tmp_path / "r.json"), sha, {"k": 2}) and not d.swap(str(tmp_path / "r.json"), "x", {"k": 2})
    with pytest.raises(guards.Refused, match="stale"):
        d.swap(str(tmp_path / "r.json"), sha, {"k": 3})
    (tmp_path / "names").write_text("# list\nPlato\n\nXenophon\n")
    assert {r["key"] for r in d.name_list(spark, str(tmp_path / "names")).collect()} == {"plato", "xenophon"}
    (tmp_path / "names").write_text("Plato\nPLATO\n")
    with pytest.raises(guards.Refused, match="duplicate"):
        d.name_list(spark, str(tmp_path / "names"))


def test_single_pass_equals_joined_forms(spark):
    pages = spark.createDataFrame([(1, "b", "Élan vital naïve <b>word</b> Word élan"), (2, "c", None), (3, "b", "`code` known unknown")], "page long, book string, text string")
    words = spark.createDataFrame([("élan",), ("known",)], "key string")
    columns = ["page", "book", "ordinal", "start_byte", "end_byte", "observed", "key"]
    one = {tuple(r) for r in vocabulary.unknown_in(spark, pages, words).select(*columns).collect()}
    assert one == {tuple(r) for r in vocabulary.unknown_in(spark, pages, words, limit=1).select(*columns).collect()} and len(one) == 5
    assert vocabulary.unknown_in(spark, pages.limit(0), words).count() == 0


def test_positions_are_those_of_a_sort(spark):
    from pagewright.session import positions

    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS k").repartition(7)
    assert all(r["k"] == r["position"] for r in positions(spark, df, "k").collect())
    assert positions(spark, df.limit(0), "k").count() == 0


def test_lexicon_guards(spark):
    rows = [("Word", "f", "a", "b", "seen"), ("word", "f", "a", "b", "seen"), ("two words", "f", "a", "b", "seen"), ("other", "", "a", "b", "seen"), ("third", "f", "a", "b", " ")]
    entries = spark.createDataFrame(rows, "word string, finding_id string, source_report_sha256 string, source_scans_sha256 string, note string")
    got = {(r["rule"], r["key"]) for r in review.lexicon_guards(entries).collect()}
    assert got == {("duplicate word", "word"), ("malformed entry", "two words"), ("malformed entry", "other"), ("malformed entry", "third")}


def test_overrides_that_undo_an_admission_are_refused(spark):
    findings = spark.createDataFrame([(i, w, p, None, None, s, None) for i, w, p, s in (("a", "Word", None, None), ("b", "wrod", "word", "approved"), ("c", "Other", None, None))],
        "id string, observed string, proposed string, proposal_source string, evidence string, status string, note string")
    admitted = spark.createDataFrame([("a", "word"), ("b", "Word"), ("c", "other")], "finding_id string, word string")
    overrides = spark.createDataFrame([("a", "approved", "Ward", "seen"), ("b", "rejected", None, "seen")], "id string, decision string, replacement string, human_note string")
    assert [r["key"] for r in review.override_rollback(findings, overrides.limit(0), admitted).collect()] == []
    assert sorted(r["key"] for r in review.override_rollback(findings, overrides, admitted).collect()) == ["a", "b"]


def test_stale_snapshots(spark):
    recorded = spark.createDataFrame([("scans", "1"), ("lexicon", "2"), ("gone", "3")], "name string, sha256 string")
    now = spark.createDataFrame([("scans", "1"), ("lexicon", "x")], "name string, sha256 string")
    assert sorted(r["key"] for r in review.stale(recorded, now).collect()) == ["gone", "lexicon"]


def test_repeated_endings_are_not_executed(spark):
    page = spark.createDataFrame([(1, "It doesn't.")], "page long, text string")
    edit = spark.createDataFrame([(1, "x", 3, 8, "doesn", "doesn't")], "page long, id string, start_byte int, end_byte int, observed string, proposed string")
    with pytest.raises(guards.Refused, match="repeats"):
        guards.require(*repairs.edit_guards(page, edit))


@pytest.mark.parametrize("shown", ["a ```` b ``` c ```` d", "```` x\n```\n```` y\nz", "  ~~~x\n~~~~ \r\nafter `a\n`b` c`", "\\`x` `y`", "é <b title='🙂'>é</b>", "`<b` c>`", "``` a", "```\nx\x0b```\ny"])
def test_mask_keeps_lengths(shown):
    blank = T.blanked(shown)
    assert len(blank) == len(shown) and len(blank.encode()) == len(shown.encode())
    assert all(b in (a, *T._BLANKS) for a, b in zip(shown, blank))
    stretches = T.hidden(shown)
    assert stretches == T.merged(stretches) and all(blank[i] == shown[i] for i in range(len(shown)) if not any(a <= i < b for a, b in stretches))


def test_stream_of_pages(spark, page, tmp_path):
    from pagewright.streaming.probe import stream_findings

    page.write.parquet(f"{tmp_path}/in")
    stream = stream_findings(spark, f"{tmp_path}/in").select("id", "proposed").writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    stream.awaitTermination(120)
    want = {(r["id"], r["proposed"]) for r in spans.whitespace_findings(page).collect()}
    assert {tuple(r) for r in spark.table("found").collect()} == want
