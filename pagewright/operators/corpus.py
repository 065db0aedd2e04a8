"""Cross-book analytics over occurrences of unknown forms."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .guards import duplicates, violations
from .review import source_faithful
from .vocabulary import first_examples

PENDING = "pending_human_vocabulary_review"
BULK_REPAIR, BULK_SOURCE = "bulk_excluded_all_repair_verified", "bulk_excluded_source_faithful_nonlexical"
APPROVED = ("codex_verified_repair", "human_approved_repair")
#: Notes that mark a bulk decision. Fixed values.
BULK_REPAIR_NOTE = (
    "Human bulk exclusion from this lexicon admission batch: every observed occurrence has an independently approved OCR repair. Occurrence-level repair decisions remain unchanged."
)
BULK_SOURCE_NOTE = (
    "Human bulk lexicon exclusion: every observed occurrence was annotated SOURCE_FAITHFUL_NONLEXICAL_VERIFIED by independent scan review. No OCR repair decisions or persistent vocabulary changed."
)
#: Contractions without their apostrophe. Fixed values.
CONTRACTIONS = "arent cant couldnt didnt doesnt dont hadnt hasnt havent isnt mustnt shouldnt wasnt werent wont wouldnt youre theyre weve ive im thats theres".split()
APOSTROPHES = ("'", "’")


def signals(word: Column, key: Column, before: Column, after: Column, latin: Column, greek: Column) -> Column:
    """Sorted clue labels of a token, or ``no_obvious_signal``.

    ``before`` and ``after`` are the context on either side, null if the span does
    not fit its context. A token at the very edge of its context counts as beside
    an apostrophe, as in the public tool.
    """
    edge = lambda side, sign: side.isNotNull() & ((side == "") | sign.isin(*APOSTROPHES))
    beside = edge(before, F.right(before, F.lit(1))) | edge(after, F.left(after, F.lit(1)))
    labels = F.array_compact(F.array(
        F.when(F.coalesce(beside, F.lit(False)), "adjacent_apostrophe"),
        F.when(key.isin(*CONTRACTIONS), "contraction_like"),
        F.when(greek & ~latin, "greek_script"),
        F.when(word.rlike(r"\p{Nd}") & word.rlike(r"\p{L}"), "mixed_digits_letters"),
        F.when(greek & latin, "mixed_greek_latin"),
        F.when(word.rlike(r"^[IVXLCDMivxlcdm]{4,}\z"), "roman_numeral_like"),
    ))
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("no_obvious_signal")))


def effective_state(findings: DataFrame) -> DataFrame:
    """Findings with ``repair_state`` and ``replacement``: the human decision first, then approved, proposed, source-faithful, none."""
    human, proposed = F.col("human_decision"), F.col("proposed")
    faithful = source_faithful(proposed, F.col("status"), F.col("lexicon_suggestion"), F.col("note"))
    state = (
        F.when(human == "approved", "human_approved_repair").when(human == "rejected", "human_rejected_repair").when(F.col("status") == "approved", "codex_verified_repair")
        .when(proposed.isNotNull(), "proposed_not_verified").when(faithful, "source_faithful_nonlexical").otherwise("no_verified_repair")
    )
    replacement = F.when(human == "approved", F.col("human_replacement")).when(human == "rejected", F.lit(None).cast("string")).otherwise(proposed)
    return findings.withColumn("repair_state", state).withColumn("replacement", replacement)


def form_dispositions(occurrences: DataFrame, decisions: DataFrame) -> DataFrame:
    """``(book, key, word, n, disposition, conflict)`` of each book's forms.

    ``conflict`` marks a bulk decision that its occurrences do not bear out.
    """
    forms = occurrences.groupBy("book", "key").agg(
        F.min_by("observed", "order").alias("word"), F.count("*").alias("n"),
        F.bool_and(F.col("repair_state").isin(*APPROVED)).alias("_repaired"), F.bool_and(F.col("repair_state") == "source_faithful_nonlexical").alias("_faithful"),
    )
    both = forms.join(decisions.select("book", "key", "decision", "note"), ["book", "key"], "left")
    by_repair, by_source = F.col("note") == BULK_REPAIR_NOTE, F.col("note") == BULK_SOURCE_NOTE
    disposition = (
        F.when(F.col("decision").isNull(), PENDING).when(F.col("decision") == "accepted", "human_accepted_vocabulary")
        .when(by_repair, BULK_REPAIR).when(by_source, BULK_SOURCE).otherwise("human_rejected_vocabulary_reason_unclassified")
    )
    rejected = F.col("decision") == "rejected"
    conflict = F.coalesce(rejected & ((by_repair & ~F.col("_repaired")) | (by_source & ~F.col("_faithful"))), F.lit(False))
    return both.select("book", "key", "word", "n", disposition.alias("disposition"), conflict.alias("conflict"))


def book_guards(findings: DataFrame, decisions: DataFrame, forms: DataFrame) -> DataFrame:
    """What makes a book unusable: repeated ids, decisions on unknown forms, bulk decisions that conflict."""
    unknown = decisions.join(findings.select("book", "key").distinct(), ["book", "key"], "left_anti")
    return (
        violations(duplicates(findings, "book", "id"), "duplicate finding id", "id")
        .unionByName(violations(unknown, "decision on unknown form", "key"))
        .unionByName(violations(forms, "bulk decision conflicts with occurrences", "key", F.col("conflict")))
    )


def load_books(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Occurrences of all books with effective state, form disposition and signals."""
    stated = effective_state(findings)
    forms = form_dispositions(stated, decisions).select("book", "key", "disposition")
    return stated.join(forms, ["book", "key"])


def summary(occurrences: DataFrame) -> DataFrame:
    """One row of corpus totals."""
    forms = occurrences.groupBy("key", "book").agg(F.count("*").alias("n"), F.max("disposition").alias("disposition"))
    keys = forms.groupBy("key").agg(F.count("*").alias("book_forms"), F.sum("n").alias("n"), F.count_if(F.col("disposition") == PENDING).alias("pending"), F.sum(F.when(F.col("disposition") == PENDING, F.col("n")).otherwise(0)).alias("pending_n"))
    return keys.agg(F.sum("n").alias("occurrences"), F.sum("book_forms").alias("book_forms"), F.count("*").alias("corpus_forms"), F.sum("pending").alias("pending_forms"), F.sum("pending_n").alias("pending_occurrences"))


def histogram(occurrences: DataFrame, *by: str) -> DataFrame:
    """Occurrences per combination of columns."""
    return occurrences.groupBy(*by).agg(F.count("*").alias("n"))


def book_breakdown(occurrences: DataFrame) -> DataFrame:
    """``(book, disposition, n, forms)``, and subtotals of each book with a null disposition."""
    forms = occurrences.groupBy("book", "disposition", "key").agg(F.count("*").alias("n"))
    return forms.rollup("book", "disposition").agg(F.sum("n").alias("n"), F.count("*").alias("forms")).filter("book IS NOT NULL")


def signals_by_disposition(occurrences: DataFrame) -> DataFrame:
    return occurrences.select("disposition", F.explode("signals").alias("signal")).groupBy("disposition", "signal").agg(F.count("*").alias("n"))


def form_summary(occurrences: DataFrame) -> DataFrame:
    """``(key, word, books, n_books, n, pending, dispositions)`` of each form, pre-aggregated by book and disposition."""
    part = occurrences.groupBy("key", "book", "disposition").agg(F.count("*").alias("n"), F.min(F.struct("book", "order", "observed")).alias("first"))
    by_state = part.groupBy("key", "disposition").agg(F.sum("n").alias("n"), F.collect_set("book").alias("books"), F.min("first").alias("first"))
    entry = F.concat_ws("=", "disposition", F.col("n").cast("string"))
    out = by_state.groupBy("key").agg(
        F.min("first").alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("books")))).alias("books"), F.sum("n").alias("n"),
        F.sum(F.when(F.col("disposition") == PENDING, F.col("n")).otherwise(0)).alias("pending"), F.concat_ws(",", F.array_sort(F.collect_list(entry))).alias("dispositions"),
    )
    return out.select("key", F.col("first.observed").alias("word"), F.concat_ws(",", "books").alias("books"), F.size("books").cast("long").alias("n_books"), "n", "pending", "dispositions")


def top_pending(forms: DataFrame, top: int = 50) -> DataFrame:
    return forms.filter("pending > 0").orderBy(F.desc("pending"), F.desc("n_books"), "key").limit(top)


def recurring(forms: DataFrame, top: int = 50) -> DataFrame:
    """Forms of more than one book."""
    return forms.filter("n_books > 1").orderBy(F.desc("n_books"), F.desc("n"), "key").limit(top)


def bulk_excluded(forms: DataFrame, top: int = 50) -> DataFrame:
    return forms.filter(F.col("dispositions").contains("bulk_excluded_")).orderBy(F.desc("n"), "key").limit(top)


def list_totals(forms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lengths of the ranked lists before any cap."""
    counted = forms.agg(F.count_if(F.col("pending") > 0).alias("pending_total"), F.count_if(F.col("n_books") > 1).alias("recurring_total"), F.count_if(F.col("dispositions").contains("bulk_excluded_")).alias("bulk_excluded_total"))
    return counted.crossJoin(F.broadcast(pairs.agg(F.count("*").alias("repair_pair_total"))))  # one row beside one row


def repair_pairs(occurrences: DataFrame) -> DataFrame:
    """``(observed, replacement, n, n_books)`` of verified repairs."""
    return occurrences.filter(F.col("repair_state").isin(*APPROVED)).groupBy("observed", "replacement").agg(F.count("*").alias("n"), F.count_distinct("book").alias("n_books"))


def edit_operations(pairs: DataFrame) -> DataFrame:
    """``(operation, old, new, n)`` of the edits that turn observed into replacement, by sequence alignment of each distinct pair."""

    kind = "array<struct<operation:string,old:string,new:string>>"

    @F.arrow_udf(kind)
    def edits(before: pa.Array, after: pa.Array) -> pa.Array:
        import difflib

        out = []
        for a, b in zip(before.to_pylist(), after.to_pylist(), strict=True):
            found = difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).get_opcodes()
            out.append([{"operation": op, "old": a[i:j], "new": b[k:m]} for op, i, j, k, m in found if op != "equal"])
        return pa.array(out, pa.list_(pa.struct([("operation", pa.string()), ("old", pa.string()), ("new", pa.string())])))

    distinct = pairs.groupBy("observed", "replacement").agg(F.sum("n").alias("n")).filter("replacement IS NOT NULL")
    return distinct.select("n", F.explode(edits("observed", "replacement")).alias("e")).groupBy("e.operation", "e.old", "e.new").agg(F.sum("n").alias("n"))


def pair_order() -> list[Column]:
    """Repair pairs: most frequent first."""
    return [F.desc("n"), F.col("observed"), F.col("replacement")]


def signal_histogram(occurrences: DataFrame) -> DataFrame:
    """``(book, key, signal, n)``: the signals of each book's forms."""
    return occurrences.select("book", "key", F.explode("signals").alias("signal")).groupBy("book", "key", "signal").agg(F.count("*").alias("n"))


def form_details(occurrences: DataFrame) -> DataFrame:
    """``(key, signals, repair_states)`` of each form: the union of its signals, and its repair states with their numbers."""
    tags = occurrences.select("key", F.explode("signals").alias("signal")).distinct().groupBy("key").agg(F.concat_ws(",", F.array_sort(F.collect_list("signal"))).alias("signals"))
    entry = F.concat_ws("=", "repair_state", F.col("n").cast("string"))
    states = occurrences.groupBy("key", "repair_state").agg(F.count("*").alias("n")).groupBy("key").agg(F.concat_ws(",", F.array_sort(F.collect_list(entry))).alias("repair_states"))
    return tags.join(states, "key")  # a form has a handful of signals and states


# ---- investigation routes ----------------------------------------------------------

#: Beginnings of contractions whose ending may stand outside the span, and note patterns. Fixed values.
PREFIXES = "aren couldn didn doesn don hadn hasn haven isn mustn shouldn wasn weren won wouldn".split()
NAME_NOTE = r"(?i)\b(?:proper name|surname|personal name|person's name)\b"
TERM_NOTE = r"(?i)\b(?:technical term|specialized term|domain-specific term)\b"
NO_APOSTROPHE_NOTE = r"(?i)\b(?:without an apostrophe|with no apostrophe|no apostrophe|apostrophe[- ]less)\b"
MARKERS = ("SCAN_VERIFIED:", "SCAN_UNRESOLVED:", "SCAN_BLOCKED:")


def classify(occurrences: DataFrame) -> DataFrame:
    """Occurrences with ``clues``, ``route`` and ``duplicate_suffix``; the first test that holds names the route.

    Needs ``observed, after, signals, repair_state, replacement, disposition, proposal_note, note``.
    """
    observed, after, state = F.col("observed"), F.col("after"), F.col("repair_state")
    proposal, verifier = F.coalesce("proposal_note", F.lit("")), F.coalesce("note", F.lit(""))
    both = F.concat_ws(" ", proposal, verifier)
    split = F.lower(observed).isin(*PREFIXES) & after.rlike(r"^['’]t(?!\p{L})")
    suffix = F.when(F.coalesce(split, F.lit(False)), F.left(after, F.lit(2)))
    has = lambda s: F.array_contains("signals", s)
    tag = F.coalesce(*(F.when(proposal.startswith(m), m[:-1].lower()) for m in MARKERS))
    approved = state.isin(*APPROVED)
    printed = has("contraction_like") & verifier.rlike(NO_APOSTROPHE_NOTE)
    name, term = both.rlike(NAME_NOTE), both.rlike(TERM_NOTE)
    duplicate = F.coalesce(suffix.isNotNull() & approved & (T.plain_apostrophe(F.col("replacement")) == T.plain_apostrophe(F.concat(observed, suffix))), F.lit(False))
    clues = F.array_sort(F.array_compact(F.array(
        F.when(suffix.isNotNull(), "exact_contraction_prefix_span"), F.when(has("contraction_like"), "contraction_like_spelling"),
        F.when(has("mixed_greek_latin"), "mixed_greek_latin_characters"), F.when(has("greek_script"), "greek_characters"), F.when(has("adjacent_apostrophe"), "adjacent_apostrophe"),
        F.when(name, "agent_note_mentions_proper_name"), F.when(term, "agent_note_mentions_technical_term"), F.when(printed, "verifier_note_claims_printed_without_apostrophe"),
        F.concat(F.lit("proposer_note_"), tag), F.when(state == "source_faithful_nonlexical", "structured_source_faithful_nonlexical").when(approved, "structured_approved_repair_candidate"),
    )))
    route = (
        F.when(duplicate, "repair_span_safety_audit").when(suffix.isNotNull(), "tokenizer_boundary_experiment").when(approved, "existing_verified_repair_candidate")
        .when(F.col("disposition") != PENDING, "previously_triaged").when(printed, "book_scoped_recognition_experiment")
        .when(state == "source_faithful_nonlexical", "source_faithful_nonlexical_candidate").when(tag.isin("scan_unresolved", "scan_blocked"), "targeted_source_inspection")
        .when(name | term, "lexical_coverage_experiment").otherwise("unclassified_review_candidate")
    )
    return occurrences.withColumn("clues", clues).withColumn("route", route).withColumn("duplicate_suffix", duplicate)


def route_counts(classified: DataFrame) -> DataFrame:
    """``(route, n, pending)``."""
    return classified.groupBy("route").agg(F.count("*").alias("n"), F.count_if(F.col("disposition") == PENDING).alias("pending"))


def clue_counts(classified: DataFrame) -> DataFrame:
    """``(clue, n)`` among pending occurrences."""
    return classified.filter(F.col("disposition") == PENDING).select(F.explode("clues").alias("clue")).groupBy("clue").agg(F.count("*").alias("n"))


def route_form_groups(classified: DataFrame) -> DataFrame:
    """``(route, key, n, pending, n_books)``."""
    return classified.groupBy("route", "key").agg(F.count("*").alias("n"), F.count_if(F.col("disposition") == PENDING).alias("pending"), F.count_distinct("book").alias("n_books"))


def form_examples(occurrences: DataFrame, n: int = 3) -> DataFrame:
    """The first occurrences of each form, in book and page order."""
    return first_examples(occurrences, ["key"], ["book", "order"], n)


def route_details(classified: DataFrame) -> DataFrame:
    """``(route, key, dispositions, books)``: disposition histogram and books of each route's forms."""
    entry = F.concat_ws("=", "disposition", F.col("n").cast("string"))
    part = classified.groupBy("route", "key", "disposition").agg(F.count("*").alias("n"), F.collect_set("book").alias("b"))
    return part.groupBy("route", "key").agg(
        F.concat_ws(",", F.array_sort(F.collect_list(entry))).alias("dispositions"), F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_list("b"))))).alias("books"),
    )


def route_examples(classified: DataFrame, n: int = 3) -> DataFrame:
    """The first occurrences of each route's forms, in report order."""
    return first_examples(classified, ["route", "key"], ["book", "page", "start_byte", "id"], n)


def duplicate_suffixes(classified: DataFrame) -> DataFrame:
    """One row: repairs that may repeat an ending which stands behind their span."""
    return classified.agg(F.count_if("duplicate_suffix").alias("possible_duplicate_suffix_repairs"))


def group_order() -> list[Column]:
    """Route groups: most pending, most occurrences, route, key."""
    return [F.desc("pending"), F.desc("n"), F.col("route"), F.col("key")]
