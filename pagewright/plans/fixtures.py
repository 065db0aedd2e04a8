"""Inputs of the registered queries, derived from the driver's tables, in DataFrames and in SQL alike.

The tables hold clean text, so defects and reviews are derived: blanks after
punctuation are dropped, words known to ``benchmark`` count as vocabulary, and
review states follow from page and position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, vocabulary
from ..session import written

#: Room for a page's tokens in the order of all tokens.
PAGE_STEP = 1 << 32
FAITHFUL_NOTE = "SOURCE_FAITHFUL_NONLEXICAL_VERIFIED: checked against the scan"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.col("source").alias("book"), "text")


def corrupted(spark: SparkSession, sf: str) -> DataFrame:
    """``(page, book, original, text)``: documents without the blank after punctuation."""
    return documents(spark, sf).select("page", "book", F.col("text").alias("original"), F.regexp_replace("text", r"([,;:!?.]) ", "$1").alias("text"))


def glued(spark: SparkSession, sf: str) -> DataFrame:
    """Corrupted documents that also lack the blank between a small letter and a capital."""
    return corrupted(spark, sf).withColumn("text", F.regexp_replace("text", "([a-z]) ([A-Z])", "$1$2"))


def edits(findings: DataFrame) -> DataFrame:
    """Approved findings: those with a proposal whose start is not a multiple of five."""
    return findings.filter(F.col("proposed").isNotNull() & (F.col("start_byte") % 5 != 0))


def words(spark: SparkSession, sf: str, least: int = 4) -> DataFrame:
    return vocabulary.known_words(table(spark, sf, "benchmark"), least)


def unknown(spark: SparkSession, sf: str, plain: bool = False) -> DataFrame:
    """Unknown tokens of documents with book, id and order."""
    found = vocabulary.unknown_in(spark, documents(spark, sf), words(spark, sf), plain)
    name = F.concat_ws(":", F.col("page").cast("string"), F.lit("unrecognized_token"), F.col("start_byte").cast("string"))
    return found.withColumn("id", name).withColumn("order", F.col("page") * PAGE_STEP + F.col("ordinal"))


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown tokens with odd spellings mixed in, proposals, verdicts, notes and human decisions."""
    base = unknown(spark, sf).withColumn("m", (F.col("page") * 31 + F.col("ordinal")) % 12).withColumn("s", F.col("page") + F.col("ordinal"))
    kind = F.col("ordinal") % 9
    word = F.when(kind == 0, "didnt").when(kind == 1, F.concat("observed", F.lit("7"))).when(kind == 2, "XIVI").when(kind == 3, "doesn").otherwise(F.col("observed"))
    base = base.withColumn("observed", word).withColumn("key", F.when(kind == 0, "didnt").when(kind == 1, F.concat("key", F.lit("7"))).when(kind == 2, "xivi").when(kind == 3, "doesn").otherwise(F.col("key")))
    m, s = F.col("m"), F.col("s")
    fixed = F.when(F.col("observed") == "doesn", "doesn't").otherwise(F.concat("observed", F.lit("e")))
    proposed = F.when(m <= 2, fixed).when(m == 3, F.concat("observed", F.lit("x")))
    note = F.when(m == 4, FAITHFUL_NOTE).when(m == 5, "SOURCE_FAITHFUL_NONLEXICAL_VERIFIED: short").when(m == 6, "a proper name, printed without an apostrophe").when(m == 7, "a technical term").otherwise("checked")
    proposal_note = F.when(m == 8, "SCAN_BLOCKED: torn page").when(m == 9, "SCAN_UNRESOLVED: blurred").when(m == 10, "SCAN_VERIFIED: clear")
    human = F.when(s % 17 == 0, "approved").when((s % 17 == 1) & (m <= 3), "rejected")
    return base.select(
        "book", "page", "ordinal", "order", "id", "start_byte", "end_byte", "observed", "key", proposed.alias("proposed"),
        F.when(m <= 2, "approved").alias("status"), note.alias("note"), proposal_note.alias("proposal_note"), (m == 11).alias("lexicon_suggestion"),
        human.alias("human_decision"), F.when(s % 17 == 0, F.concat("observed", F.lit("h"))).alias("human_replacement"),
        F.when(s % 5 == 0, "x'").when(s % 5 == 1, "").otherwise("x ").alias("before"), F.when(s % 7 == 0, "'t is").when(s % 7 == 1, "’tis").otherwise(". ").alias("after"),
    )


def decisions(stated: DataFrame) -> DataFrame:
    """``(book, key, decision, note)`` on some forms, bulk ones where all occurrences allow it."""
    forms = stated.groupBy("book", "key").agg(F.bool_and(F.col("repair_state").isin(*corpus.APPROVED)).alias("r"), F.bool_and(F.col("repair_state") == "source_faithful_nonlexical").alias("f"))
    h = F.length("key") % 4
    decision = F.when(h == 0, "accepted").when((h == 1) | F.col("r") | F.col("f"), "rejected")
    note = F.when(h == 0, "seen").when(h == 1, "no word").when(F.col("r"), corpus.BULK_REPAIR_NOTE).when(F.col("f"), corpus.BULK_SOURCE_NOTE)
    return forms.select("book", "key", decision.alias("decision"), note.alias("note")).filter("decision IS NOT NULL")


def occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Everything the corpus analytics read: state, disposition and signals of each finding."""
    rows = written(spark, findings(spark, sf), "findings")  # read three times below
    out = corpus.load_books(rows, decisions(corpus.effective_state(rows)))
    # the words are Latin by construction, so no script test is needed
    return out.withColumn("signals", corpus.signals(F.col("observed"), F.col("key"), F.col("before"), F.col("after"), F.lit(True), F.lit(False)))


def reviews(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Whitespace findings in order, and the same in four batches with a verdict each."""
    from ..operators import spans

    found = spans.whitespace_findings(corrupted(spark, sf)).filter("proposed IS NOT NULL").select("id", "page", "start_byte", "end_byte", "observed", "proposed")
    source = found.withColumn("position", F.col("page") * PAGE_STEP + F.col("start_byte")).withColumn("status", F.lit(None).cast("string")).withColumn("note", F.lit(None).cast("string"))
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("page")).agg(F.max("quality").alias("q"))
    done = source.drop("status", "note").join(labels, "page", "left")
    done = done.withColumn("status", F.when(F.col("q") == 1, "approved")).withColumn("note", F.when(F.coalesce("q", F.lit(0)) != 1, "looked at")).drop("q")
    return source, done.withColumn("file", F.col("page") % 4).withColumn("ordinal", F.col("position"))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown tokens as a report's findings: rule and triggers by page, a block on some pages."""
    rows = unknown(spark, sf).select("id", "page", "start_byte", "observed", "key", "order")
    both, upper = F.array(F.lit("lower_upper"), F.lit("unrecognized_token")), F.array(F.lit("lower_upper"))
    triggers = F.when(F.col("page") % 4 == 0, both).when(F.col("page") % 7 == 0, upper).otherwise(F.array(F.lit("unrecognized_token")))
    rows = rows.withColumn("triggers", triggers).withColumn("rule", F.element_at("triggers", 1)).withColumn("proposed", F.lit(None).cast("string"))
    return rows.withColumn("block_id", F.when(F.col("page") % 3 == 0, F.lit("7")))


# ---- the same in SQL -------------------------------------------------------------

KEY = "replace(lower(nfc_normalize({0})), 'ß', 'ss')"


def sql_spans(name: str, source: str, pattern: str, keep: str = "page") -> str:
    """Matches of a pattern with offsets: ``{name}({keep}, i, observed, start, start_byte)``."""
    return f"""
{name}_a AS (SELECT {keep}, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM {source}),
{name}_b AS (SELECT {keep}, generate_subscripts(hits, 1) AS i, unnest(hits) AS observed, unnest(list_slice(gaps, 1, len(hits))) AS gap FROM {name}_a),
{name} AS (SELECT {keep}, i, observed, CAST(sum(length(gap) + length(observed)) OVER w - length(observed) AS BIGINT) AS start,
    CAST(sum(strlen(gap) + strlen(observed)) OVER w - strlen(observed) AS BIGINT) AS start_byte
  FROM {name}_b WINDOW w AS (PARTITION BY page ORDER BY i))"""


SQL_CORRUPTED = r"corrupted AS (SELECT doc_id AS page, source AS book, text AS original, regexp_replace(text, '([,;:!?.]) ', '\1', 'g') AS text FROM documents)"
SQL_ISLAND = r"(?:[,;:!?][A-Za-z][A-Za-z0-9]*|\.[A-Z][A-Za-z0-9]*)+"
SQL_FINDINGS = f"""{SQL_CORRUPTED},{sql_spans("spans", "corrupted", SQL_ISLAND)},
found AS (SELECT page, i, observed, start, start_byte, start_byte + strlen(observed) AS end_byte,
    CASE WHEN observed[1] = '.' THEN 'period_capital' ELSE 'punctuation_letter' END AS rule,
    regexp_matches(observed, '[,;:!?]') AS has_punctuation, contains(observed, '.') AS has_period,
    regexp_replace(regexp_replace(observed, '([,;:!?])([A-Za-z])', '\\1 \\2', 'g'), '\\.([A-Z])', '. \\1', 'g') AS fixed FROM spans),
findings AS (SELECT page || ':' || rule || ':' || start_byte AS id, *, CASE WHEN fixed <> observed THEN fixed END AS proposed FROM found)""".replace("\\\\", "\\")
SQL_EDITS = f"{SQL_FINDINGS}, edits AS (SELECT * FROM findings WHERE proposed IS NOT NULL AND start_byte % 5 <> 0)"

SQL_UNKNOWN = rf"""
docs AS (SELECT doc_id AS page, source AS book, text FROM documents),{sql_spans("tokens", "docs", r"[\p{L}\p{M}]{4,}", "page, book")},
words AS (SELECT DISTINCT {KEY.format("w")} AS key FROM (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}]{{4,}}')) AS w FROM benchmark)),
keyed AS (SELECT *, {KEY.format("observed")} AS key FROM tokens),
unknown AS (SELECT book, page, i - 1 AS ordinal, page * 4294967296 + i - 1 AS ord, page || ':unrecognized_token:' || start_byte AS id, observed, key, start, start_byte, start_byte + strlen(observed) AS end_byte
  FROM keyed WHERE key NOT IN (SELECT key FROM words))"""

SQL_TAGGED = f"""{SQL_UNKNOWN},
tagged AS (SELECT *, CASE WHEN page % 4 = 0 OR page % 7 = 0 THEN 'lower_upper' ELSE 'unrecognized_token' END AS rule, page % 4 = 0 OR page % 7 <> 0 AS lexical, CASE WHEN page % 3 = 0 THEN '7' ELSE 'None' END AS block FROM unknown)"""

SQL_LEXICAL = f"""{SQL_UNKNOWN},
odd AS (SELECT * REPLACE (CASE ordinal % 9 WHEN 0 THEN 'didnt' WHEN 1 THEN observed || '7' WHEN 2 THEN 'XIVI' WHEN 3 THEN 'doesn' ELSE observed END AS observed,
    CASE ordinal % 9 WHEN 0 THEN 'didnt' WHEN 1 THEN key || '7' WHEN 2 THEN 'xivi' WHEN 3 THEN 'doesn' ELSE key END AS key), (page * 31 + ordinal) % 12 AS m, page + ordinal AS s FROM unknown),
lexical AS (SELECT book, page, ordinal, ord, id, start_byte, end_byte, observed, key,
    CASE WHEN m <= 2 THEN CASE WHEN observed = 'doesn' THEN 'doesn''t' ELSE observed || 'e' END WHEN m = 3 THEN observed || 'x' END AS proposed,
    CASE WHEN m <= 2 THEN 'approved' END AS status,
    CASE m WHEN 4 THEN '{FAITHFUL_NOTE}' WHEN 5 THEN 'SOURCE_FAITHFUL_NONLEXICAL_VERIFIED: short' WHEN 6 THEN 'a proper name, printed without an apostrophe' WHEN 7 THEN 'a technical term' ELSE 'checked' END AS note,
    CASE m WHEN 8 THEN 'SCAN_BLOCKED: torn page' WHEN 9 THEN 'SCAN_UNRESOLVED: blurred' WHEN 10 THEN 'SCAN_VERIFIED: clear' END AS proposal_note, m = 11 AS lexicon_suggestion,
    CASE WHEN s % 17 = 0 THEN 'approved' WHEN s % 17 = 1 AND m <= 3 THEN 'rejected' END AS human_decision, CASE WHEN s % 17 = 0 THEN observed || 'h' END AS human_replacement,
    CASE s % 5 WHEN 0 THEN 'x''' WHEN 1 THEN '' ELSE 'x ' END AS before, CASE s % 7 WHEN 0 THEN '''t is' WHEN 1 THEN '’tis' ELSE '. ' END AS after FROM odd)"""

SQL_FAITHFUL = "(proposed IS NULL AND status IS NULL AND NOT coalesce(lexicon_suggestion, false) AND starts_with(note, 'SOURCE_FAITHFUL_NONLEXICAL_VERIFIED: ') AND length(trim(substr(note, 37))) >= 12)"
_contractions = ", ".join(f"'{w}'" for w in corpus.CONTRACTIONS)
_approved = "('codex_verified_repair', 'human_approved_repair')"
SQL_STATED = f"""{SQL_LEXICAL},
stated AS (SELECT *, CASE WHEN human_decision = 'approved' THEN 'human_approved_repair' WHEN human_decision = 'rejected' THEN 'human_rejected_repair' WHEN status = 'approved' THEN 'codex_verified_repair'
    WHEN proposed IS NOT NULL THEN 'proposed_not_verified' WHEN {SQL_FAITHFUL} THEN 'source_faithful_nonlexical' ELSE 'no_verified_repair' END AS repair_state,
    CASE WHEN human_decision = 'approved' THEN human_replacement WHEN human_decision = 'rejected' THEN NULL ELSE proposed END AS replacement FROM lexical)"""
SQL_OCCURRENCES = f"""{SQL_STATED},
forms AS (SELECT book, key, bool_and(repair_state IN {_approved}) AS r, bool_and(repair_state = 'source_faithful_nonlexical') AS f, length(key) % 4 AS h, arg_min(observed, ord) AS word, count(*) AS n FROM stated GROUP BY ALL),
disposed AS (SELECT *, CASE WHEN h = 0 THEN 'human_accepted_vocabulary' WHEN h = 1 THEN 'human_rejected_vocabulary_reason_unclassified' WHEN r THEN '{corpus.BULK_REPAIR}' WHEN f THEN '{corpus.BULK_SOURCE}' ELSE '{corpus.PENDING}' END AS disposition FROM forms),
occurrences AS (SELECT s.*, d.disposition,
    list_filter([CASE WHEN before = '' OR right(before, 1) IN ('''', '’') OR left(after, 1) IN ('''', '’') THEN 'adjacent_apostrophe' END, CASE WHEN s.key IN ({_contractions}) THEN 'contraction_like' END,
      CASE WHEN regexp_matches(observed, '[0-9]') THEN 'mixed_digits_letters' END, CASE WHEN regexp_full_match(observed, '[IVXLCDMivxlcdm]{{4,}}') THEN 'roman_numeral_like' END], lambda x: x IS NOT NULL) AS labels
  FROM stated s JOIN disposed d ON s.book = d.book AND s.key = d.key),
tagged AS (SELECT *, CASE WHEN len(labels) = 0 THEN ['no_obvious_signal'] ELSE labels END AS signals FROM occurrences)"""
SQL_ROUTED = f"""{SQL_OCCURRENCES},
routed AS (SELECT *, CASE
    WHEN split AND approved AND replace(lower(replacement), '’', '''') = lower(observed) || '''t' THEN 'repair_span_safety_audit' WHEN split THEN 'tokenizer_boundary_experiment' WHEN approved THEN 'existing_verified_repair_candidate'
    WHEN disposition <> '{corpus.PENDING}' THEN 'previously_triaged' WHEN list_contains(signals, 'contraction_like') AND contains(note, 'without an apostrophe') THEN 'book_scoped_recognition_experiment'
    WHEN repair_state = 'source_faithful_nonlexical' THEN 'source_faithful_nonlexical_candidate' WHEN starts_with(proposal_note, 'SCAN_BLOCKED:') OR starts_with(proposal_note, 'SCAN_UNRESOLVED:') THEN 'targeted_source_inspection'
    WHEN contains(note, 'proper name') OR contains(note, 'technical term') THEN 'lexical_coverage_experiment' ELSE 'unclassified_review_candidate' END AS route,
    coalesce(split AND approved AND replace(lower(replacement), '’', '''') = lower(observed) || '''t', false) AS duplicate_suffix,
    list_filter([CASE WHEN split THEN 'exact_contraction_prefix_span' END, CASE WHEN list_contains(signals, 'contraction_like') THEN 'contraction_like_spelling' END,
      CASE WHEN list_contains(signals, 'adjacent_apostrophe') THEN 'adjacent_apostrophe' END, CASE WHEN contains(note, 'proper name') THEN 'agent_note_mentions_proper_name' END,
      CASE WHEN contains(note, 'technical term') THEN 'agent_note_mentions_technical_term' END,
      CASE WHEN list_contains(signals, 'contraction_like') AND contains(note, 'without an apostrophe') THEN 'verifier_note_claims_printed_without_apostrophe' END,
      CASE WHEN starts_with(proposal_note, 'SCAN_') THEN 'proposer_note_' || lower(split_part(proposal_note, ':', 1)) END,
      CASE WHEN repair_state = 'source_faithful_nonlexical' THEN 'structured_source_faithful_nonlexical' WHEN approved THEN 'structured_approved_repair_candidate' END], lambda x: x IS NOT NULL) AS clues
  FROM (SELECT *, observed = 'doesn' AND regexp_matches(after, '^[''’]t([^a-z]|$)') AS split, repair_state IN {_approved} AS approved FROM tagged))"""
