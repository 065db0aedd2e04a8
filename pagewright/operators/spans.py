"""Finding defects: adjacency hits, merged spans, findings and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def adjacency_hits(pages: DataFrame, visible: bool = True) -> DataFrame:
    """``(page, rule, start, end, start_byte, end_byte, observed)`` of each rule's hits in ``pages(page, text)``.

    Hits of the two punctuation rules count inside markup too; a lower-to-upper hit
    needs its two signs visible. ``visible=False`` skips that test for texts known to be plain.
    """
    def rows(rule: str, found: Column) -> DataFrame:
        return pages.select("page", F.lit(rule).alias("rule"), F.explode(found).alias("s")).select("page", "rule", "s.*")

    out = rows("punctuation_letter", T.spans(F.col("text"), T.ADJACENCY["punctuation_letter"]))
    out = out.unionByName(rows("period_capital", T.spans(F.col("text"), T.ADJACENCY["period_capital"])))
    found = pages.select("page", "text", F.explode(T.spans(F.col("text"), T.ADJACENCY["lower_upper"])).alias("s"))
    if visible:
        found = pages.withColumn("shown", T.visible_text("text")).select("page", "shown", F.explode(T.spans(F.col("text"), T.ADJACENCY["lower_upper"])).alias("s"))
        found = found.filter(F.substring("shown", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).rlike("[a-z][A-Z]"))
    return out.unionByName(found.select("page", F.lit("lower_upper").alias("rule"), "s.*"))


def combine_spans(spans: DataFrame, by: tuple[str, ...] = ("page",)) -> DataFrame:
    """Merge overlapping and touching spans: ``(*by, start, end, triggers)``, rules in order of first appearance.

    Islands start where a span begins beyond every earlier end.
    """
    order = [F.col("start"), F.col("end"), F.col("rule")]
    w = Window.partitionBy(*by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("_new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda s: s["rule"]))
    return marked.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), listed.alias("triggers")).drop("_island")


def whitespace_findings(pages: DataFrame) -> DataFrame:
    """Findings of the two punctuation rules, one pass over each text and no shuffle.

    Those hits never overlap, only touch, so the merged spans are the islands of one
    combined pattern; the rules in an island follow from its text.
    """
    found = pages.select("page", "text", F.explode(T.spans(F.col("text"), T.ISLAND)).alias("s"))
    parts = F.regexp_extract_all("s.observed", F.lit(r"[,;:!?.]"), F.lit(0))
    triggers = F.array_distinct(F.transform(parts, lambda p: F.when(p == ".", "period_capital").otherwise("punctuation_letter")))
    out = found.select("page", "text", "s.*", triggers.alias("triggers"))
    out = out.withColumn("rule", F.element_at("triggers", 1)).withColumn("id", F.concat_ws(":", F.col("page").cast("string"), "rule", F.col("start_byte").cast("string")))
    return out.withColumn("proposed", T.whitespace_proposal(F.col("observed"), F.col("triggers")))


def counts_by_rule(findings: DataFrame) -> DataFrame:
    """``(rule, n)``: one for each trigger of each finding."""
    return findings.select(F.explode("triggers").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def extract_whitespace(findings: DataFrame) -> DataFrame:
    """Findings that only punctuation rules triggered, rows unchanged."""
    return findings.filter((F.size("triggers") > 0) & (F.size(F.array_except("triggers", F.array(*map(F.lit, T.PUNCTUATION_RULES)))) == 0))


def proposal_guard(edits: DataFrame) -> DataFrame:
    """Edits other than the blanks that the punctuation rules call for."""
    from .guards import violations

    fits = F.col("proposed").eqNullSafe(T.whitespace_proposal(F.col("observed"), F.col("triggers")))
    return violations(edits, "no edit of the punctuation stage", "id", ~fits)


def extract_lexical(findings: DataFrame) -> DataFrame:
    """Findings with an unrecognised token, with empty slots for the proposer."""
    out = findings.filter(F.array_contains("triggers", "unrecognized_token"))
    return out.withColumn("proposal_note", F.lit(None).cast("string")).withColumn("lexicon_suggestion", F.lit(None).cast("boolean"))


def lexical_guards(findings: DataFrame, lexicon_sha256: str | None) -> list[DataFrame]:
    """What forbids ``extract_lexical``: no lexicon on record, findings without an offset or with a proposal."""
    from .guards import violations

    asked = findings.filter(F.array_contains("triggers", "unrecognized_token"))
    return [
        violations(findings.limit(1), "no lexicon recorded", F.lit("lexicon_sha256"), F.lit(not lexicon_sha256)),
        violations(asked, "no offset", "id", F.col("start_byte").isNull()),
        violations(asked, "proposal already present", "id", F.col("proposed").isNotNull()),
    ]


def findings_order() -> list[Column]:
    """Findings in the order of a report: by page, start (page findings first), rule, block and id."""
    return [F.col("page"), F.coalesce("start_byte", F.lit(-1)), F.col("rule"), F.coalesce(F.col("block_id").cast("string"), F.lit("None")), F.col("id")]
