"""The page workflow end to end: probe a scanned book, execute approved edits, verify them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guards, pages, repairs, spans, vocabulary
from ..session import written
from ..sources import directories as d
from ..sources import reports

KINDS = (".png", ".jpg", ".jpeg")


def probe(spark: SparkSession, scans: str, artifacts: str, words: DataFrame) -> DataFrame:
    """Findings ``(page, rule, start_byte, end_byte, observed, proposed, triggers)`` of one book.

    Whitespace spans and lexical spans are merged each on their own; pages without
    text or blocks get presence findings only.
    """
    images, found = d.files(spark, scans).drop("content"), d.files(spark, artifacts)
    guards.require(pages.stem_guard(images, KINDS), pages.stem_guard(found, (".md",)), pages.stem_guard(found, ("_res.json",)))
    texts = d.texts(found)
    blocks, broken = d.blocks(found)
    shot = images.select(F.lower(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1)).alias("kind"), "path").filter(F.col("kind").isin(*KINDS))
    shot = shot.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("page"))
    universe = pages.universe(shot, texts, pages.by_stem(found, "_res.json"))
    whole = texts.join(universe.filter("has_text AND has_blocks").select("page"), "page")
    empty = {"start_byte": "int", "end_byte": "int", "observed": "string", "proposed": "string"}
    plain = lambda df: df.select("page", "rule", *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in empty.items()), F.array("rule").alias("triggers"))
    white = spans.whitespace_findings(whole).select("page", "rule", "start_byte", "end_byte", "observed", "proposed", "triggers")
    upper = spans.adjacency_hits(whole).filter("rule = 'lower_upper'").select("page", "rule", "start", "end")
    unknown = vocabulary.unknown_in(spark, whole.select("page", "text"), words).select("page", F.lit("unrecognized_token").alias("rule"), "start", "end")
    merged = spans.combine_spans(upper.unionByName(unknown)).join(whole.select("page", "text"), "page")
    text = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    at = F.octet_length(F.substring("text", F.lit(1), F.col("start")))
    lexical = merged.select("page", F.element_at("triggers", 1).alias("rule"), at.alias("start_byte"), (at + F.octet_length(text)).alias("end_byte"), text.alias("observed"), F.lit(None).cast("string").alias("proposed"), "triggers")
    gone = pages.block_differences(blocks, whole.select("page", "text", F.lit(None).cast("string").alias("original")))
    gone = gone.select("page", F.concat(F.lit("json_markdown_difference:"), "label").alias("rule"), "observed")
    out = white.unionByName(lexical)
    for part in (pages.presence_findings(universe, whole), broken.select("page", F.lit("invalid_json").alias("rule")), gone):
        out = out.unionByName(plain(part))
    return out


def execute(spark: SparkSession, artifacts: str, edits: DataFrame, target: str, scans: str | None = None) -> dict:
    """Apply ``edits(page, id, start_byte, end_byte, observed, proposed, triggers)`` to a copy of ``artifacts``; returns the ledger.

    Nothing is written if a guard finds fault; the result is reversed and compared before it is published.
    ``scans`` binds the ledger to the scanned book, which the lexical stage asks for.
    """
    found = d.files(spark, artifacts)
    texts, edits = d.texts(found), written(spark, edits, "edits")  # read by every guard
    guards.require(*repairs.edit_guards(texts, edits), spans.proposal_guard(edits))
    sha = lambda files: pages.snapshot_digest(pages.file_digests(files)).first()["snapshot_sha256"]
    source = sha(found)
    about = {"execution_format": reports.WHITESPACE_STAGE, "source_dir_sha256": sha(d.files(spark, scans)) if scans else None, "source_paddle_dir_sha256": source}
    at = edits.join(texts.select("page", "path"), "page").drop("page").withColumnRenamed("path", "page").withColumn("json_markdown_comparison", F.lit(reports.REVERSED))
    report, changed = d.ledger_of(texts.select(F.col("path").alias("page"), "text"), at, about, "triggers", "json_markdown_comparison")
    d.publish_pages(artifacts, changed, report, target, reports.WHITESPACE_LEDGER, source)
    return report
