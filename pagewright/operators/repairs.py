"""Applying approved byte-span edits, and proving them by reversing them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .guards import violations


def overlap_conflicts(edits: DataFrame) -> DataFrame:
    """``(page, id, next_id)`` of neighbouring edits of a page that overlap."""
    w = Window.partitionBy("page").orderBy("start_byte", "end_byte", "id")
    ahead = edits.select("page", "id", "end_byte", F.lead("start_byte").over(w).alias("next_start"), F.lead("id").over(w).alias("next_id"))
    return ahead.filter(F.col("end_byte") > F.col("next_start")).select("page", "id", "next_id")


def boundary_violations(edits: DataFrame) -> DataFrame:
    """Edits whose replacement repeats an apostrophe and t that already follow the span in ``text``."""
    after = F.substring(F.encode("text", "UTF-8"), F.col("end_byte") + 1, F.lit(4))  # bytes, as a sign may reach beyond
    bad = F.lit(False)
    for suffix in ("'t", "’t"):
        bad |= F.startswith(after, F.encode(F.lit(suffix), "UTF-8")) & (T.plain_apostrophe(F.col("proposed")) == T.plain_apostrophe(F.concat("observed", F.lit(suffix))))
    return edits.filter(bad)


def apply_edits(text: Column, edits: Column) -> Column:
    """Apply ``(start_byte, end_byte, replacement)`` edits to a text's bytes, from the right so offsets stay valid."""
    ordered = F.reverse(F.array_sort(edits))
    put = lambda a, e: F.overlay(a, F.encode(e["replacement"], "UTF-8"), e["start_byte"] + 1, e["end_byte"] - e["start_byte"])
    return F.decode(F.aggregate(ordered, F.encode(text, "UTF-8"), put), "UTF-8")


def grouped(edits: DataFrame, start: str, end: str, replacement: str) -> DataFrame:
    """``(page, edits)``: the edits of each page as one array. A page is one row already, so its edits are bounded by it."""
    edit = F.struct(F.col(start).alias("start_byte"), F.col(end).alias("end_byte"), F.col(replacement).alias("replacement"))
    return edits.groupBy("page").agg(F.collect_list(edit).alias("edits"))


def apply_repairs(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """``(page, text, derived)``: every page with its approved edits applied; pages without edits stay as they are."""
    joined = pages.select("page", "text").join(grouped(edits, "start_byte", "end_byte", "proposed"), "page", "left")
    return joined.select("page", "text", F.when(F.col("edits").isNotNull(), apply_edits(F.col("text"), F.col("edits"))).otherwise(F.col("text")).alias("derived"))


def derived_offsets(edits: DataFrame) -> DataFrame:
    """Where each replacement lies in the derived page: ``(page, id, derived_start, derived_end)`` beside the edit."""
    w = Window.partitionBy("page").orderBy("start_byte").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.octet_length("proposed") - F.octet_length("observed")).over(w), F.lit(0))
    out = edits.withColumn("derived_start", F.col("start_byte") + shift)
    return out.withColumn("derived_end", F.col("derived_start") + F.octet_length("proposed"))


def reverse_repairs(derived: DataFrame, edits: DataFrame) -> DataFrame:
    """``(page, restored)``: derived pages with their edits undone."""
    joined = derived.select("page", "derived").join(grouped(derived_offsets(edits), "derived_start", "derived_end", "observed"), "page", "left")
    return joined.select("page", F.when(F.col("edits").isNotNull(), apply_edits(F.col("derived"), F.col("edits"))).otherwise(F.col("derived")).alias("restored"))


def repair_totals(applied: DataFrame, edits: DataFrame) -> DataFrame:
    """One row: approved findings, pages, and pages that changed."""
    pages = applied.agg(F.count("*").alias("page_count"), F.count_if(F.col("derived") != F.col("text")).alias("changed_pages"))
    return edits.agg(F.count("*").alias("approved_findings")).crossJoin(F.broadcast(pages))  # one row beside one row


def edit_guards(pages: DataFrame, edits: DataFrame) -> list[DataFrame]:
    """What forbids executing: wrong bytes, missing proposals, overlaps, replacements that repeat a contraction's ending."""
    at = edits.select("page", "id", "start_byte", "end_byte", "observed", "proposed").join(pages.select("page", "text"), "page", "left")
    seen = T.byte_slice(F.col("text"), F.col("start_byte"), F.col("end_byte"))
    return [
        violations(at, "no page for approved finding", "id", F.col("text").isNull()),
        violations(at, "observed bytes do not match", "id", ~F.coalesce(seen == F.col("observed"), F.lit(False))),
        violations(at, "no proposal", "id", F.col("proposed").isNull()),
        violations(overlap_conflicts(edits), "overlapping approved findings", "id"),
        violations(boundary_violations(at), "replacement repeats what follows", "id"),
    ]


def edited_pages(*stages: DataFrame) -> DataFrame:
    """``(page)``: every page that an edit of some stage touched, once."""
    return reduce(DataFrame.unionByName, (s.select("page") for s in stages)).distinct()


def provenance_violations(derived: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows that the derived pages do not bear out: order, lengths, replacement bytes, source hash."""
    placed = derived_offsets(ledger).join(derived.select("page", "derived"), "page", "left")
    w = Window.partitionBy("page").orderBy("start_byte")
    placed = placed.withColumn("before", F.coalesce(F.lag("end_byte").over(w), F.lit(0)))
    there = T.byte_slice(F.col("derived"), F.col("derived_start"), F.col("derived_end"))
    back = reverse_repairs(derived, ledger).join(ledger.select("page", "source_sha256").distinct(), "page")
    bad_range = (F.col("start_byte") < F.col("before")) | (F.col("end_byte") <= F.col("start_byte")) | (F.col("end_byte") - F.col("start_byte") != F.octet_length("observed"))
    return (
        violations(placed, "invalid or overlapping byte range", "id", bad_range)
        .unionByName(violations(placed, "replacement bytes do not match", "id", ~F.coalesce(there == F.col("proposed"), F.lit(False))))
        .unionByName(violations(back, "source hash mismatch", "page", F.sha2(F.encode("restored", "UTF-8"), 256) != F.col("source_sha256")))
    )
