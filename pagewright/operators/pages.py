"""The universe of pages: images, texts and block files of one stem, and what is missing or differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .guards import duplicates, violations


def by_stem(files: DataFrame, suffix: str) -> DataFrame:
    """``(page, path)`` of the files whose name ends in ``suffix``, in any case."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(F.endswith(F.lower("path"), F.lit(suffix))).select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("page"), "path")


def stem_guard(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Pages that two files of these kinds claim."""
    from functools import reduce

    return violations(duplicates(reduce(DataFrame.unionByName, (by_stem(files, s) for s in suffixes)), "page"), "duplicate page", "page")


def universe(images: DataFrame, texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(page, has_image, has_text, has_blocks)`` of every page that any of the three has."""
    side = lambda df, name: df.select("page").distinct().withColumn(name, F.lit(True))
    both = side(images, "has_image").join(side(texts, "has_text"), "page", "full_outer").join(side(blocks, "has_blocks"), "page", "full_outer")
    return both.select("page", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_image", "has_text", "has_blocks")))


def presence_findings(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """``(page, rule)``: pages without image, text or blocks, and complete ones whose text is blank."""
    joined = pages.join(texts.select("page", (T.flatten_text(F.col("text")) == "").alias("_blank")), "page", "left")
    rules = F.array_compact(F.array(
        F.when(~F.col("has_image"), "unexpected_ocr_page"), F.when(~F.col("has_text"), "missing_markdown"), F.when(~F.col("has_blocks"), "missing_json"),
        F.when(F.col("has_text") & F.col("has_blocks") & F.col("_blank"), "empty_markdown"),
    ))
    return joined.select("page", F.explode(rules).alias("rule"))


def block_differences(blocks: DataFrame, texts: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """``(page, block_id, label, observed, excused)`` of blocks whose flattened text the page does not hold.

    ``texts(page, text, original)``: a block that the page held before its executed
    edits (``original``, null if there were none) is excused. Pages are flattened once, then joined.
    """
    flat = blocks.filter(~F.col("label").isin(*ignored)) if ignored else blocks
    flat = flat.select("page", "block_id", F.coalesce("label", F.lit("unknown")).alias("label"), T.flatten_text(F.coalesce("content", F.lit(""))).alias("observed")).filter("observed <> ''")
    pages = texts.select("page", T.flatten_text(F.col("text")).alias("_text"), T.flatten_text(F.col("original")).alias("_before"))
    missing = flat.join(pages, "page").filter(~F.col("_text").contains(F.col("observed")))
    return missing.select("page", "block_id", "label", "observed", F.coalesce(F.col("_before").contains(F.col("observed")), F.lit(False)).alias("excused"))


def file_digests(files: DataFrame) -> DataFrame:
    """``(path, sha256)``; content as binary."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def json_string(c: Column) -> Column:
    """A string as JSON writes it, other signs than controls, quotes and backslashes as they are."""
    return F.substring(F.to_json(F.struct(c.alias("k"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("k")))) - 6)


def snapshot_digest(digests: DataFrame) -> DataFrame:
    """One row: the digest of a directory, from ``(path, sha256)`` in path order.

    The manifest is one value by definition; it holds a line per file, not contents.
    """
    entry = F.struct("path", F.concat(json_string(F.col("path")), F.lit(': "'), "sha256", F.lit('"')).alias("line"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["line"])
    return digests.agg(F.sha2(F.encode(F.concat(F.lit("{"), F.array_join(listed, ", "), F.lit("}")), "UTF-8"), 256).alias("snapshot_sha256"), F.count("*").alias("files"))
