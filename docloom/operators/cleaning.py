"""Page cleaning: Unicode form, control characters, white space, repeated furniture."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.scalars import lines_of, lines_with_ends, strip

MIN_PAGES = 3
EDGE_LINES = 3
FREQUENCY = 0.6
MAX_LINE = 200


@dataclass(frozen=True)
class CleanConfig:
    unicode_normalize: bool = True
    strip_control_chars: bool = True
    normalize_whitespace: bool = True
    remove_repeated_headers: bool = True
    suppress_duplicate_lines: bool = True


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("changed", T.IntegerType())]))
def _nfc(text: pd.Series) -> pd.DataFrame:
    """NFC and the number of positions that differ; the engine has no such builtin."""
    done = text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))
    changed = [0 if a is None or a is b else sum(x != y for x, y in zip(a, b)) for a, b in zip(text, done)]
    return pd.DataFrame({"text": done, "changed": changed})


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def squeeze_whitespace(c: Column) -> Column:
    """No blanks at line ends, single blanks inside, at most three newlines in a row."""
    c = F.regexp_replace(c, r"(?m)[ \t]+(?=\n|\z)", "")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    return F.regexp_replace(c, r"\n{4,}", "\n\n\n")


def drop_edge_lines(text: Column, targets: Column, top: bool) -> Column:
    """(text without leading or trailing lines that are in ``targets``, how many went)."""
    kept = lines_with_ends(text)
    order = kept if top else F.reverse(kept)
    stays = F.transform(order, lambda x: ~F.array_contains(targets, strip(x)))
    first = F.array_position(stays, True).cast("int")
    gone = F.when(F.size(targets) == 0, 0).when(first == 0, F.size(kept)).otherwise(first - 1)
    rest = F.slice(kept, gone + 1, F.size(kept)) if top else F.slice(kept, F.lit(1), F.size(kept) - gone)
    return F.struct(F.when(gone == 0, text).otherwise(F.array_join(rest, "")).alias("text"), gone.alias("removed"))


def suppress_duplicates(text: Column) -> Column:
    """(text without lines that equal the line before, how many went); blank lines stay."""
    all_lines = lines_with_ends(text)
    kept = F.filter(all_lines, lambda x, i: (i == 0) | (strip(x) == "") | (strip(x) != strip(F.get(all_lines, i - 1))))
    return F.struct(F.array_join(kept, "").alias("text"), (F.size(all_lines) - F.size(kept)).alias("removed"))


def repeated_lines(pages: DataFrame) -> DataFrame:
    """(document_id, headers, footers): edge lines that recur over a document's pages.

    Occurrences are counted, blank pages count in the denominator, and the raw text is read.
    """
    solid = F.filter(F.transform(lines_of(F.col("text")), strip), lambda x: x != "")
    edges = pages.select(
        "document_id",
        F.slice(solid, 1, EDGE_LINES).alias("top"),
        F.when(F.size(solid) > EDGE_LINES, F.slice(solid, -EDGE_LINES, EDGE_LINES)).otherwise(solid).alias("bottom"),
    )
    long = edges.select("document_id", F.explode("top").alias("line"), F.lit("top").alias("edge")).unionByName(
        edges.select("document_id", F.explode("bottom").alias("line"), F.lit("bottom").alias("edge"))
    )
    counts = long.filter(F.length("line") < MAX_LINE).groupBy("document_id", "edge", "line").agg(F.count(F.lit(1)).alias("n"))
    sizes = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"))
    often = counts.join(sizes, "document_id").filter((F.col("pages") >= MIN_PAGES) & (F.col("n") >= F.col("pages") * FREQUENCY))
    pick = lambda edge: F.array_sort(F.collect_list(F.when(F.col("edge") == edge, F.col("line"))))
    return often.groupBy("document_id").agg(pick("top").alias("headers"), pick("bottom").alias("footers"))


def clean_pages(pages: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """Cleaned pages with counters of what each step changed."""
    none = F.expr("cast(array() as array<string>)")
    out = pages.join(repeated_lines(pages), "document_id", "left").select(
        "document_id", "page_number", F.col("text").alias("raw"), F.coalesce("headers", none).alias("headers"), F.coalesce("footers", none).alias("footers")
    )
    if config.unicode_normalize:
        out = out.withColumn("_n", _nfc("raw")).withColumns({"text": F.col("_n.text"), "unicode_normalizations": F.col("_n.changed")}).drop("_n")
    else:
        out = out.withColumns({"text": F.col("raw"), "unicode_normalizations": F.lit(0)})
    before = out.withColumn("_t", strip_control(F.col("text")) if config.strip_control_chars else F.col("text"))
    out = before.withColumn("control_chars_removed", F.length("text") - F.length("_t")).withColumn("text", F.col("_t")).drop("_t")
    out = out.withColumn("_t", squeeze_whitespace(F.col("text")) if config.normalize_whitespace else F.col("text"))
    out = out.withColumn("whitespace_reduced", F.length("_t") < F.length("text")).withColumn("text", F.col("_t")).drop("_t")
    for name, targets, top in (("headers_removed", "headers", True), ("footers_removed", "footers", False)):
        out = out.withColumn("_s", drop_edge_lines(F.col("text"), F.col(targets) if config.remove_repeated_headers else none, top))
        out = out.withColumns({"text": F.col("_s.text"), name: F.col("_s.removed")}).drop("_s")
    out = out.withColumn("_s", suppress_duplicates(F.col("text")) if config.suppress_duplicate_lines else F.struct(F.col("text").alias("text"), F.lit(0).alias("removed")))
    out = out.withColumns({"text": F.col("_s.text"), "duplicate_lines_suppressed": F.col("_s.removed")}).drop("_s")
    return out.withColumn("char_count", F.length(strip(F.col("text"))))


def clean_audit(cleaned: DataFrame) -> DataFrame:
    """Per document what cleaning removed; warns when more than half of a text went."""
    out = cleaned.groupBy("document_id").agg(
        F.sum(F.length("raw")).alias("chars_before"),
        F.sum(F.length("text")).alias("chars_after"),
        F.sum("unicode_normalizations").alias("unicode_normalizations"),
        F.sum("control_chars_removed").alias("control_chars_removed"),
        F.count_if("whitespace_reduced").alias("whitespace_reductions"),
        F.sum("headers_removed").alias("headers_removed"),
        F.sum("footers_removed").alias("footers_removed"),
        F.sum("duplicate_lines_suppressed").alias("duplicate_lines_suppressed"),
    )
    removed = F.col("chars_before") - F.col("chars_after")
    return out.withColumn("chars_removed", removed).withColumn("heavy_removal", (removed > F.col("chars_before") * 0.5) & (F.col("chars_before") > 100))
