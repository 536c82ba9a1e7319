"""Section intervals from heading lines, and section labels of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalars import strip, title_case

MIN_HEADING, MAX_HEADING = 3, 120

# Heading patterns with their labels, in order of precedence.
KNOWN_SECTIONS = [
    (r"\bdiagnosis\b", "Diagnosis"),
    (r"\btreatment\s*plan\b", "Treatment Plan"),
    (r"\bmedical\s*history\b", "Medical History"),
    (r"\bprogress\s*note", "Progress Note"),
    (r"\bvital\s*signs\b", "Vital Signs"),
    (r"\bmedication", "Medications"),
    (r"\bbilling\s*summary\b", "Billing Summary"),
    (r"\bcharges?\b.*\btotal\b|\btotal\b.*\bcharges?\b", "Charges"),
    (r"\bstatement\s*of\s*account\b", "Statement of Account"),
    (r"\bconclusion", "Conclusion"),
    (r"\bsummar(?:y|ies)\b", "Summary"),
    (r"\bfindings?\b", "Findings"),
    (r"\brecommendation", "Recommendations"),
    (r"\bappendix\b", "Appendix"),
    (r"\bexhibit\s+[A-Z0-9]", "Exhibit"),
    (r"\bdeposition\b", "Deposition"),
    (r"\btestimony\b", "Testimony"),
    (r"\bdamage\s*assessment\b", "Damage Assessment"),
    (r"\bestimate\b", "Estimate"),
    (r"\bcorrespondence\b", "Correspondence"),
]
ALLCAPS = r"^[A-Z][A-Z\s,&/\-]{8,}$"
NUMBERED = r"(?i)^(?:(?:Section|Part|Article|Chapter)\s+)?\d+[\.\)]\s+[A-Z]"
ROMAN = r"^(?:(?:Section|Part)\s+)?(?:I{1,3}|IV|VI{0,3}|IX|X{1,3})[\.\):\s]+[A-Z]"
#: Any heading at all: most lines are told apart by this one scan.
ANY_HEADING = "|".join([f"(?i:{'|'.join(f'(?:{p})' for p, _ in KNOWN_SECTIONS)})", f"(?:{ALLCAPS})", f"(?:{NUMBERED.replace('(?i)', '(?i:', 1)}))", f"(?:{ROMAN})"])


def heading(line: Column) -> Column:
    """(label, method, confidence) of a stripped line, null if it is no heading."""
    hit = lambda label, method, confidence: F.struct(label.alias("label"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))
    out = None
    for pattern, label in KNOWN_SECTIONS:
        test = (F.length(line) < 80) & line.rlike(f"(?i){pattern}")
        value = hit(F.lit(label), "domain_keyword", 0.7)
        out = F.when(test, value) if out is None else out.when(test, value)
    out = out.when(line.rlike(ALLCAPS), hit(title_case(line), "allcaps_heading", 0.6))
    out = out.when(line.rlike(NUMBERED), hit(F.substring(line, 1, 60), "numbered_heading", 0.5))
    out = out.when(line.rlike(ROMAN), hit(F.substring(line, 1, 60), "roman_heading", 0.5))
    return F.when(F.length(line).between(MIN_HEADING, MAX_HEADING), out)


def heading_lines(text: Column) -> Column:
    """(place, line) of the lines of a text that look like headings, stripped; one pass over its lines."""
    hit = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("line"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.filter(F.array(hit), lambda _: F.lit(False)).alias("hits"))

    def step(acc: Column, line: Column) -> Column:
        bare = strip(line)
        found = (F.length(line) >= MIN_HEADING) & F.length(bare).between(MIN_HEADING, MAX_HEADING) & bare.rlike(ANY_HEADING)
        hits = F.when(found, F.array_append(acc["hits"], F.struct(acc["at"].alias("at"), bare.alias("line")))).otherwise(acc["hits"])
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), hits.alias("hits"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: acc["hits"])


def detect_sections(pages: DataFrame) -> DataFrame:
    """Section intervals in order; neighbours of one label are one section.

    A section runs to the next heading; the last one to the end of the document,
    counting the joiner after its last page. Lines are read where their page is; what
    moves, once, to a document's place are its pages' lengths and their headings.
    """
    narrow = pages.select("document_id", "page_number", (F.length("text") + 2).alias("size"), heading_lines(F.col("text")).alias("hits"))
    whole = Window.partitionBy("document_id")
    earlier = whole.orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumns({"above": F.coalesce(F.sum("size").over(earlier), F.lit(0)), "last_page": F.max("page_number").over(whole), "total": F.sum("size").over(whole)})
    lines = placed.select("document_id", "page_number", "last_page", "total", "above", F.explode("hits").alias("hit"))
    hits = lines.withColumn("char_start", F.col("above") + F.col("hit.at")).withColumn("h", heading(F.col("hit.line"))).filter("h is not null")
    order = Window.partitionBy("document_id").orderBy("page_number", "char_start")
    hits = hits.select(
        "document_id",
        F.col("h.label").alias("label"),
        F.col("page_number").alias("page_start"),
        F.coalesce(F.lead("page_number").over(order), F.col("last_page")).alias("page_end"),
        "char_start",
        F.coalesce(F.lead("char_start").over(order), F.col("total")).alias("char_end"),
        F.col("h.method").alias("method"),
        F.col("h.confidence").alias("confidence"),
    )
    order = Window.partitionBy("document_id").orderBy("page_start", "char_start")
    # A section begins where its predecessor ends, so equal neighbours always touch.
    fresh = F.coalesce((F.lag("label").over(order) != F.col("label")).cast("int"), F.lit(1))
    island = hits.withColumn("fresh", fresh).withColumn("section_index", F.sum("fresh").over(order) - 1)
    first = lambda c: F.min_by(c, F.struct("page_start", "char_start"))
    return island.groupBy("document_id", "section_index").agg(
        first("label").alias("label"),
        F.min("page_start").alias("page_start"),
        F.max("page_end").alias("page_end"),
        F.min("char_start").alias("char_start"),
        F.max("char_end").alias("char_end"),
        first("method").alias("method"),
        first("confidence").alias("confidence"),
    )


def label_chunks(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Add section_label: the last section that holds the chunk's start, else its first page.

    A document's sections travel as one array beside its chunks, so the interval match is
    an equi-join and a filter.
    """
    lists = sections.groupBy("document_id").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("section_index", "label", "page_start", "page_end", "char_start", "char_end")))).alias("sections")
    )
    at = F.get(F.filter("sections", lambda s: (s["char_start"] <= F.col("char_start")) & (F.col("char_start") < s["char_end"])), F.lit(0))["label"]
    page = F.get("page_numbers", F.lit(0))
    near = F.get(F.filter("sections", lambda s: (s["page_start"] <= page) & (page <= s["page_end"])), F.lit(0))["label"]
    return chunks.join(lists, "document_id", "left").withColumn("section_label", F.coalesce(at, near, F.lit(""))).drop("sections")


def enrich_chunks(chunks: DataFrame, sections: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with section label, document type, file name and parse quality.

    ``documents`` has document_id, predicted_type, filename, quality.
    """
    meta = documents.select(
        "document_id",
        F.coalesce("predicted_type", F.lit("")).alias("doc_type"),
        F.coalesce("filename", F.lit("")).alias("source_filename"),
        F.coalesce("quality", F.lit("")).alias("parse_quality"),
    )
    out = label_chunks(chunks, sections).join(meta, "document_id", "left")
    return out.fillna("", ["doc_type", "source_filename", "parse_quality"])
