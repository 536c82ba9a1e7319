"""Field extraction by rules, and normalisation of what was found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalars import POSTPROCESS_DATES, parse_date, strip

CONTEXT = 60


@dataclass(frozen=True)
class FieldRule:
    """Patterns tried in order; group 1 is the value.

    ``cues`` are lower-case texts of which every match of any pattern holds one; without
    them, every page is scanned.
    """

    name: str
    patterns: tuple[str, ...]
    method: str = "regex"
    cues: tuple[str, ...] = ()


_ID = r"\s*(?:number|no\.?|#)\s*[:\s]*([A-Z0-9][\w-]{3,})"
# The fields in output order.
FIELD_RULES = [
    FieldRule("claim_number", (rf"(?iuU)(?:case|claim){_ID}",), cues=("case", "claim")),
    FieldRule("policy_number", (rf"(?iuU)policy{_ID}",), cues=("policy",)),
    FieldRule("invoice_number", (rf"(?iuU)invoice{_ID}",), cues=("invoice",)),
    FieldRule(
        "total_amount",
        (
            r"(?iuU)(?:total\s*(?:due|estimated\s*(?:cost|damages)|demand|charges|amount))\s*[:\s]*\$?\s*([\d,]+\.?\d*)",
            r"(?iuU)(?:net\s*payment)\s*[:\s]*\$\s*([\d,]+\.?\d*)",
            r"(?iuU)total\s*[:\s]+\$\s*([\d,]+\.?\d*)",
        ),
        cues=("total", "net"),
    ),
    FieldRule(
        "service_date",
        (
            r"(?iuU)(?:date\s*(?:of\s*(?:loss|service|injury))|invoice\s*date|service\s*date)\s*[:\s]*"
            r"([A-Z][a-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}/\d{1,2}/\d{2,4})",
        ),
        cues=("date",),
    ),
    FieldRule("patient_name", (r"(?iuU)(?:patient\s*name|claimant)\s*[:\s]*([A-Z][a-z]+\s+[A-Z][a-z]+)",), "keyword_window", ("patient", "claimant")),
    FieldRule("provider_name", (r"(?U)(?iu:adjuster|attending\s*physician|physician|provider)\s*:\s*(?:Dr\.?\s*)?([A-Z][a-z]+\s+[A-Z][a-z]+)",), "keyword_window", ("adjuster", "physician", "provider")),
    FieldRule("account_number", (rf"(?iuU)account{_ID}",), cues=("account",)),
    FieldRule("mrn", (r"(?iuU)(?:MRN|medical\s*record\s*(?:number|no\.?|#))\s*[:\s]*([A-Z0-9][\w-]{3,})",), cues=("mrn", "medical")),
]


def strip_markup(text: Column) -> Column:
    """Emphasis marks, heading marks, table bars and rules out; single spaces."""
    text = F.regexp_replace(text, r"\*{1,3}|_{1,3}", "")
    text = F.regexp_replace(text, r"(?m)^#{1,6}\s+", "")
    text = F.regexp_replace(text, r"\|", " ")
    text = F.regexp_replace(text, r"(?m)^[\s|:-]+$", "")
    return F.regexp_replace(text, r"  +", " ")


def confidence(name: Column, value: Column) -> Column:
    """Confidence by field: amounts and ids by shape, names by word count."""
    number = F.regexp_replace(value, ",", "").try_cast("double")
    return (
        F.when(name == "total_amount", F.when(number.isNotNull(), 0.9).otherwise(0.3))
        .when(name.isin("claim_number", "policy_number", "invoice_number", "account_number", "mrn"), F.when(F.length(value) >= 4, 0.9).otherwise(0.5))
        .when(name.isin("patient_name", "provider_name"), F.when(F.size(F.split(value, r"\s+")) >= 2, 0.8).otherwise(0.4))
        .when(name == "service_date", 0.85)
        .otherwise(0.6)
    )


#: Letters that a pattern takes for an ASCII one whatever the case, though lower case leaves or splits them.
_FOLDED = ("ſıİ\u212a", "siik")


def _hit(field_index: int, rule: FieldRule, pattern_index: int, whole: Column) -> Column:
    """The struct of a whole match in ``clean``, null for none: no pattern matches the empty text.

    The match is the first occurrence of its own text, since no pattern looks around itself.
    """
    at = F.instr("clean", whole)
    start = F.greatest(F.lit(0), at - 1 - CONTEXT)
    end = F.least(F.length("clean"), at - 1 + F.length(whole) + CONTEXT)
    around = F.concat(F.when(start > 0, "…").otherwise(""), strip(F.substring("clean", start + 1, end - start)), F.when(end < F.length("clean"), "…").otherwise(""))
    found = F.struct(
        F.lit(field_index).alias("field_index"), F.lit(rule.name).alias("field_name"), F.lit(rule.method).alias("method"), F.lit(pattern_index).alias("pattern_index"),
        strip(F.regexp_extract(whole, rule.patterns[pattern_index], 1)).alias("value"), around.alias("snippet"),
    )
    return F.when(whole != "", found)


def extract_fields(pages: DataFrame, rules: list[FieldRule] = FIELD_RULES) -> DataFrame:
    """At most one row a document and field: the first page that matches, its first pattern.

    Each page is stripped of markup and lowered once. A pattern scans it where a cue of its
    rule occurs and no pattern before it matched, once, for its whole match; value and place
    come from the match. What leaves a page is narrow: one hit a rule.
    """
    page = pages.select("document_id", "page_number", strip_markup(F.col("text")).alias("clean"))
    page = page.select("*", F.lower(F.translate("clean", *_FOLDED)).alias("low"))
    for k in range(max(len(rule.patterns) for rule in rules)):
        scans = {}
        for i, rule in enumerate(rules):
            if k < len(rule.patterns):
                cued = F.lit(False)
                for cue in rule.cues or ("",):
                    cued = cued | F.contains(F.col("low"), F.lit(cue))
                open_ = cued if k == 0 else cued & (F.coalesce(F.col(f"_w{i}_{k - 1}"), F.lit("")) == "")
                scans[f"_w{i}_{k}"] = F.when(open_, F.regexp_extract("clean", rule.patterns[k], 0))
        page = page.withColumns(scans)  # a stage of its own: each match is worked out once
    found = [F.coalesce(*[_hit(i, rule, k, F.col(f"_w{i}_{k}")) for k in range(len(rule.patterns))]) for i, rule in enumerate(rules)]
    rows = page.select("document_id", "page_number", F.explode(F.array_compact(F.array(*found))).alias("h")).select("document_id", "page_number", "h.*")
    best = rows.groupBy("document_id", "field_index", "field_name", "method").agg(F.min_by(F.struct("value", "snippet", "page_number"), "page_number").alias("b"))
    out = best.select("document_id", "field_index", "field_name", F.col("b.value").alias("field_value"), "method", F.col("b.snippet").alias("snippet"), F.col("b.page_number").alias("page_number"))
    return out.withColumn("confidence", confidence(F.col("field_name"), F.col("field_value"))).withColumn("evidence_id", F.concat(F.lit("page:"), F.col("page_number")))


DATE_FIELDS = ("service_date", "date_of_loss", "date_of_service", "invoice_date", "report_date")
CURRENCY_FIELDS = ("total_amount", "balance_due", "net_payment", "deductible")


def normalize_currency(value: Column) -> Column:
    """Two decimals without sign and separators; null for what is no number."""
    number = F.regexp_replace(value, r"[$,\s]", "").try_cast("double")
    return F.when(number.isNotNull(), F.format_string("%.2f", number))


def postprocess_fields(fields: DataFrame) -> DataFrame:
    """Dates as ISO text, amounts with two decimals, confidences in [0, 1], with an audit."""
    value = F.col("original_value")
    iso = F.date_format(parse_date(value, POSTPROCESS_DATES), "yyyy-MM-dd")
    is_date, is_money = F.col("field_name").isin(*DATE_FIELDS), F.col("field_name").isin(*CURRENCY_FIELDS)
    normal = F.when(is_date, F.coalesce(iso, value)).when(is_money, F.coalesce(normalize_currency(value), value)).otherwise(value)
    change = F.when(F.col("_normal") == value, None).when(is_date, "date_normalization").when(is_money, "currency_normalization")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    # Stages of their own: what two columns need is worked out once.
    out = fields.withColumn("original_value", strip(F.col("field_value"))).withColumn("_normal", normal)
    out = out.withColumns(
        {
            "change_type": change,
            "whitespace_cleaned": value != F.col("field_value"),
            "confidence_clamped": clamped != F.col("confidence"),
            "confidence": clamped,
            "field_value": F.col("_normal"),
        }
    )
    return out.drop("_normal")


def postprocess_audit(processed: DataFrame) -> DataFrame:
    """Per document how many fields were touched, by kind of change."""
    return processed.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("fields_processed"),
        F.count_if(F.col("change_type") == "date_normalization").alias("dates_normalized"),
        F.count_if(F.col("change_type") == "currency_normalization").alias("currencies_normalized"),
        F.count_if("confidence_clamped").alias("confidences_clamped"),
        F.count_if("whitespace_cleaned").alias("whitespace_cleaned"),
    )


def dedup_evidence(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """One reference for each chunk inside ``keys``: the highest score, the first of equals.

    ``evidence`` has position, chunk_id and relevance_score; survivors keep their position.
    """
    order = Window.partitionBy(*keys, "chunk_id").orderBy(F.desc("relevance_score"), "position")
    return evidence.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def package_evidence(chunks: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Chunks as evidence: text cut to 300 characters, score 1 unless one is given."""
    if scores is not None:
        chunks = chunks.join(scores.select("chunk_id", F.col("score").alias("_score")), "chunk_id", "left")
    else:
        chunks = chunks.withColumn("_score", F.lit(None).cast("double"))
    return chunks.select(
        "document_id", "chunk_id", F.substring("text", 1, 300).alias("chunk_text"), F.coalesce("_score", F.lit(1.0)).alias("relevance_score"),
        "page_numbers", "source_filename", "doc_type", "section_label", "parse_quality", "char_start", "char_end",
    )
