"""Queries over the whole tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import chunking, cleaning, evaluation, extraction, grounding, ops, parsing, ranking, review, routing, sections, selection, semantic
from docloom.plans.ingest import ingest_pages
from docloom.sources import inputs as I

QUERY = "the order of payment and balance"
AS_OF = "1998-01-01"
BUDGET = 5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _bigint_counts(sql: str) -> str:
    """``count_if(x)`` as a filtered count, which is a BIGINT like the engine's own."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + len('count_if('):end - 1]}){sql[end:]}"
    return sql


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _bigint_counts(sql)
        return f

    return add


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# --- parsing, cleaning, routing -------------------------------------------------------

_WS = r"[\s\x1c-\x1f]"


@query(
    f"""WITH {I.FILES}, m AS (
  SELECT *, lower(regexp_extract(filename, '[^/.](\\.[^./]+)$', 1)) AS file_suffix, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS chars FROM files),
f AS (SELECT *, CASE WHEN text IS NULL THEN 'file_not_found' WHEN file_suffix NOT IN ('.txt', '.md', '.text') THEN 'unsupported_file_type' WHEN chars = 0 THEN 'empty_extraction' ELSE 'none' END AS failure_reason FROM m)
SELECT document_id, filename, file_suffix, failure_reason, CASE WHEN failure_reason = 'none' THEN 'good' ELSE 'unusable' END AS quality,
  CASE WHEN failure_reason = 'none' THEN CAST(chars AS INTEGER) ELSE 0 END AS total_chars, CASE WHEN failure_reason = 'none' THEN 'parsed' ELSE 'failed' END AS status FROM f"""
)
def parse_text(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.parse_text_files(I.files(spark, sf)).select("document_id", "filename", "file_suffix", "failure_reason", "quality", "total_chars", "status")


@query(
    f"""WITH {I.PAGES}, c AS (SELECT document_id, count(*) AS page_count, count_if(length(trim(text, chr(32) || chr(10) || chr(9) || chr(13))) = 0) AS empty_page_count,
  CAST(sum(length(trim(text, chr(32) || chr(10) || chr(9) || chr(13)))) AS BIGINT) AS total_chars FROM pages GROUP BY document_id)
SELECT document_id, page_count, empty_page_count, total_chars, round(total_chars / page_count, 4) AS text_density,
  total_chars = 0 OR total_chars / page_count < 50 AS likely_scanned, total_chars = 0 OR total_chars / page_count < 20 OR empty_page_count / page_count > 0.5 AS likely_needs_ocr,
  CASE WHEN total_chars = 0 THEN 'unusable' WHEN total_chars / page_count < 50 THEN 'degraded' ELSE 'good' END AS quality FROM c"""
)
def assess_pages(spark: SparkSession, sf: str) -> DataFrame:
    out = parsing.assess_pages(I.pages(spark, sf))
    return out.select("document_id", "page_count", "empty_page_count", "total_chars", F.round("text_density", 4).alias("text_density"), "likely_scanned", "likely_needs_ocr", "quality")


@query(
    f"""WITH {I.PAGES}, s AS (SELECT document_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM pages),
e AS (SELECT document_id, 'top' AS edge, unnest(list_slice(l, 1, 3)) AS line FROM s UNION ALL SELECT document_id, 'bottom', unnest(list_slice(l, greatest(len(l) - 2, 1), len(l))) FROM s),
c AS (SELECT document_id, edge, line, count(*) AS n FROM e WHERE length(line) < 200 GROUP BY ALL), z AS (SELECT document_id, count(*) AS pages FROM pages GROUP BY document_id)
SELECT document_id, coalesce(array_to_string(list(line ORDER BY line) FILTER (edge = 'top'), '|'), '') AS headers, coalesce(array_to_string(list(line ORDER BY line) FILTER (edge = 'bottom'), '|'), '') AS footers
FROM c JOIN z USING (document_id) WHERE pages >= 3 AND n >= pages * 0.6 GROUP BY document_id"""
)
def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    out = cleaning.repeated_lines(I.pages(spark, sf))
    return out.select("document_id", F.array_join("headers", "|").alias("headers"), F.array_join("footers", "|").alias("footers"))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS document_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{4,}', repeat(chr(10), 3), 'g') AS text FROM documents"""
)
def squeeze_text(spark: SparkSession, sf: str) -> DataFrame:
    d = I.table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("document_id"), cleaning.squeeze_whitespace(cleaning.strip_control(F.col("text"))).alias("text"))


@query()
def clean_audit(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_audit(cleaning.clean_pages(I.pages(spark, sf)))


def _route_sql(source: str, sample: str) -> str:
    """The routing rules as SQL, made from the same rule tables."""
    rules = []
    for pattern, kind, weight in routing.FILENAME_RULES:
        rules.append((f"regexp_matches(lower(regexp_replace(filename, '\\.[^.]*$', '')), {_quoted(pattern)})", kind, f"CAST({weight} AS DOUBLE)"))
    for words, kind, weight in routing.CONTENT_RULES:
        hits = " + ".join(f"CAST(contains(lower({sample}), {_quoted(w)}) AS INTEGER)" for w in words)
        rules.append((f"({hits}) >= 2", kind, f"CAST({weight} AS DOUBLE) * least(({hits}) / 3.0, 1.5)"))
    union = " UNION ALL ".join(f"SELECT document_id, {i} AS r, {_quoted(k)} AS t, {w} AS w FROM {source} WHERE {c}" for i, (c, k, w) in enumerate(rules))
    return f"""m AS ({union}), sc AS (SELECT document_id, t, sum(w) AS s, min(r) AS f FROM m GROUP BY ALL),
rk AS (SELECT document_id, t, s, row_number() OVER (PARTITION BY document_id ORDER BY s DESC, f) AS n, sum(s) OVER (PARTITION BY document_id) AS total FROM sc),
routed AS (SELECT d.document_id, coalesce(rk.t, 'unknown') AS predicted_type, coalesce(round(least(s / greatest(total, 1.0), 1.0), 3), 0.0) AS confidence
  FROM (SELECT DISTINCT document_id FROM {source}) d LEFT JOIN rk ON rk.document_id = d.document_id AND n = 1)"""


@query(f"WITH {I.INVOICES}, {_route_sql('invoices', 'text')} SELECT * FROM routed")
def route_invoices(spark: SparkSession, sf: str) -> DataFrame:
    d = I.invoices(spark, sf).select("document_id", "filename", F.col("text").alias("sample"))
    return routing.route(d).select("document_id", "predicted_type", "confidence")


@query(
    f"""WITH {I.INVOICES}, {_route_sql('invoices', 'text')}
SELECT count_if(ok) AS routing_correct, count_if(NOT ok) AS routing_incorrect, round(avg(CAST(ok AS INTEGER)), 6) AS routing_accuracy
FROM (SELECT predicted_type = CASE WHEN c_mktsegment = 'BUILDING' THEN 'legal' ELSE 'billing' END OR predicted_type = 'correspondence' AS ok FROM routed JOIN invoices USING (document_id))"""
)
def routing_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    d = I.invoices(spark, sf)
    actual = routing.route(d.select("document_id", "filename", F.col("text").alias("sample"))).select(F.col("document_id").alias("fixture"), "predicted_type")
    expected = d.select(F.col("document_id").alias("fixture"), F.when(F.col("c_mktsegment") == "BUILDING", "legal").otherwise("billing").alias("expected_type"), F.array(F.lit("correspondence")).alias("accept_types"))
    return evaluation.routing_accuracy(actual, expected).withColumn("routing_accuracy", F.round("routing_accuracy", 6))


# --- chunking ---------------------------------------------------------------------------

_CHUNKS = f"""{I.PAGES}, placed AS (
  SELECT document_id, page_number, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ps FROM pages),
alive AS (SELECT document_id FROM pages GROUP BY document_id HAVING max(length(trim(text, chr(32) || chr(10)))) > 0),
whole AS (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS t FROM pages JOIN alive USING (document_id) GROUP BY document_id),
cut AS (SELECT document_id, t, unnest(range(0, length(t), 600)) AS o FROM whole),
chunks AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY o) - 1 AS INTEGER) AS chunk_index, substring(t, o + 1, 800) AS text,
  CAST(o AS BIGINT) AS char_start, CAST(least(o + 800, length(t)) AS BIGINT) AS char_end FROM cut),
paged AS (SELECT c.document_id, c.chunk_index, list(p.page_number ORDER BY p.page_number) AS page_numbers FROM chunks c JOIN placed p
  ON p.document_id = c.document_id AND p.ps < c.char_end AND p.ps + length(p.text) > c.char_start GROUP BY ALL),
ch AS (SELECT c.*, coalesce(page_numbers, []) AS page_numbers, lower(sha256(c.document_id || '|fixed_size|' || c.chunk_index))[1:32] AS chunk_id, count(*) OVER (PARTITION BY c.document_id) AS total
  FROM chunks c LEFT JOIN paged USING (document_id, chunk_index))"""


@query(f"WITH {_CHUNKS} SELECT document_id, chunk_id, chunk_index, text, array_to_string(page_numbers, ',') AS page_numbers, char_start, char_end, CAST(length(text) // 4 AS INTEGER) AS token_estimate FROM ch")
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    out = chunking.chunk(I.pages(spark, sf))
    return out.select("document_id", "chunk_id", "chunk_index", "text", F.array_join(F.col("page_numbers").cast("array<string>"), ",").alias("page_numbers"), "char_start", "char_end", "token_estimate")


@query(
    f"""WITH {_CHUNKS}, pc AS (SELECT document_id, page_number, ps, text, unnest(CASE WHEN length(text) <= 800 THEN [0] ELSE range(0, length(text), 600) END) AS o FROM placed JOIN alive USING (document_id)
  WHERE length(text) > 800 OR length(trim(text, chr(32) || chr(10))) > 0)
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY ps + o, ps + o + length(substring(text, o + 1, 800))) - 1 AS INTEGER) AS chunk_index, page_number, substring(text, o + 1, 800) AS text, CAST(ps + o AS BIGINT) AS char_start FROM pc"""
)
def chunk_pages(spark: SparkSession, sf: str) -> DataFrame:
    out = chunking.chunk(I.pages(spark, sf), chunking.ChunkConfig("page_bounded"))
    return out.select("document_id", "chunk_index", F.get("page_numbers", F.lit(0)).alias("page_number"), "text", "char_start")


@query(
    rf"""WITH RECURSIVE {_CHUNKS}, pa AS (SELECT document_id, string_split_regex(t, '\n\s*\n') AS parts, list_prepend('', regexp_extract_all(t, '\n\s*\n')) AS gaps FROM whole),
pi AS (SELECT document_id, unnest(parts) AS part, unnest(gaps) AS gap, generate_subscripts(parts, 1) AS n FROM pa),
ps AS (SELECT *, sum(length(part) + length(gap)) OVER (PARTITION BY document_id ORDER BY n) - length(part) - CASE WHEN part = '' THEN length(gap) ELSE 0 END AS beg FROM pi),
ru(document_id, n, run, w) AS (SELECT document_id, n, 1, length(part) + 2 FROM ps WHERE n = 1
  UNION ALL SELECT p.document_id, p.n, CASE WHEN r.w + length(p.part) > 800 THEN r.run + 1 ELSE r.run END, CASE WHEN r.w + length(p.part) > 800 THEN 0 ELSE r.w END + length(p.part) + 2 FROM ru r JOIN ps p ON p.document_id = r.document_id AND p.n = r.n + 1),
g AS (SELECT document_id, run, string_agg(part, chr(10) || chr(10) ORDER BY n) AS text, CAST(first(beg ORDER BY n) AS BIGINT) AS s FROM ru JOIN ps USING (document_id, n) GROUP BY document_id, run),
gp AS (SELECT g.document_id, run, string_agg(CAST(p.page_number AS VARCHAR), ',' ORDER BY p.page_number) AS pages FROM g JOIN placed p ON p.document_id = g.document_id AND p.ps < s + length(g.text) AND p.ps + length(p.text) > s GROUP BY g.document_id, run)
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY s, s + length(text)) - 1 AS INTEGER) AS chunk_index, text, coalesce(pages, '') AS page_numbers, s AS char_start, s + length(text) AS char_end FROM g LEFT JOIN gp USING (document_id, run)"""
)
def chunk_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    out = chunking.chunk(I.pages(spark, sf), chunking.ChunkConfig("paragraph"))
    return out.select("document_id", "chunk_index", "text", F.array_join(F.col("page_numbers").cast("array<string>"), ",").alias("page_numbers"), "char_start", "char_end")


@query(
    f"""WITH {_CHUNKS}, pg AS (SELECT document_id, count(DISTINCT p) AS pages FROM (SELECT document_id, unnest(page_numbers) AS p FROM ch) GROUP BY document_id)
SELECT document_id, count(*) AS chunk_count, round(avg(length(text)), 1) AS avg_chunk_chars, CAST(sum(length(text)) AS BIGINT) AS total_chars_chunked, any_value(pages) AS pages FROM ch JOIN pg USING (document_id) GROUP BY document_id"""
)
def chunk_meta(spark: SparkSession, sf: str) -> DataFrame:
    out = chunking.chunk_meta(chunking.chunk(I.pages(spark, sf)))
    return out.select("document_id", "chunk_count", "avg_chunk_chars", "total_chars_chunked", F.size("page_coverage").cast("long").alias("pages"))


@query(
    """WITH d AS (SELECT c_custkey AS id, count(o_orderkey) AS page_count, CAST(sum(o_totalprice) AS BIGINT) AS total_chars, CAST(sum(o_totalprice) / 10 AS BIGINT) AS file_size_bytes, count(*) AS chunk_count FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey),
r AS (SELECT *, greatest(CASE WHEN page_count <= 20 THEN 0 WHEN page_count <= 200 THEN 1 WHEN page_count <= 2000 THEN 2 ELSE 3 END, CASE WHEN total_chars <= 50000 THEN 0 WHEN total_chars <= 1000000 THEN 1 WHEN total_chars <= 10000000 THEN 2 ELSE 3 END,
  CASE WHEN file_size_bytes <= 50000 THEN 0 WHEN file_size_bytes <= 2000000 THEN 1 WHEN file_size_bytes <= 50000000 THEN 2 ELSE 3 END) AS k FROM d)
SELECT CAST(id AS VARCHAR) AS document_id, ['small', 'medium', 'large', 'oversized'][k + 1] AS category, CAST(CASE k WHEN 0 THEN chunk_count WHEN 1 THEN least(chunk_count, 15) WHEN 2 THEN least(chunk_count, 20) ELSE least(chunk_count, 25) END AS INTEGER) AS recommended_max_llm_chunks FROM r"""
)
def document_sizes(spark: SparkSession, sf: str) -> DataFrame:
    d = I.table(spark, sf, "customer").join(I.table(spark, sf, "orders"), F.expr("c_custkey = o_custkey")).groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("page_count"), F.round(F.sum("o_totalprice")).cast("long").alias("total_chars"), F.round(F.sum("o_totalprice") / 10).cast("long").alias("file_size_bytes"), F.count(F.lit(1)).alias("chunk_count")
    )
    return chunking.classify_size(d.withColumn("document_id", F.col("c_custkey").cast("string"))).drop("partial_view", "warnings")


# --- sections -----------------------------------------------------------------------------

_HEAD = "CASE " + " ".join(f"WHEN length(line) < 80 AND regexp_matches(line, {_quoted(p)}, 'i') THEN {_quoted(lbl)}" for p, lbl in sections.KNOWN_SECTIONS)


@query(
    f"""WITH {I.INVOICES}, l AS (SELECT document_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM invoices),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cs FROM l),
h AS (SELECT document_id, text, n, cs, {_HEAD} WHEN regexp_matches(line, '{sections.ALLCAPS}') THEN '#caps#' || line WHEN regexp_matches(line, '{sections.NUMBERED}') THEN line[1:60] WHEN regexp_matches(line, '{sections.ROMAN}') THEN line[1:60] END AS label FROM o WHERE length(line) BETWEEN 3 AND 120),
k AS (SELECT *, lead(cs) OVER w AS nx, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS fresh FROM h WHERE label IS NOT NULL WINDOW w AS (PARTITION BY document_id ORDER BY cs)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY cs) - 1 AS section_index FROM k)
SELECT document_id, CAST(section_index AS BIGINT) AS section_index, first(label ORDER BY cs) AS label, CAST(min(cs) AS BIGINT) AS char_start, CAST(max(coalesce(nx, length(text) + 2)) AS BIGINT) AS char_end FROM g GROUP BY document_id, section_index"""
)
def detect_sections(spark: SparkSession, sf: str) -> DataFrame:
    out = sections.detect_sections(I.invoices(spark, sf).select("document_id", "page_number", "text"))
    label = F.when(F.col("method") == "allcaps_heading", F.concat(F.lit("#caps#"), F.upper("label"))).otherwise(F.col("label"))
    return out.select("document_id", "section_index", label.alias("label"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


def _invoice_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = I.invoices(spark, sf)
    return ingest_pages(d.select("document_id", "page_number", "text"), d.select("document_id", "filename"), chunking.ChunkConfig(chunk_size=120, overlap=20))


@query()
def enriched_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _invoice_chunks(spark, sf)


# --- extraction -----------------------------------------------------------------------------


def _field_sql() -> str:
    def rx(p: str) -> str:
        return _quoted(p.replace("(?iuU)", "(?i)").replace("(?U)(?iu:", "(?i:"))

    parts = []
    for i, rule in enumerate(extraction.FIELD_RULES):
        cases = " ".join(f"WHEN regexp_matches(c, {rx(p)}) THEN trim(regexp_extract(c, {rx(p)}, 1))" for p in rule.patterns)
        parts.append(f"SELECT document_id, {i} AS field_index, {_quoted(rule.name)} AS field_name, CASE {cases} END AS field_value FROM cl")
    return f"""cl AS (SELECT document_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\*{{1,3}}|_{{1,3}}', '', 'g'), '\\|', ' ', 'g'), '(?m)^#{{1,6}}\\s+', '', 'g'), '  +', ' ', 'g') AS c FROM invoices),
fields AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE field_value IS NOT NULL)"""


_FIELDS = f"{I.INVOICES}, {_field_sql()}"
_CONFIDENCE = "CASE WHEN field_name = 'total_amount' THEN 0.9 WHEN field_name IN ('patient_name', 'provider_name') THEN 0.8 WHEN field_name = 'service_date' THEN 0.85 ELSE 0.9 END"


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extract_fields(I.invoices(spark, sf).select("document_id", "page_number", "text"))


@query(f"WITH {_FIELDS} SELECT document_id, field_index, field_name, field_value, CAST({_CONFIDENCE} AS DOUBLE) AS confidence, 'page:1' AS evidence_id FROM fields")
def extract_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _fields(spark, sf).select("document_id", "field_index", "field_name", "field_value", "confidence", "evidence_id")


@query(
    f"""WITH {_FIELDS} SELECT document_id, field_name, CASE WHEN field_name = 'service_date' THEN strftime(try_strptime(field_value, '%m/%d/%Y'), '%Y-%m-%d') WHEN field_name = 'total_amount' THEN printf('%.2f', TRY_CAST(replace(field_value, ',', '') AS DOUBLE)) ELSE field_value END AS field_value,
  CASE WHEN field_name = 'service_date' THEN 'date_normalization' END AS change_type FROM fields"""
)
def normalized_fields(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.postprocess_fields(_fields(spark, sf)).select("document_id", "field_name", "field_value", "change_type")


@query(f"WITH {_FIELDS} SELECT document_id, count(*) AS fields_processed, count_if(field_name = 'service_date') AS dates_normalized, CAST(0 AS BIGINT) AS currencies_normalized FROM fields GROUP BY document_id")
def normalization_audit(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.postprocess_audit(extraction.postprocess_fields(_fields(spark, sf))).select("document_id", "fields_processed", "dates_normalized", "currencies_normalized")


@query(
    """SELECT l_orderkey AS chunk_group, l_partkey % 3 AS chunk_id, l_quantity AS relevance_score, l_linenumber AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1"""
)
def dedup_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk_group"), (F.col("l_partkey") % 3).alias("chunk_id"), F.col("l_quantity").alias("relevance_score"), F.col("l_linenumber").alias("position"))
    return extraction.dedup_evidence(rows, ["chunk_group"])


# --- ranking and selection --------------------------------------------------------------------


def _share_sql(column: str) -> str:
    terms = ranking.query_terms(QUERY)
    return "(" + " + ".join(f"CAST(contains(lower({column}), {_quoted(t)}) AS INTEGER)" for t in terms) + f") / {float(len(terms))}"


_LEXICAL = f"lex AS (SELECT *, round({_share_sql('text')}, 4) AS score FROM ch), lexr AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_index) AS INTEGER) AS rank FROM lex)"
_SALIENCE = f"""sal AS (SELECT *, round(greatest(0.2 * (1 - abs(2 * (chunk_index / greatest(total - 1, 1)) - 1)) + CASE WHEN chunk_index < 3 THEN 0.15 ELSE 0 END + CASE WHEN chunk_index >= total - 3 THEN 0.10 ELSE 0 END
  + 0.3 * {_share_sql('text')}, 0.0), 4) AS score FROM ch), salr AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_index) AS INTEGER) AS rank FROM sal)"""


def _plain_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the paged documents, without labels."""
    return chunking.chunk(I.pages(spark, sf)).withColumns({"section_label": F.lit(""), "parse_quality": F.lit(""), "doc_type": F.lit(""), "source_filename": F.lit("")})


@query(f"WITH {_CHUNKS}, {_LEXICAL} SELECT document_id, chunk_id, rank, CAST(score AS DOUBLE) AS score FROM lexr WHERE rank <= 10")
def rank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rank_lexical(_plain_chunks(spark, sf), QUERY, 10).select("document_id", "chunk_id", "rank", "score")


@query(f"WITH {_CHUNKS}, {_SALIENCE} SELECT document_id, chunk_id, rank, CAST(score AS DOUBLE) AS score FROM salr WHERE rank <= 10")
def rank_salience(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rank_salience(_plain_chunks(spark, sf), QUERY, 10).select("document_id", "chunk_id", "rank", "score")


@query(
    f"""WITH {_CHUNKS}, {_LEXICAL}, {_SALIENCE}, u AS (SELECT document_id, chunk_id, 0 AS l, rank FROM lexr WHERE rank <= 30 UNION ALL SELECT document_id, chunk_id, 1, rank FROM salr WHERE rank <= 30),
f AS (SELECT document_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score, min(l * 100000 + rank) AS first FROM u GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY score DESC, first) AS INTEGER) AS rank FROM f)
SELECT document_id, chunk_id, rank, CAST(score AS DOUBLE) AS score FROM r WHERE rank <= 10"""
)
def rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    c = _plain_chunks(spark, sf)
    return ranking.fuse_signals(c, QUERY, ("lexical", "salience"), 30).filter("rank <= 10").select("document_id", "chunk_id", "rank", "score")


def _embedding_sql(text: str) -> str:
    """The hash embedding: chained digests, read as numbers, scaled to length one."""
    grown = f"list_reduce(['', '', '', '', '', '', ''], lambda a, x: a || sha256(unhex(a)), sha256({text}))"
    return f"list_transform(list_transform(range(64), lambda i: substr({grown}, i * 8 + 1, 8)), lambda x: CAST(('0x' || x) AS BIGINT) / 2147483648.0 - 1.0)"


@query(
    f"""WITH {_CHUNKS}, {_LEXICAL}, {_SALIENCE}, qe AS (SELECT {_embedding_sql(_quoted(QUERY))} AS q), ve AS (SELECT ch.*, round(list_cosine_similarity({_embedding_sql('text')}, q), 4) AS score FROM ch, qe),
ver AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_index) AS INTEGER) AS rank FROM ve),
u AS (SELECT document_id, chunk_id, 0 AS l, 'lexical' AS signal, rank, CAST(score AS DOUBLE) AS score FROM lexr WHERE rank <= {3 * BUDGET} UNION ALL SELECT document_id, chunk_id, 1, 'vector', rank, score FROM ver WHERE rank <= {3 * BUDGET}
  UNION ALL SELECT document_id, chunk_id, 2, 'salience', rank, CAST(score AS DOUBLE) FROM salr WHERE rank <= {3 * BUDGET}),
f AS (SELECT document_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score, min(l * 100000 + rank) AS first FROM u GROUP BY document_id, chunk_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY score DESC, first) AS INTEGER) AS rank FROM f)
SELECT document_id, signal, chunk_id, rank, score FROM u WHERE rank <= {BUDGET} UNION ALL SELECT document_id, 'fused', chunk_id, rank, CAST(score AS DOUBLE) FROM r WHERE rank <= {BUDGET}"""
)
def hybrid_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.retrieve_hybrid(_plain_chunks(spark, sf), QUERY, BUDGET)


_VECTOR = [((7 * i) % 11 - 5) / 5.0 for i in range(64)]


@query(
    f"""WITH e AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_VECTOR} AS DOUBLE[])) AS s FROM embeddings)
SELECT vec_id AS chunk_id, round(s, 6) AS score FROM e ORDER BY s DESC, vec_id LIMIT 10"""
)
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    entries = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("position"), F.col("embedding").cast("array<double>").alias("vector"))
    return ranking.vector_search(ranking.vector_index(entries), _VECTOR, 10).select("chunk_id", F.round("score", 6).alias("score"))


def _select_sql(where: str) -> str:
    return f"WITH {_CHUNKS} SELECT document_id, chunk_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS INTEGER) AS position FROM ch WHERE total <= {BUDGET} OR ({where})"


@query(_select_sql(f"chunk_index < {BUDGET}"))
def select_head(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_chunks(_plain_chunks(spark, sf), BUDGET, "head").select("document_id", "chunk_id", "position")


@query(_select_sql(f"chunk_index >= total - {BUDGET}"))
def select_tail(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_chunks(_plain_chunks(spark, sf), BUDGET, "tail").select("document_id", "chunk_id", "position")


@query(_select_sql(f"chunk_index < {BUDGET // 2} OR chunk_index >= total - {BUDGET - BUDGET // 2}"))
def select_head_tail(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_chunks(_plain_chunks(spark, sf), BUDGET, "head_tail").select("document_id", "chunk_id", "position")


@query(_select_sql(f"chunk_index IN ({', '.join(f'CAST(floor({i} * (total / {BUDGET}.0)) AS INTEGER)' for i in range(BUDGET))})"))
def select_sampled(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_chunks(_plain_chunks(spark, sf), BUDGET, "sampled").select("document_id", "chunk_id", "position")


@query(f"WITH {_CHUNKS}, {_SALIENCE} SELECT document_id, chunk_id, CASE WHEN total <= {BUDGET} THEN chunk_index + 1 ELSE rank END AS position FROM salr WHERE total <= {BUDGET} OR rank <= {BUDGET}")
def select_query_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_chunks(_plain_chunks(spark, sf), BUDGET, "query_ranked", QUERY).select("document_id", "chunk_id", "position")


_DIVERSIFIED = f"""{_SALIENCE}, dg AS (SELECT *, CASE WHEN len(page_numbers) > 0 THEN 'page-' || page_numbers[1] ELSE 'idx-' || (chunk_index // 5) END AS g FROM salr WHERE total > {BUDGET}),
dt AS (SELECT *, row_number() OVER (PARTITION BY document_id, g ORDER BY score DESC, chunk_index) AS turn, max(score) OVER (PARTITION BY document_id, g) AS best, min(chunk_index) OVER (PARTITION BY document_id, g) AS f FROM dg),
dp AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY turn, best DESC, f) AS pick FROM dt),
dv AS (SELECT document_id, chunk_id, chunk_index, page_numbers FROM dp WHERE pick <= {BUDGET} UNION ALL SELECT document_id, chunk_id, chunk_index, page_numbers FROM ch WHERE total <= {BUDGET})"""


@query(f"WITH {_CHUNKS}, {_DIVERSIFIED} SELECT document_id, chunk_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS INTEGER) AS position FROM dv")
def select_diversified(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_chunks(_plain_chunks(spark, sf), BUDGET, "diversified", QUERY).select("document_id", "chunk_id", "position")


@query(
    f"""WITH {_CHUNKS}, {_DIVERSIFIED}, n AS (SELECT document_id, count(*) AS page_count FROM pages GROUP BY document_id), a AS (SELECT document_id, count(*) AS total_chunks FROM ch GROUP BY document_id),
s AS (SELECT document_id, count(*) AS selected_chunks FROM dv GROUP BY document_id), p AS (SELECT document_id, count(DISTINCT x) AS pages FROM (SELECT document_id, unnest(page_numbers) AS x FROM dv) GROUP BY document_id),
r AS (SELECT document_id, total_chunks, selected_chunks, page_count, coalesce(pages, 0) AS pages, selected_chunks / total_chunks AS c, coalesce(pages, 0) / page_count AS q FROM a JOIN s USING (document_id) JOIN n USING (document_id) LEFT JOIN p USING (document_id))
SELECT document_id, total_chunks, selected_chunks, round(c, 4) AS chunk_coverage_ratio, pages AS pages_seen, round(q, 4) AS page_coverage_ratio,
  CASE WHEN (c + q + 1.0) / 3.0 >= 0.8 THEN 'comprehensive' WHEN (c + q + 1.0) / 3.0 >= 0.5 THEN 'good' WHEN (c + q + 1.0) / 3.0 >= 0.25 THEN 'partial' ELSE 'minimal' END AS coverage_level FROM r"""
)
def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    c = _plain_chunks(spark, sf)
    docs = I.pages(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"))
    out = selection.coverage_report(c, selection.select_chunks(c, BUDGET, "diversified", QUERY), docs)
    return out.select("document_id", "total_chunks", "selected_chunks", "chunk_coverage_ratio", F.size("pages_covered").cast("long").alias("pages_seen"), "page_coverage_ratio", "coverage_level")


_PICKS = f"""{_CHUNKS}, {_DIVERSIFIED}, picks AS (
  SELECT document_id, chunk_id, 'diversified' AS strategy, score, total FROM salr SEMI JOIN dv USING (document_id, chunk_id)
  UNION ALL SELECT document_id, chunk_id, 'routing_aware', score, total FROM salr WHERE total <= {BUDGET} OR chunk_index < {BUDGET // 2} OR chunk_index >= total - {BUDGET - BUDGET // 2}
  UNION ALL SELECT document_id, chunk_id, 'sampled', score, total FROM salr WHERE total <= {BUDGET} OR chunk_index IN ({', '.join(f'CAST(floor({i} * (total / {BUDGET}.0)) AS INTEGER)' for i in range(BUDGET))})
  UNION ALL
  SELECT document_id, chunk_id, 'head' AS strategy, score, total FROM salr WHERE total <= {BUDGET} OR chunk_index < {BUDGET}
  UNION ALL SELECT document_id, chunk_id, 'head_tail', score, total FROM salr WHERE total <= {BUDGET} OR chunk_index < {BUDGET // 2} OR chunk_index >= total - {BUDGET - BUDGET // 2}
  UNION ALL SELECT document_id, chunk_id, 'query_ranked', score, total FROM salr WHERE total <= {BUDGET} OR rank <= {BUDGET})"""


def _picks(spark: SparkSession, sf: str) -> DataFrame:
    return selection.compare_strategies(_plain_chunks(spark, sf), QUERY, BUDGET)


@query(f"WITH {_PICKS} SELECT x.document_id, x.strategy AS a, y.strategy AS b, count_if(x.chunk_id = y.chunk_id) AS shared FROM picks x JOIN picks y ON x.document_id = y.document_id GROUP BY ALL")
def strategy_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return selection.overlap_matrix(_picks(spark, sf), selection.STRATEGIES)


@query(f"WITH {_PICKS}, one AS (SELECT document_id, chunk_id, min(strategy) AS strategy FROM picks GROUP BY document_id, chunk_id HAVING count(*) = 1) SELECT document_id, strategy, array_to_string(list(chunk_id ORDER BY chunk_id), ',') AS chunk_ids FROM one GROUP BY ALL")
def strategy_unique(spark: SparkSession, sf: str) -> DataFrame:
    return selection.unique_chunks(_picks(spark, sf)).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query(
    f"""WITH {_PICKS}, m AS (SELECT document_id, count(DISTINCT strategy) AS strategy_count, floor((2 * sum(CAST(round(score * 10000) AS BIGINT)) FILTER (strategy = 'head') + count(*) FILTER (strategy = 'head')) / (2 * count(*) FILTER (strategy = 'head'))) / 10000.0 AS h, floor((2 * sum(CAST(round(score * 10000) AS BIGINT)) FILTER (strategy = 'query_ranked') + count(*) FILTER (strategy = 'query_ranked')) / (2 * count(*) FILTER (strategy = 'query_ranked'))) / 10000.0 AS q, any_value(total) AS total,
  list(DISTINCT chunk_id) FILTER (strategy = 'head') AS hs, list(DISTINCT chunk_id) FILTER (strategy = 'query_ranked') AS qs FROM picks GROUP BY document_id)
SELECT document_id, strategy_count, h AS head_avg_relevance, q AS query_ranked_avg_relevance, round(q - h, 4) AS relevance_lift, round(len(list_intersect(hs, qs)) / len(list_distinct(list_concat(hs, qs))), 4) AS selected_overlap, round({BUDGET} / total, 4) AS token_efficiency FROM m"""
)
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _plain_chunks(spark, sf)
    totals = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    return evaluation.retrieval_metrics(_picks(spark, sf).join(totals, "document_id"), BUDGET)


# --- semantic tasks ------------------------------------------------------------------------------


@query(
    f"""WITH {_FIELDS}, {_route_sql('invoices', 'text')}, n AS (SELECT document_id, count(*) AS field_count FROM fields GROUP BY document_id),
s AS (SELECT r.document_id, confidence, coalesce(field_count, 0) AS fc FROM routed r LEFT JOIN n USING (document_id)),
w AS (SELECT document_id, CASE WHEN confidence < 0.4 THEN 0.4 ELSE 0 END + 0.2 + CASE WHEN fc = 0 THEN 0.5 ELSE 0 END AS review, 0.8 + CASE WHEN confidence >= 0.4 THEN 0.3 ELSE 0 END + CASE WHEN fc > 0 THEN 0.4 ELSE 0 END AS support FROM s)
SELECT document_id, CASE WHEN review >= support THEN 'review_recommended' ELSE 'ready' END AS label,
  CAST(round(CASE WHEN review >= support THEN least(0.55 + review / greatest(review + support, 1.0) * 0.35, 0.95) ELSE least(0.6 + support / greatest(review + support, 1.0) * 0.35, 0.97) END, 4) AS DOUBLE) AS confidence FROM w"""
)
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    d = I.invoices(spark, sf)
    counts = _fields(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)).alias("field_count"))
    routed = routing.route(d.select("document_id", "filename", F.col("text").alias("sample"))).select("document_id", F.col("confidence").alias("routing_confidence"))
    rows = routed.join(counts, "document_id", "left").withColumns({"field_count": F.coalesce("field_count", F.lit(0)), "parse_quality": F.lit("good"), "likely_needs_ocr": F.lit(False), "chunk_count": F.lit(1)})
    return semantic.readiness(rows).select("document_id", "label", "confidence")


@query()
def field_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.align_fields(_fields(spark, sf), _invoice_chunks(spark, sf))


@query(
    rf"""WITH {_CHUNKS}, se AS (SELECT document_id, chunk_index, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(57344), 'g'), chr(57344)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM ch),
su AS (SELECT document_id, chunk_index, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM se), sw AS (SELECT *, list_filter(string_split_regex(s, '\s+'), lambda x: x <> '') AS w FROM su),
sc AS (SELECT *, least(len(w) / 15.0, 1.0) + CASE WHEN regexp_matches(s, '\d') THEN 0.3 ELSE 0.0 END + CASE WHEN len(list_filter(w[2:], lambda x: regexp_matches(x[1], '\p{{Lu}}'))) > 0 THEN 0.2 ELSE 0.0 END AS k FROM sw),
rk AS (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_index ORDER BY k DESC, i) AS r FROM sc), fl AS (SELECT *, row_number() OVER (PARTITION BY document_id, lower(s) ORDER BY chunk_index, r) AS d FROM rk WHERE r <= 3),
ky AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, r) AS n FROM fl WHERE d = 1), kf AS (SELECT document_id, string_agg(s, ' ' ORDER BY n) AS facts FROM ky WHERE n <= 10 GROUP BY document_id),
cn AS (SELECT document_id, count(*) AS chunk_count, string_agg(chunk_id, ',' ORDER BY chunk_index) AS chunk_ids FROM ch GROUP BY document_id), pg AS (SELECT document_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS pages FROM (SELECT DISTINCT document_id, unnest(page_numbers) AS p FROM ch) GROUP BY document_id)
SELECT document_id, '(unsectioned)' AS section_label, CAST(chunk_count AS INTEGER) AS chunk_count, coalesce(pages, '') AS page_range, chunk_ids, substring(coalesce(facts, ''), 1, 500) AS condensed_text FROM cn LEFT JOIN pg USING (document_id) LEFT JOIN kf USING (document_id)"""
)
def section_summaries(spark: SparkSession, sf: str) -> DataFrame:
    out = semantic.section_summaries(semantic.chunk_facts(_plain_chunks(spark, sf)))
    return out.select("document_id", "section_label", "chunk_count", F.array_join(F.col("page_range").cast("array<string>"), ",").alias("page_range"), F.array_join("chunk_ids", ",").alias("chunk_ids"), "condensed_text")


# --- review --------------------------------------------------------------------------------------


@query(
    f"""WITH {_FIELDS}, {_route_sql('invoices', 'text')}, u AS (SELECT f.document_id, count_if((field_name = 'total_amount' AND (TRY_CAST(replace(field_value, ',', '') AS DOUBLE) <= 0 OR TRY_CAST(replace(field_value, ',', '') AS DOUBLE) > 1000000))
    OR (field_name = 'service_date' AND try_strptime(field_value, '%m/%d/%Y') > DATE '{AS_OF}' + INTERVAL 730 DAY)) AS odd, count(*) AS n, min({_CONFIDENCE}) AS mc FROM fields f GROUP BY f.document_id),
t AS (SELECT r.document_id, list_filter([CASE WHEN confidence < 0.4 THEN 'low_routing_confidence' END, CASE WHEN predicted_type IN ('legal', 'medical') THEN 'critical_document_type' END, CASE WHEN odd > 0 THEN 'unusual_extracted_value' END], lambda x: x IS NOT NULL) AS tr, n, mc FROM routed r JOIN u USING (document_id))
SELECT document_id, array_to_string(tr, ',') AS trigger_reasons, CAST(CASE WHEN len(tr) = 0 THEN 0 ELSE round(least(CASE WHEN list_contains(tr, 'unusual_extracted_value') THEN 0.72 WHEN list_contains(tr, 'critical_document_type') THEN 0.65 ELSE 0.35 END + least(len(tr) * 0.05, 0.15), 1.0), 3) END AS DOUBLE) AS priority_score,
  CASE WHEN len(tr) = 0 AND n >= 2 AND mc >= 0.85 THEN 'auto_accepted' ELSE 'pending_review' END AS status FROM t"""
)
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    d = I.invoices(spark, sf)
    routed = routing.route(d.select("document_id", "filename", F.col("text").alias("sample")))
    results = routed.select("document_id", F.col("predicted_type").alias("document_type"), F.col("confidence").alias("routing_confidence"), F.lit("good").alias("parse_quality"))
    return review.reviewables(results, _fields(spark, sf), AS_OF).select("document_id", F.array_join("trigger_reasons", ",").alias("trigger_reasons"), "priority_score", "status")


_EVENT_STATUS = "CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'click' THEN 'corrected' ELSE 'rejected' END"


@query(
    f"""SELECT CAST(u.user_id AS VARCHAR) AS document_id, arg_max({_EVENT_STATUS}, (ts, event_id)) AS status FROM events u GROUP BY user_id"""
)
def review_status(spark: SparkSession, sf: str) -> DataFrame:
    e = I.table(spark, sf, "events")
    decision = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "click", "corrected").otherwise("rejected")
    decisions = e.select(F.col("user_id").cast("string").alias("document_id"), decision.alias("decision"), F.struct("ts", "event_id").alias("decided_at"))
    queue = decisions.select("document_id").distinct().withColumn("status", F.lit("pending_review"))
    return review.current_status(queue, decisions)


@query(
    """WITH c AS (SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CASE o_orderstatus WHEN 'F' THEN 'field' WHEN 'O' THEN 'summary' ELSE 'mismatch' END AS kind, o_totalprice > 100000 AS high, starts_with(o_orderpriority, '1') AS retrieval, starts_with(o_orderpriority, '5') AS prompt FROM orders),
s AS (SELECT document_id, list_filter([CASE WHEN kind = 'field' THEN 'extraction_heuristic:' || CASE WHEN high THEN 'high' ELSE 'medium' END END, CASE WHEN kind = 'field' AND retrieval THEN 'retrieval_ranking:high' END, CASE WHEN kind = 'field' THEN 'evaluation_fixture:medium' END,
  CASE WHEN kind = 'summary' THEN 'summary_prompt:high' END, CASE WHEN kind = 'summary' THEN 'fine_tuning_data:low' END, CASE WHEN kind = 'mismatch' THEN 'retrieval_ranking:high' END, CASE WHEN kind = 'mismatch' AND prompt THEN 'summary_prompt:medium' END], lambda x: x IS NOT NULL) AS l FROM c)
SELECT document_id, string_split(x, ':')[1] AS category, string_split(x, ':')[2] AS priority, count(*) AS n FROM (SELECT document_id, unnest(l) AS x FROM s) GROUP BY ALL"""
)
def feedback_signals(spark: SparkSession, sf: str) -> DataFrame:
    o = I.table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "field").when(F.col("o_orderstatus") == "O", "summary").otherwise("mismatch")
    source = F.when(F.col("o_orderpriority").startswith("1"), "retrieval").when(F.col("o_orderpriority").startswith("5"), "prompt").otherwise("")
    rows = o.select(F.col("o_orderkey").cast("string").alias("document_id"), kind.alias("kind"), F.lit("total_amount").alias("field_name"), F.lit("1").alias("original_value"), F.lit("2").alias("corrected_value"), F.when(F.col("o_totalprice") > 100000, 0.9).otherwise(0.5).alias("original_confidence"), source.alias("failure_source"), F.lit("").alias("reason"))
    return review.feedback_signals(rows).groupBy("document_id", "category", "priority").agg(F.count(F.lit(1)).alias("n"))


# --- evaluation ------------------------------------------------------------------------------------

_EXPECTED = """ex AS (SELECT document_id AS fixture, 'total_amount' AS field_name, printf('%.2f', o_totalprice) AS ev, true AS must FROM invoices
  UNION ALL SELECT document_id, 'patient_name', CASE WHEN c_mktsegment = 'BUILDING' THEN 'JANE DOE' END, c_mktsegment = 'BUILDING' FROM invoices
  UNION ALL SELECT document_id, 'claim_number', CASE WHEN o_orderstatus = 'F' THEN 'X-1' END, o_orderstatus = 'F' FROM invoices),
mt AS (SELECT coalesce(ex.fixture, f.document_id) AS fixture, coalesce(ex.field_name, f.field_name) AS field_name, ev, f.field_value AS av, coalesce(must, false) AS must,
  CASE WHEN ev IS NULL THEN f.field_value IS NULL ELSE coalesce(lower(ev) = lower(f.field_value), false) END AS best
  FROM ex FULL JOIN (SELECT document_id, field_name, field_value FROM fields WHERE field_name IN ('total_amount', 'patient_name', 'claim_number', 'mrn')) f ON ex.fixture = f.document_id AND ex.field_name = f.field_name),
fm AS (SELECT {by} count_if(must AND ev IS NOT NULL AND best) AS tp, count_if((must AND ev IS NOT NULL AND NOT best AND av IS NOT NULL) OR (NOT must AND ev IS NULL AND av IS NOT NULL)) AS fp,
  count_if(must AND ev IS NOT NULL AND NOT best) AS fn, count_if(NOT must AND ev IS NULL AND av IS NULL) AS tn FROM mt {group}),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM fm)"""
_BY_FIXTURE = _EXPECTED.format(by="fixture,", group="GROUP BY fixture")


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    d = I.invoices(spark, sf)
    building, closed = F.col("c_mktsegment") == "BUILDING", F.col("o_orderstatus") == "F"
    expected = d.select(
        F.col("document_id").alias("fixture"),
        F.explode(
            F.array(
                F.struct(F.lit("total_amount").alias("field_name"), F.format_string("%.2f", "o_totalprice").alias("expected_value"), F.lit(True).alias("must_extract")),
                F.struct(F.lit("patient_name").alias("field_name"), F.when(building, "JANE DOE").alias("expected_value"), building.alias("must_extract")),
                F.struct(F.lit("claim_number").alias("field_name"), F.when(closed, "X-1").alias("expected_value"), closed.alias("must_extract")),
            )
        ).alias("x"),
    ).select("fixture", "x.*", F.lit(None).cast("string").alias("normalized"))
    actual = _fields(spark, sf).filter(F.col("field_name").isin("total_amount", "patient_name", "claim_number", "mrn")).select(F.col("document_id").alias("fixture"), "field_name", F.col("field_value").alias("actual_value"))
    return evaluation.match_fields(expected, actual)


@query(
    f"""WITH {_FIELDS}, {_BY_FIXTURE} SELECT fixture, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr"""
)
def field_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.field_metrics(_matches(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    f"""WITH {_FIELDS}, {_EXPECTED.format(by="", group="")} SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr"""
)
def micro_average(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.field_metrics(_matches(spark, sf), [])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    f"""WITH {_FIELDS}, {_BY_FIXTURE}, s AS (SELECT c_mktsegment AS slice_value, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f, tp FROM pr JOIN invoices ON fixture = document_id)
SELECT 'by_document_type' AS slice_name, slice_value, count(*) AS fixture_count, round(avg(p), 4) AS avg_precision, round(avg(r), 4) AS avg_recall, round(avg(f), 4) AS avg_f1, CAST(sum(tp) AS BIGINT) AS total_true_positives FROM s GROUP BY slice_value"""
)
def slice_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    slices = I.invoices(spark, sf).select(F.lit("by_document_type").alias("slice_name"), F.col("c_mktsegment").alias("slice_value"), F.col("document_id").alias("fixture"))
    none = lambda *c: slices.select("fixture", *[F.lit(None).cast("double").alias(x) for x in c]).filter(F.lit(False))
    out = evaluation.slice_breakdown(slices, evaluation.field_metrics(_matches(spark, sf)), none("factual_coverage"), none("query_ranked_avg_relevance", "relevance_lift"))
    return out.select("slice_name", "slice_value", "fixture_count", "avg_precision", "avg_recall", "avg_f1", "total_true_positives")


_STOP = "[" + ", ".join(_quoted(w) for w in evaluation.STOPWORDS) + "]"


def _tokens_sql(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w)))"


@query(
    f"""WITH b AS (SELECT item_id, text, {_tokens_sql('text')} AS t FROM benchmark), d AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS s, list(text ORDER BY turn) FILTER (role = 'user') AS facts FROM conversations GROUP BY conv_id),
x AS (SELECT conv_id, s, {_tokens_sql('s')} AS st, coalesce(facts, []) AS facts FROM d), f AS (SELECT conv_id, unnest(facts) AS fact FROM x), g AS (SELECT conv_id, {_tokens_sql('fact')} AS ft FROM f),
c AS (SELECT g.conv_id, avg(CAST(len(ft) = 0 OR len(list_intersect(ft, st)) / len(ft) >= 0.55 AS INTEGER)) AS cov FROM g JOIN x USING (conv_id) GROUP BY g.conv_id)
SELECT CAST(x.conv_id AS VARCHAR) AS fixture, round(coalesce(cov, 1.0), 6) AS factual_coverage, round(least(({' + '.join(f"CAST(contains(lower(s), {_quoted(c)}) AS INTEGER)" for c in evaluation.ACTION_CUES)}) / 3.0, 1.0), 6) AS actionability FROM x LEFT JOIN c USING (conv_id)"""
)
def summary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    c = I.table(spark, sf, "conversations")
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda s: s["text"])
    rows = c.groupBy("conv_id").agg(F.array_join(ordered(F.struct("turn", "text")), " ").alias("summary_text"), ordered(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("key_facts"))
    out = evaluation.summary_metrics(rows.withColumn("fixture", F.col("conv_id").cast("string")))
    return out.select("fixture", F.round("factual_coverage", 6).alias("factual_coverage"), F.round("actionability", 6).alias("actionability"))


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS experiment, arg_max('v' || l_linenumber, (l_discount, -l_linenumber)) AS best_factual_coverage, arg_max('v' || l_linenumber, (l_tax, -l_linenumber)) AS best_grounding,
  arg_min('v' || l_linenumber, (l_quantity, l_linenumber)) AS fastest_variant, arg_max('v' || l_linenumber, (l_discount, l_tax, -l_quantity, -l_linenumber)) AS recommended FROM lineitem GROUP BY l_orderkey"""
)
def compare_experiments(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("experiment"), F.col("l_linenumber").alias("position"), F.concat(F.lit("v"), F.col("l_linenumber")).alias("label"), F.col("l_discount").alias("factual_coverage"), F.col("l_tax").alias("grounding_score"), F.col("l_quantity").alias("processing_time_ms"),
    )
    return evaluation.compare_experiments(rows)


@query(
    """SELECT count(*) AS fixtures_processed, round(avg(l_quantity), 2) AS avg_upload_ms, max(l_quantity) AS max_upload_ms, round(avg(l_linenumber), 2) AS avg_extraction_ms, max(l_linenumber) AS max_extraction_ms,
  round(avg(l_tax) FILTER (l_tax > 0), 2) AS avg_summarisation_ms, coalesce(max(l_tax) FILTER (l_tax > 0), 0) AS max_summarisation_ms FROM lineitem"""
)
def timing_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.timing_metrics(I.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("upload_time_ms"), F.col("l_linenumber").alias("extraction_time_ms"), F.col("l_tax").alias("summarisation_time_ms")))


# --- operations -------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT value, event_type <> 'purchase' AS success, event_type FROM events)
SELECT count(*) AS provider_calls_total, count_if(NOT success) AS provider_errors_total, round(avg(CAST(NOT success AS INTEGER)), 4) AS provider_error_rate, round(avg(value), 2) AS avg_model_latency_ms, max(value) AS max_model_latency_ms,
  round(avg(CAST(event_type <> 'click' AS INTEGER)), 4) AS output_valid_rate, round(avg(CAST(value / 100 < 0.7 AS INTEGER)), 4) AS grounding_failure_rate, count(*) AS retrieval_requests_total FROM e"""
)
def ops_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    e = I.table(spark, sf, "events")
    calls = e.select(F.col("value").alias("latency_ms"), (F.col("event_type") != "purchase").alias("success"), F.lit(False).alias("retryable"))
    tasks = e.select(
        F.col("value").alias("processing_time_ms"), F.when(F.col("event_type") == "click", "partial_recovery").otherwise("valid").alias("validation_status"), F.lit(False).alias("needs_review"), (F.col("value") / 100).alias("grounding_score"), F.lit(0).alias("unsupported_claims"), F.lit(False).alias("review_recommended"),
    )
    out = ops.ops_snapshot(calls, tasks, e.select(F.col("value").alias("latency_ms")))
    return out.select("provider_calls_total", "provider_errors_total", "provider_error_rate", "avg_model_latency_ms", "max_model_latency_ms", "output_valid_rate", "grounding_failure_rate", "retrieval_requests_total")


@query("SELECT event_id AS call_id, substring(props, 1, 200) AS message FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 12")
def recent_errors(spark: SparkSession, sf: str) -> DataFrame:
    e = I.table(spark, sf, "events").select(F.col("event_id").alias("call_id"), F.col("ts").alias("occurred_at"), (F.col("event_type") != "purchase").alias("success"), F.col("props").alias("message"))
    return ops.recent_errors(e).select("call_id", "message")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, -event_id)) AS event_id FROM events GROUP BY ALL")
def latest_by_key(spark: SparkSession, sf: str) -> DataFrame:
    e = I.table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", F.col("event_id").alias("position"))
    return ops.latest(e, ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS document_id, count(*) AS stages, bool_or(event_type = 'click') AS used_fallback, bool_or(value > 90) AS review_needed, bool_and(event_type <> 'purchase') AS success,
  coalesce(array_to_string(list(event_type ORDER BY event_id) FILTER (event_type = 'purchase'), ','), '') AS failed_stages FROM events GROUP BY user_id"""
)
def fold_trace(spark: SparkSession, sf: str) -> DataFrame:
    e = I.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("document_id"), F.col("event_id").alias("position"), F.col("event_type").alias("stage"), (F.col("event_type") != "purchase").alias("success"), (F.col("event_type") == "click").alias("used_fallback"), (F.col("value") > 90).alias("review_needed"), F.col("value").alias("duration_ms"),
    )
    return ops.fold_trace(e).drop("total_duration_ms").withColumn("failed_stages", F.array_join("failed_stages", ","))


# --- grounding -----------------------------------------------------------------------------------------

_RESPONSES = f"""{_CHUNKS}, pv AS (SELECT * FROM ch WHERE total <= {BUDGET} OR chunk_index < {BUDGET}), f0 AS (SELECT document_id, chunk_id AS c0, total FROM ch WHERE chunk_index = 0), np AS (SELECT document_id, count(*) AS provided FROM pv GROUP BY document_id)"""


def _responses(chunks: DataFrame) -> DataFrame:
    """A response for each document: one cited point, one invented citation, one plain string."""
    total = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("chunk_id", "chunk_index").alias("c0"))
    text = F.concat(
        F.lit('{"summary_text": "It may be so.", "key_points": [{"point": "The order and the balance", "chunk_ids": ["'), F.col("c0"), F.lit('"]}, {"point": "made up", "chunk_ids": ["nope"]}'),
        F.when(F.col("n") > 3, F.lit(', "plain point"')).otherwise(""), F.lit("]}"),
    )
    return total.select("document_id", text.alias("response"))


@query(
    f"""WITH {_RESPONSES} SELECT document_id, CAST(provided AS INTEGER) AS chunks_provided, 2 AS chunks_cited_by_llm, 1 AS chunks_cited_valid, 1 AS chunks_cited_invalid, CAST(CASE WHEN total > 3 THEN 3 ELSE 2 END AS BIGINT) AS key_points_total, CAST(1 AS BIGINT) AS key_points_grounded,
  CAST(CASE WHEN total > 3 THEN 0.3333 ELSE 0.5 END AS DOUBLE) AS grounding_score, true AS needs_review, 'partial_recovery' AS status FROM f0 JOIN np USING (document_id)"""
)
def grounding_audit(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _plain_chunks(spark, sf)
    selected = selection.select_chunks(chunks, BUDGET, "head")
    validated = grounding.validate_summaries(_responses(chunks))
    audit = grounding.audit_grounding(validated, grounding.ground_points(validated, selected), selected)
    out = audit.join(validated.select("document_id", "status"), "document_id")
    return out.select("document_id", "chunks_provided", "chunks_cited_by_llm", "chunks_cited_valid", "chunks_cited_invalid", "key_points_total", "key_points_grounded", "grounding_score", "needs_review", "status")


@query(
    f"""WITH {_RESPONSES}, pc AS (SELECT document_id, count(*) AS page_count FROM pages GROUP BY document_id), sp AS (SELECT document_id, count(DISTINCT p) AS seen FROM (SELECT document_id, unnest(page_numbers) AS p FROM pv) GROUP BY document_id),
cv AS (SELECT f0.document_id, total, provided, (provided / total + coalesce(seen, 0) / page_count + 1.0) / 3.0 AS mean FROM f0 JOIN np USING (document_id) JOIN pc USING (document_id) LEFT JOIN sp USING (document_id)),
j AS (SELECT document_id, mean < 0.5 AS partial, mean < 0.25 AND total > 3 AS abstained, CASE WHEN total > 3 THEN 2 ELSE 1 END AS lost, CASE WHEN total > 3 THEN 'weak' ELSE 'partial' END AS evidence FROM cv)
SELECT document_id, CAST(round(0.88 - CASE WHEN partial THEN 0.18 ELSE 0 END - lost * 0.08 - 0.12, 4) AS DOUBLE) AS overall_confidence, evidence AS evidence_sufficiency, CASE WHEN partial THEN 'partial_coverage,' ELSE '' END || 'unsupported_claims,validation_recovery' AS risk_flags,
  partial AS partial_coverage, partial OR abstained AS scope_limited, CAST(lost AS BIGINT) AS unsupported_claim_count, abstained, CASE WHEN abstained THEN {_quoted(grounding.TOO_LITTLE)} END AS safe_failure_reason,
  CASE WHEN abstained THEN {_quoted(grounding.NO_SUMMARY)} WHEN partial THEN {_quoted(grounding.PARTIAL)} || 'It may be so.' ELSE 'It may be so.' END AS summary_text, CASE WHEN abstained THEN '' ELSE 'The order and the balance' END AS key_points FROM j"""
)
def summarisation_task(spark: SparkSession, sf: str) -> DataFrame:
    """The whole summarisation composite over recorded responses."""
    from docloom.operators import tasks

    chunks = _plain_chunks(spark, sf)
    docs = I.pages(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count")).withColumn("quality", F.lit("good"))
    out = tasks.summarise(chunks, docs, tasks.recorded(_responses(chunks)), BUDGET, "head")
    both = out["uncertainty"].join(out["summary"], "document_id")
    kept = ["document_id", "overall_confidence", "evidence_sufficiency", "partial_coverage", "scope_limited", "unsupported_claim_count", "abstained", "safe_failure_reason", "summary_text"]
    return both.select(*kept, F.array_join("risk_flags", ",").alias("risk_flags"), F.array_join("key_points", "|").alias("key_points"))


@query(
    """WITH i AS (SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CASE o_orderstatus WHEN 'F' THEN 'good' WHEN 'O' THEN 'degraded' ELSE 'unusable' END AS q, CASE WHEN starts_with(o_orderpriority, '1') THEN 'minimal' WHEN starts_with(o_orderpriority, '2') THEN 'partial' ELSE 'good' END AS cv,
  o_custkey % 11 / 10.0 AS g, o_custkey % 4 AS un, o_orderkey % 2 AS co FROM orders),
a AS (SELECT *, q <> 'good' AS low, cv IN ('minimal', 'partial') AS pt, CASE WHEN g >= 0.8 AND un = 0 AND co = 0 THEN 'sufficient' WHEN g >= 0.5 THEN 'partial' WHEN g > 0 THEN 'weak' ELSE 'none' END AS s FROM i)
SELECT document_id, CAST(round(greatest(0.0, 0.88 - CASE WHEN pt THEN 0.18 ELSE 0 END - CASE WHEN low THEN 0.2 ELSE 0 END - least(0.25, un * 0.08) - CASE WHEN co > 0 THEN 0.18 ELSE 0 END), 4) AS DOUBLE) AS overall_confidence, s AS evidence_sufficiency,
  s = 'none' OR (low AND g = 0) OR (cv = 'minimal' AND g < 0.5) AS abstained FROM a"""
)
def uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    o = I.table(spark, sf, "orders")
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "good").when(F.col("o_orderstatus") == "O", "degraded").otherwise("unusable").alias("parse_quality"), F.lit(False).alias("likely_low_quality_source"),
        F.when(F.col("o_orderpriority").startswith("1"), "minimal").when(F.col("o_orderpriority").startswith("2"), "partial").otherwise("good").alias("coverage_level"), (F.col("o_custkey") % 11 / 10.0).alias("grounding_score"), (F.col("o_custkey") % 4).alias("unsupported_claims"), (F.col("o_orderkey") % 2).alias("contradictions"), F.lit("valid").alias("validation_status"), F.lit(0).alias("inferred_claims"),
    )
    return grounding.uncertainty(rows).select("document_id", "overall_confidence", "evidence_sufficiency", "abstained")
