"""Queries of text normalisation, canonical records and dataset quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions import integrity, text
from lexivec.operators import quality, records, requests
from lexivec.session import table

RAW = ("qid", *records.SCALARS, *records.ARRAYS, "instance_of_qids")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_records").select("record_id", *RAW)


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    return records.canonicalize(_raw(spark, d), ("record_id",))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def f01_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    n = text.normalized(F.col("text"))
    return _docs(spark, d).select(
        "doc_id", F.md5(n).alias("md5"), F.char_length(n).cast("bigint").alias("chars"), text.text_error(F.col("text")).alias("error")
    )


def f02_mojibake(spark: SparkSession, d: str) -> DataFrame:
    n = text.normalized(F.col("description_vi"))
    return _raw(spark, d).where(text.is_mojibake(n)).select("record_id")


def f03_aliases(spark: SparkSession, d: str) -> DataFrame:
    a = text.normalized_each(F.col("aliases_vi"))
    return _raw(spark, d).select("record_id", F.array_join(a, "|").alias("aliases"), F.size(a).cast("bigint").alias("n"))


def f04_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum(text.estimated_tokens(F.coalesce("text", F.lit("")))).alias("tokens")
    )


def f05_suspected_english(spark: SparkSession, d: str) -> DataFrame:
    r = quality.suspected_english(table(spark, d, "canonical_records"))
    return r.select("field", "n", "non_null", F.round("rate", 9).alias("rate"))


def prj07_documents(spark: SparkSession, d: str) -> DataFrame:
    c = records.accepted(_canonical(spark, d))
    return c.select("record_id", "document_en", "document_vi")


def prj08_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    c = records.accepted(_canonical(spark, d))
    joined = [F.array_join(x, "|").alias(x) for x in (*records.ARRAYS, "instance_of_qids", "quality_flags")]
    return c.select("record_id", "qid", *records.SCALARS, *joined, "source", "source_license")


def prj08_rejected(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).where("reject_reason is not null").select("record_id", "qid", F.col("reject_reason").alias("reason"))


def prj11_index_text(spark: SparkSession, d: str) -> DataFrame:
    c = records.accepted(_canonical(spark, d))
    return c.select("record_id", text.index_text(F.col("document_en"), F.col("document_vi")).alias("index_text"))


def prj22_unicode_gate(spark: SparkSession, d: str) -> DataFrame:
    return records.gate_violations(table(spark, d, "canonical_records"), records.SCALARS)


def prj22_whole_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate over all texts, aliases included."""
    return records.gate_violations(table(spark, d, "canonical_records"), records.SCALARS, records.ARRAYS)


def a01_reject_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.reject_counts(_canonical(spark, d))


def a02_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.flag_counts(records.accepted(_canonical(spark, d)))


def a02_flags_as_delivered(spark: SparkSession, d: str) -> DataFrame:
    return records.flag_counts(table(spark, d, "canonical_records"))


def a03_null_rates(spark: SparkSession, d: str) -> DataFrame:
    rates = records.null_rates(records.accepted(_canonical(spark, d)), records.SCALARS)
    return rates.select(*[F.round(c, 9).alias(c) for c in records.SCALARS])


def a04_falsy_rates(spark: SparkSession, d: str) -> DataFrame:
    r = quality.falsy_rates(table(spark, d, "canonical_records"))
    return r.select(*[F.round(c, 9).alias(c) for c in quality.TEXT_COLUMNS])


def a05_identical_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = quality.identical_pairs(table(spark, d, "canonical_records"))
    return r.select("field", "n", F.round("rate", 9).alias("rate"))


def a07_category_coverage(spark: SparkSession, d: str) -> DataFrame:
    r = quality.category_coverage(records.accepted(_canonical(spark, d)))
    return r.select("category", "n", F.round("rate", 9).alias("rate"))


def u03_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(F.split(F.lower(text.squeeze(F.col("text"))), " "))
    return _docs(spark, d).where("text is not null").select(
        "doc_id", F.md5(F.array_join(words, " ")).alias("md5"), F.size(words).cast("bigint").alias("words")
    )


def u05_first_per_qid(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "canonical_records").select("qid", "record_id", "label_en").where("qid is not null")
    return records.first_per_key(rows, "qid", F.col("record_id"))


def x01_canonical_order(spark: SparkSession, d: str) -> DataFrame:
    c = records.accepted(_canonical(spark, d)).select("record_id", "qid", "label_en", "label_vi")
    return c.orderBy(*records.canonical_order(), "record_id").limit(100)


def x02_numeric_order(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qid_provenance").select("qid").distinct()
    return q.orderBy(records.qid_number("qid"), "qid").limit(100)


def x01_canonical_positions(spark: SparkSession, d: str) -> DataFrame:
    """The whole table in canonical order; x01_canonical_order is its first 100 rows."""
    c = records.accepted(_canonical(spark, d)).select("record_id", "qid", "label_en", "label_vi")
    return records.numbered(c, *records.canonical_order(), "record_id")


def x02_numeric_positions(spark: SparkSession, d: str) -> DataFrame:
    """All distinct ids in numeric order; x02_numeric_order is its first 100 rows."""
    q = table(spark, d, "qid_provenance").select("qid").distinct()
    return records.numbered(q, records.qid_number("qid"), "qid")


def w05_first_accepted(spark: SparkSession, d: str) -> DataFrame:
    return records.first_accepted(_canonical(spark, d), 1000, "record_id").select("record_id", "qid")


def w05_scanned(spark: SparkSession, d: str) -> DataFrame:
    return records.scanned_until(_canonical(spark, d), 1000, "record_id")


def prj12_item_status(spark: SparkSession, d: str) -> DataFrame:
    s = F.coalesce(requests.item_status(F.col("text")), F.lit(200))
    return _docs(spark, d).groupBy(s.cast("bigint").alias("status")).agg(F.count("*").alias("n"))


def prj14_instructed(spark: SparkSession, d: str) -> DataFrame:
    t = text.instructed(F.col("text"), F.coalesce(F.col("source") == "qa_log", F.lit(False)), "Query: ")
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(t).alias("md5"))


def prj24_body_limit(spark: SparkSession, d: str) -> DataFrame:
    s = F.coalesce(requests.body_status(F.col("text"), 8192), F.lit(200))
    return _docs(spark, d).groupBy(s.cast("bigint").alias("status")).agg(F.count("*").alias("n"))


def f12_text_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"))


def f13_json_hash(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").where("lang is not null and source is not null")
    return r.select("doc_id", integrity.json_hash("doc_id", "lang", "source").alias("sha256"))


def f16_scan(spark: SparkSession, d: str) -> DataFrame:
    files = _docs(spark, d).select(
        F.concat_ws("/", "source", F.concat("doc_id", F.lit(".txt"))).alias("member"), "text"
    )
    return integrity.scan_evidence(files).groupBy("kind", "reason").agg(F.count("*").alias("n"))


def prj23_tunnel(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).agg(F.count(text.tunnel_url(F.col("text"))).alias("found"), F.count("*").alias("texts"))


QUERIES = {
    f.__name__: f
    for f in (
        f01_normalize_text, f02_mojibake, f03_aliases, f04_tokens, f05_suspected_english, prj07_documents, prj08_canonicalize,
        prj08_rejected, prj11_index_text, prj22_unicode_gate, prj22_whole_gate, a01_reject_counts, a02_flag_counts, a02_flags_as_delivered,
        a03_null_rates, a04_falsy_rates, a05_identical_pairs, a07_category_coverage, u03_ordered_distinct, u05_first_per_qid,
        x01_canonical_order, x01_canonical_positions, x02_numeric_order, x02_numeric_positions, w05_first_accepted, w05_scanned,
        prj12_item_status, prj14_instructed, prj24_body_limit, f12_text_hash, f13_json_hash, f16_scan, prj23_tunnel,
    )
}

# --- the same in SQL -------------------------------------------------------------------------------------------

_WS = r"[\t\n\x{B}\x{C}\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CC = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}]"
_MOJIBAKE = (
    r"(?:Ã[\x{80}-\x{BF}§©®±¼½¾]|Â[\x{80}-\x{BF}]|â(?:€|™|œ|ž|€“|€”|€™)|ðŸ|ï¿½)"
)


def _sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _norm(x: str) -> str:
    return _sq(f"nfc_normalize({x})")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _err(x: str) -> str:
    ctl = f"regexp_extract({x}, '{_CC}')"
    return (
        f"case when contains({x}, chr(65533)) then '{text.REPLACEMENT_ERROR}' when regexp_matches({x}, '{_CC}') "
        f"then '{text.CONTROL_ERROR}' || format('{{:04X}}', unicode({ctl})) end"
    )


def _distinct(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def _norm_each(x: str) -> str:
    kept = f"list_filter(list_transform(coalesce({x}, []), lambda v: {_norm('v')}), lambda v: v is not null and v <> '')"
    return _distinct(kept)


def _first_err(x: str) -> str:
    each = f"list_transform(coalesce({x}, []), lambda v: case when v is null then '{text.NOT_TEXT_ERROR}' else {_err('v')} end)"
    return f"list_filter({each}, lambda v: v is not null)[1]"


def _document(lang: str) -> str:
    return (
        f"case when label_{lang} <> '' then concat_ws(' ', label_{lang} || '.', "
        f"case when description_{lang} <> '' then description_{lang} || '.' end, "
        f"case when len(aliases_{lang}) > 0 then 'Aliases: ' || array_to_string(aliases_{lang}, '; ') || '.' end) end"
    )


_FIELD_ERRORS = ", ".join([_err(c) for c in records.SCALARS] + [_first_err(c) for c in records.ARRAYS])
_FLAGGED = " or ".join(
    [f"coalesce(regexp_matches({c}, '{_MOJIBAKE}'), false)" for c in records.SCALARS]
    + [f"len(list_filter({c}, lambda v: regexp_matches(v, '{_MOJIBAKE}'))) > 0" for c in records.ARRAYS]
)
_CLASSES = _distinct(
    f"list_filter(list_transform(coalesce(instance_of_qids, []), lambda v: {_strip('v')}), lambda v: v is not null and v <> '')"
)

CANONICAL = f"""
cleaned as (
  select record_id, {_strip('qid')} as q, {", ".join(f"nullif({_norm(c)}, '') as {c}" for c in records.SCALARS)},
    {", ".join(f"{_norm_each(c)} as {c}" for c in records.ARRAYS)}, {_CLASSES} as instance_of_qids,
    coalesce({_FIELD_ERRORS}) as err
  from canonical_records
), judged as (
  select *, case when err is not null then 'unicode_quality:' || err
    when label_en is null and label_vi is null then 'missing_usable_label' end as reason,
    case when {_FLAGGED} then '{text.MOJIBAKE_FLAG}' else '' end as quality_flags
  from cleaned
), good as (
  select *, coalesce(q, '') as qid, {_document('en')} as document_en, {_document('vi')} as document_vi from judged where reason is null
)
"""


def _rate_rows(fields: tuple[str, ...], n, non_null=None) -> str:
    rows = []
    for f in fields:
        base = non_null(f) if non_null else "count(*)"
        extra = f", {base}::bigint as non_null" if non_null else ""
        rows.append(f"select '{f}' as field, {n(f)}::bigint as n{extra}, round(coalesce({n(f)} / nullif({base}, 0), 0)::double, 9) as rate from canonical_records")
    return " union all ".join(rows)


_MARKERS = "[" + ", ".join(f"'{m}'" for m in text.ENGLISH_MARKERS) + "]"


def _looks_english(x: str) -> str:
    words = f"list_transform(regexp_extract_all({x}, '[A-Za-z]+'), lambda w: lower(w))"
    return (
        f"coalesce({x} <> '' and not regexp_matches({x}, '[{text.VIETNAMESE_LETTERS}]') and len({words}) >= 4 "
        f"and len(list_filter({words}, lambda w: list_contains({_MARKERS}, w))) >= 2, false)"
    )


_QNUM = "case when regexp_full_match(qid, 'Q[1-9][0-9]*') then coalesce(try_cast(substr(qid, 2) as decimal(38,0)), 9223372036854775807) else 9223372036854775807 end"
_EVIDENCE = [("access token pattern", integrity.ACCESS_TOKEN), ("bearer content", integrity.BEARER),
             ("credential JSON", integrity.CREDENTIAL), ("tunnel content", integrity.TUNNEL)]

SQL = {
    "f01_normalize_text": f"select doc_id, md5({_norm('text')}) as md5, length({_norm('text')})::bigint as chars, {_err('text')} as error from documents",
    "f02_mojibake": f"select record_id from canonical_records where regexp_matches({_norm('description_vi')}, '{_MOJIBAKE}')",
    "f03_aliases": f"select record_id, coalesce(array_to_string({_norm_each('aliases_vi')}, '|'), '') as aliases, len({_norm_each('aliases_vi')})::bigint as n from canonical_records",
    "f04_tokens": "select lang, count(*)::bigint as docs, sum(greatest(1, ceil(length(coalesce(text, '')) / 4.0)))::bigint as tokens from documents group by lang",
    "f05_suspected_english": _rate_rows(
        ("label_vi", "description_vi", "document_vi"),
        lambda f: f"count(*) filter (where {_looks_english(f)})",
        lambda f: f"count(*) filter (where {f} <> '')",
    ),
    "prj07_documents": f"with {CANONICAL} select record_id, document_en, document_vi from good",
    "prj08_canonicalize": f"with {CANONICAL} select record_id, qid, {', '.join(records.SCALARS)}, "
    + ", ".join(f"coalesce(array_to_string({c}, '|'), '') as {c}" for c in (*records.ARRAYS, "instance_of_qids"))
    + f", quality_flags, '{records.SOURCE}' as source, '{records.SOURCE_LICENSE}' as source_license from good",
    "prj08_rejected": f"with {CANONICAL} select record_id, q as qid, reason from judged where reason is not null",
    "prj11_index_text": f"with {CANONICAL} select record_id, nullif(concat_ws(chr(10), case when document_en <> '' then 'English: ' || document_en end, "
    "case when document_vi <> '' then 'Vietnamese: ' || document_vi end), '') as index_text from good",
    "prj22_unicode_gate": " union all ".join(
        f"select '{c}' as field, count(*) filter (where {_norm(c)} <> {c})::bigint as n from canonical_records" for c in records.SCALARS
    ),
    "prj22_whole_gate": " union all ".join(
        [f"select '{c}' as field, count(*) filter (where {_norm(c)} <> {c})::bigint as n from canonical_records" for c in records.SCALARS]
        + [f"select '{c}' as field, coalesce(sum(len(list_filter({c}, lambda v: {_norm('v')} <> v))), 0)::bigint as n from canonical_records" for c in records.ARRAYS]
    ),
    "a01_reject_counts": f"with {CANONICAL} select reason, count(*)::bigint as n from judged where reason is not null group by reason",
    "a02_flag_counts": f"with {CANONICAL} select quality_flags as flag, count(*)::bigint as n from good where quality_flags <> '' group by 1",
    "a02_flags_as_delivered": "select flag, count(*)::bigint as n from (select unnest(quality_flags) as flag from canonical_records) group by flag",
    "a03_null_rates": f"with {CANONICAL} select "
    + ", ".join(f"round(avg(({c} is null)::int)::double, 9) as {c}" for c in records.SCALARS)
    + " from good",
    "a04_falsy_rates": "select "
    + ", ".join(f"round(coalesce(avg((coalesce({c}, '') = '')::int), 0)::double, 9) as {c}" for c in quality.TEXT_COLUMNS)
    + " from canonical_records",
    "a05_identical_pairs": _rate_rows(
        quality.PAIRS, lambda f: f"count(*) filter (where {f}_en <> '' and {f}_en = {f}_vi)"
    ),
    "a07_category_coverage": f"with {CANONICAL} select category, count(*)::bigint as n, round(count(*) / (select count(*) from good), 9) as rate "
    "from (select unnest(instance_of_qids) as category from good) group by category",
    "u03_ordered_distinct": f"with w as (select doc_id, string_split(lower({_sq('text')}), ' ') as w from documents where text is not null), "
    "u as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w), f as (select doc_id, x, min(i) as i from u group by doc_id, x) "
    "select doc_id, md5(string_agg(x, ' ' order by i)) as md5, count(*)::bigint as words from f group by doc_id",
    "u05_first_per_qid": "select qid, record_id, label_en from canonical_records where qid is not null qualify row_number() over (partition by qid order by record_id) = 1",
    "x01_canonical_order": f"with {CANONICAL} select record_id, qid, label_en, label_vi from good order by qid, coalesce(label_en, ''), coalesce(label_vi, ''), record_id limit 100",
    "x02_numeric_order": f"select distinct qid, {_QNUM} as o from qid_provenance order by o, qid limit 100",
    "x01_canonical_positions": f"with {CANONICAL} select record_id, qid, label_en, label_vi, "
    "row_number() over (order by qid, coalesce(label_en, ''), coalesce(label_vi, ''), record_id) as position from good",
    "x02_numeric_positions": f"select qid, row_number() over (order by {_QNUM}, qid nulls first) as position from (select distinct qid from qid_provenance)",
    "w05_first_accepted": f"with {CANONICAL} select record_id, qid from good order by record_id limit 1000",
    "w05_scanned": f"with {CANONICAL}, cut as (select record_id from good order by record_id limit 1000), l as (select count(*) as n, max(record_id) as last from cut) "
    "select count(*)::bigint as scanned from canonical_records, l where n < 1000 or record_id <= last",
    "prj12_item_status": f"select (case when length(text) > 32768 then 413 when text is null or {_err('text')} is not null or {_sq('text')} = '' then 422 else 200 end)::bigint as status, "
    "count(*)::bigint as n from documents group by 1",
    "prj14_instructed": "select doc_id, md5(case when source = 'qa_log' then 'Query: ' || text else text end) as md5 from documents where text is not null",
    "prj24_body_limit": "select (case when strlen(text) > 8192 then 413 else 200 end)::bigint as status, count(*)::bigint as n from documents group by 1",
    "f12_text_hash": "select doc_id, sha256(text) as sha256 from documents where text is not null",
    "f13_json_hash": """select doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') as sha256
        from documents where lang is not null and source is not null""",
    "f16_scan": "select kind, reason, count(*)::bigint as n from (" + " union all ".join(
        f"select distinct doc_id, 'secret' as kind, '{reason}' as reason from documents where regexp_matches(text, '{pattern}')"
        for reason, pattern in _EVIDENCE
    ) + ") group by kind, reason",
    "prj23_tunnel": r"select count(nullif(regexp_extract(text, 'https://[a-z0-9-]+\.trycloudflare\.com\b'), ''))::bigint as found, count(*)::bigint as texts from documents",
}
SQL["x02_numeric_order"] = f"select qid from ({SQL['x02_numeric_order']})"
