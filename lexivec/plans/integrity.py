"""Queries of entity parsing, scans of files, completeness and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec import schemas
from lexivec.functions import integrity, text, vectors
from lexivec.operators import batching, pages, records, requests
from lexivec.plans.texts import _distinct, _strip
from lexivec.session import table
from lexivec.sources import files

SECRET = "Aliases"
#: What is put behind a document's text, by the first digit of its hash, so that scans have something to find.
PLANTED = {
    "0": " Authorization: Bearer abcdefgh1234 ", "1": " https://quick-brown-fox.trycloudflare.com/x ", "2": " ghp_0123 ",
    "3": ' {"username": "a", "key": "b"} ', "4": " https://a-b.trycloudflare.com.example ", "5": " Authorization: Bearer short ",
}
#: Endings of the members' names, by the second digit.
ENDINGS = {"0": ".py", "1": ".pyc", "2": "-api_key.txt", "3": "/__pycache__/x.bin", "4": ".ipynb", "5": "-SHA256SUMS", "6": "/SHA256SUMS"}


def _chosen(digit, table_: dict[str, str], other: str):
    out = F.lit(other)
    for key, value in table_.items():
        out = F.when(digit == key, value).otherwise(out)
    return out


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a member of an archive, some with something planted."""
    h = F.md5(F.col("text").cast("binary"))
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id",
        F.concat(F.lit("docs/"), F.col("doc_id"), _chosen(h.substr(2, 1), ENDINGS, ".txt")).alias("member"),
        F.concat("text", _chosen(h.substr(1, 1), PLANTED, "")).alias("text"),
    )


def f15_holds(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.groupBy("lang").agg(
        F.count_if(integrity.holds(F.col("text").cast("binary"), SECRET)).alias("holding"), F.count_if(integrity.holds(F.col("text").cast("binary"), "")).alias("holding_nothing")
    )


def f16_members(spark: SparkSession, d: str) -> DataFrame:
    return integrity.scan_members(_members(spark, d)).select("member", "kind", "reason")


def f17_evidence(spark: SparkSession, d: str) -> DataFrame:
    return integrity.scan_evidence(_members(spark, d)).select("member", "kind", "reason")


def f21_addresses(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).select("doc_id", text.tunnel_url(F.col("text")).alias("address"))


def prj18_allowed(spark: SparkSession, d: str) -> DataFrame:
    settings = F.create_map(F.lit("token"), F.lit("x"), F.lit("source"), F.coalesce("source", F.lit("")), F.lit("lang"), F.coalesce("lang", F.lit("")))
    kept = integrity.allowed(settings, ("lang", "source", "other"))
    return table(spark, d, "documents").select("doc_id", F.to_json(kept).alias("published"))


def f19_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every record as the JSON of an entity, parsed back."""

    def term(c):
        return F.struct(F.lit("x").alias("language"), c.alias("value"))

    def terms(c: str):
        return F.create_map(F.lit("en"), term(F.col(f"{c}_en")), F.lit("vi"), term(F.col(f"{c}_vi"))).alias(f"{c}s")

    def claim(i):
        value = F.struct(F.struct(i.alias("id")).alias("value"))
        snak = F.struct(F.when(i.endswith("7"), "novalue").otherwise("value").alias("snaktype"), value.alias("datavalue"))
        return F.struct(F.when(i.endswith("1"), "deprecated").otherwise("normal").alias("rank"), snak.alias("mainsnak"))

    aliases = F.create_map(*[x for n in ("en", "vi") for x in (F.lit(n), F.transform(F.coalesce(f"aliases_{n}", F.array().cast("array<string>")), term))])
    entity = F.struct(
        F.col("qid").alias("id"), terms("label"), terms("description"), aliases.alias("aliases"),
        F.struct(F.transform(F.coalesce("instance_of_qids", F.array().cast("array<string>")), claim).alias("P31")).alias("claims"),
    )
    rows = table(spark, d, "canonical_records").select("record_id", F.from_json(F.to_json(entity), schemas.ENTITY).alias("e"))
    got = records.from_entities(rows.select("e.*", "record_id"), "record_id")
    return got.select(
        "record_id", "qid", "label_en", "description_vi", F.array_join("aliases_vi", "|").alias("aliases_vi"),
        F.array_join("instance_of_qids", "|").alias("classes"),
    )


def b04_missing(spark: SparkSession, d: str) -> DataFrame:
    """Items of requests for which no finite vector came."""
    e = table(spark, d, "embed_results").where("request_id is not null and item_index is not null")
    done = e.where(F.col("embeddings").isNotNull() & F.coalesce(vectors.is_finite(F.col("embeddings")), F.lit(False)))
    keys = ["request_id", "item_index"]
    return batching.missing_items(e.select(*keys).distinct(), done.select(*keys).distinct(), keys)


def x06_restored(spark: SparkSession, d: str) -> DataFrame:
    """The vector ids of each request in the order of its items; repeated deliveries by id."""
    e = table(spark, d, "embed_results").where("request_id is not null and item_index is not null")
    items = F.array_sort(F.collect_list(F.struct("item_index", "vec_id")))
    return e.groupBy("request_id").agg(F.array_join(F.transform(items, lambda s: s["vec_id"].cast("string")), ",").alias("vec_ids"))


def k13_parsed(spark: SparkSession, d: str) -> DataFrame:
    """The answers of all requests, read back: items in their order, tokens, and the sum of all components."""
    fine = F.coalesce(vectors.is_finite(F.col("embeddings")), F.lit(False))
    e = table(spark, d, "embed_results").where("request_id is not null and item_index is not null and embeddings is not null").where(fine)
    answers = requests.embedding_answers(e, "request_id", "item_index", "embeddings", "token_count")
    body = F.from_json("body", "object string, data array<struct<index: int, object: string, embedding: array<double>>>, usage struct<prompt_tokens: bigint, total_tokens: bigint>")
    r = answers.select("request_id", body.alias("b"))
    total = F.aggregate(F.flatten(F.transform("b.data", lambda x: x["embedding"])), F.lit(0.0), lambda a, x: a + x)
    return r.select(
        "request_id", F.col("b.object").alias("object"), F.array_join(F.transform("b.data", lambda x: x["index"].cast("string")), ",").alias("items"),
        F.col("b.usage.total_tokens").alias("tokens"), F.round(total, 2).alias("total"),
    )


def j13_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Texts as files against a list of checksums: stale, missing and unlisted ones."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), "text", "n_chars")
    stale = F.coalesce(F.col("n_chars") != F.char_length("text"), F.lit(False))
    listed = docs.where("n_chars is not null").select("name", F.sha2(F.when(stale, "").otherwise(F.coalesce("text", F.lit(""))), 256).alias("sha256"))
    there = docs.where("text is not null").select(
        F.concat(F.lit("/data/"), "name").alias("path"), F.octet_length("text").cast("bigint").alias("length"), F.col("text").cast("binary").alias("content")
    )
    return files.checksum_mismatches(listed, there).select("name", "problem")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a page in its language, with links put behind its text."""
    lot = F.pmod("doc_id", F.lit(7)).cast("string")
    name = F.concat(F.lit("d/"), lot, F.lit("/"), F.coalesce("qid", F.lit("none")))
    links = F.concat(
        F.lit(" [a](../"), F.pmod("doc_id", F.lit(5)).cast("string"), F.lit("/"), F.coalesce("qid", F.lit("none")), F.lit(".md#part) ![i](no.png) [b](https://x/y) [c](./../../../out) [d](#here)")
    )
    switch = F.when(F.pmod("doc_id", F.lit(3)) == 0, pages.SWITCH).otherwise("")
    return table(spark, d, "documents").select(
        F.concat(name, F.when(F.coalesce("lang", F.lit("")) == "vi", ".vi.md").otherwise(".md")).alias("path"),
        F.concat(F.coalesce(F.regexp_replace("text", r"[\[\]()]", ""), F.lit("")), switch, links).alias("text"),
    )


def j11_unpaired(spark: SparkSession, d: str) -> DataFrame:
    return pages.unpaired(_pages(spark, d))


def j12_broken_links(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    return pages.broken_links(p, p.select("path"))


def a30_bullets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", pages.message_form(F.col("text")).alias("m")).select(
        "doc_id", (F.col("m.subject") == "").alias("no_subject"), F.col("m.bullets").cast("bigint").alias("bullets"), F.col("m.valid").alias("valid")
    )


QUERIES = {
    f.__name__: f
    for f in (f15_holds, f16_members, f17_evidence, f21_addresses, prj18_allowed, f19_entities, b04_missing, x06_restored, k13_parsed, j13_checksums, j11_unpaired, j12_broken_links, a30_bullets)
}


def _case(digit: str, table_: dict[str, str], other: str) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in table_.items())
    return f"case {digit} {whens} else '{other}' end"


_MEMBERS = (
    f"m as (select doc_id, 'docs/' || doc_id || {_case('substr(md5(text), 2, 1)', ENDINGS, '.txt')} as member, "
    f"text || {_case('substr(md5(text), 1, 1)', PLANTED, '')} as text from documents where text is not null)"
)
_IS_SOURCE = r"regexp_matches(lower(member), '\.(" + "|".join(integrity.SOURCE_SUFFIXES) + ")$')"


def _union(checks: list[tuple[str, str, str]], where: str = "true") -> str:
    return " union ".join(f"select member, '{kind}' as kind, '{reason}' as reason from m where {where} and {ok}" for ok, kind, reason in checks)


_EVIDENCE = [(f"contains(member, '{m}')", "secret", "name-marker") for m in integrity.EVIDENCE_MARKERS] + [
    (f"regexp_matches(text, '{p}')", "secret", reason)
    for p, reason in (
        (integrity.BEARER, "bearer content"), (integrity.TUNNEL, "tunnel content"), (integrity.ACCESS_TOKEN, "access token pattern"),
        (integrity.CREDENTIAL, "credential JSON"),
    )
]
_NAMED = [(f"contains(member, '{m}')", "secret", m) for m in integrity.NAME_MARKERS] + [
    (r"regexp_matches(member, '\.pytest_cache|__pycache__|\.pyc')", "cache", "cache member"),
    (f"not {_IS_SOURCE} and regexp_matches(text, '{integrity.BEARER}')", "secret", "Authorization: Bearer"),
    (f"not {_IS_SOURCE} and regexp_matches(text, '{integrity.TUNNEL}')", "secret", "trycloudflare.com"),
]
_PAGES = (
    "p as (select 'd/' || (doc_id % 7) || '/' || coalesce(qid, 'none') || case when coalesce(lang, '') = 'vi' then '.vi.md' else '.md' end as path, "
    "case when coalesce(lang, '') = 'vi' then '.md' else '.vi.md' end as other, doc_id % 7 as lot, doc_id % 5 as target_lot, coalesce(qid, 'none') as q, "
    f"doc_id % 3 = 0 or contains(coalesce(text, ''), '{pages.SWITCH}') as leads from documents)"
)
_FINITE = "embeddings is not null and len(list_filter(embeddings, lambda x: x is null or isnan(x) or isinf(x))) = 0"


def _picked(c: str) -> str:
    return f"case when {_strip(c)} <> '' then {c} end"


SQL = {
    "f15_holds": f"select lang, (count(*) filter (where contains(text, '{SECRET}')))::bigint as holding, 0::bigint as holding_nothing from documents where text is not null group by lang",
    "f16_members": f"with {_MEMBERS} {_union(_NAMED)}",
    "f17_evidence": f"with {_MEMBERS} " + _union(_EVIDENCE, "not regexp_matches(member, '(^|/)SHA256SUMS$')"),
    "f21_addresses": f"with {_MEMBERS} select doc_id, nullif(regexp_extract(text, '(https://[a-z0-9-]+\\.trycloudflare\\.com\\b)', 1), '') as address from m",
    "prj18_allowed": """select doc_id, '{"lang":"' || coalesce(lang, '') || '","source":"' || coalesce(source, '') || '"}' as published from documents""",
    "f19_entities": f"""
select record_id, case when regexp_full_match({_strip('qid')}, 'Q[1-9][0-9]*') then {_strip('qid')} end as qid, {_picked('label_en')} as label_en, {_picked('description_vi')} as description_vi,
  array_to_string({_distinct("list_filter(coalesce(aliases_vi, []), lambda v: v is not null and " + _strip('v') + " <> '')")}, '|') as aliases_vi,
  array_to_string({_distinct("list_filter(coalesce(instance_of_qids, []), lambda v: v is not null and regexp_full_match(v, 'Q[1-9][0-9]*') and v[-1:] not in ('1', '7'))")}, '|') as classes
from canonical_records""",
    "b04_missing": f"select distinct request_id, item_index from embed_results where request_id is not null and item_index is not null except "
    f"select request_id, item_index from embed_results where {_FINITE}",
    "x06_restored": "select request_id, string_agg(vec_id::varchar, ',' order by item_index, vec_id) as vec_ids from embed_results where request_id is not null and item_index is not null group by 1",
    "k13_parsed": f"""
select request_id, 'list' as object, string_agg(item_index::varchar, ',' order by item_index) as items, sum(token_count)::bigint as tokens,
  round(sum(list_sum(embeddings::double[])), 2) as total from embed_results where request_id is not null and item_index is not null and {_FINITE} group by 1""",
    "j13_checksums": """
with l as (select doc_id::varchar as name, sha256(case when coalesce(n_chars <> length(text), false) then '' else coalesce(text, '') end) as sha from documents where n_chars is not null),
f as (select doc_id::varchar as name, sha256(text) as found from documents where text is not null)
select name, case when found is null then 'missing' when sha is null then 'not listed' when found <> sha then 'differs' end as problem
from l full join f using (name) where found is null or sha is null or found <> sha""",
    "j11_unpaired": f"""
with {_PAGES}, o as (select path, any_value('d/' || lot || '/' || q || other) as peer, bool_or(leads) as leads from p group by path)
select path, case when peer not in (select path from o) then 'missing counterpart' else 'missing language switch' end as problem from o
where peer not in (select path from o) or not leads""",
    "j12_broken_links": f"""
with {_PAGES} select distinct path, '../' || target_lot || '/' || q || '.md' as target, 'missing' as problem from p
where 'd/' || target_lot || '/' || q || '.md' not in (select path from p) union select path, './../../../out', 'outside' from p""",
    "a30_bullets": r"""
with l as (select doc_id, regexp_split_to_array(regexp_replace(text, '\s+$', ''), E'\r\n|[\n\r]') as lines from documents where text is not null),
b as (select doc_id, trim(lines[1]) = '' as no_subject, len(list_filter(lines[2:], lambda x: starts_with(x, '- ') and length(x) > 2))::bigint as bullets from l)
select doc_id, no_subject, bullets, not no_subject and bullets >= 2 as valid from b""",
}
