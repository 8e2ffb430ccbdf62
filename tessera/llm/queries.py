"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, embeddings, exact, html, langid, lines, media, mixing, neardup, phrases, sql, substrings, urls
from .common import Workspace, spread, table


def tokenizer_path(spark: SparkSession) -> str:
    """The vocabulary file, present on every executor: the setting tessera.tokenizer.path, else the installed public one."""
    import public_tokenizers

    return spark.conf.get("spark.tessera.tokenizer.path", None) or public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(spread(table(spark, sf_dir, "pages")))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: The rules of the query as its contract lists them. URL_RULES, of which the SQL is made, still has block for net/de/.
CONTRACT_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Domains that are blocked where no rule fits.
BLOCKED_DOMAINS = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = spark.createDataFrame([(x,) for x in BLOCKED_DOMAINS], "key string")
    judged = urls.judge(spark, table(spark, sf_dir, "pages").select("page_id", "url"), CONTRACT_RULES, blocked)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _op2_sql() -> str:
    fits = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rules = sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    rule = " ".join(f"when {fits.format(h=h, p=p)} then '{h}{p}'" for _, h, p in rules)
    action = " ".join(f"when rule = '{h}{p}' then '{a}'" for a, h, p in rules)
    domain = " or ".join(f"host = '{d}' or ends_with(host, '.{d}')" for d in BLOCKED_DOMAINS)
    part = "coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {}), '')"
    host = f"translate({part.format(1)}, '{urls.UPPER}', '{urls.LOWER}')"
    return f"""
        with parts as (select page_id, {host} as host, {part.format(2)} as path from pages),
        ruled as (select *, case {rule} end as rule from parts)
        select page_id, host, path, rule, case {action} when {domain} then 'block' else 'allow' end as verdict from ruled"""


def op3_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.chunked_media(spread(table(spark, sf_dir, "documents"))).select("doc_id", *media.FIELDS)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bpe.round_trip(docs, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~out))
    return langid.predict(spread(docs.select("doc_id", "text")), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text_hash")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = """
    with lined as (select doc_id, text, string_split(text, chr(10)) as l from documents),
    wins as (select doc_id, s - 1 as start, l[s] || chr(10) || l[s + 1] || chr(10) || l[s + 2] as w
        from (select doc_id, l, unnest(range(1, len(l) - 1)) as s from lined where len(l) >= 3)),
    late as (select doc_id, start from (select *, row_number() over (partition by w order by doc_id, start) as r from wins) where r > 1),
    gone as (select distinct doc_id, unnest(range(start, start + 3)) as i from late),
    kept as (select d.doc_id, coalesce(string_agg(d.line, chr(10) order by d.i), '') as text, count(*) as n
        from (select doc_id, unnest(l) as line, unnest(range(0, len(l))) as i from lined) d left join gone g on g.doc_id = d.doc_id and g.i = d.i
        where g.i is null group by d.doc_id)
    select t.doc_id, coalesce(len(t.l), 0)::bigint as n_lines, (coalesce(len(t.l), 0) - coalesce(k.n, 0))::bigint as n_removed,
        case when t.text is null then null else length(coalesce(k.text, '')) end::bigint as kept_chars,
        case when t.text is null then null else sha256(coalesce(k.text, '')) end as kept_sha256
    from lined t left join kept k on k.doc_id = t.doc_id"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # words are counted once: the plan reads sizes several times
    docs = Workspace(spark, "mixing").save(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.size_of(F.col("text")).alias("size")), "sizes")
    planned = mixing.plan(docs, measured=True)
    first = F.round(F.element_at("positions", 1), 6)
    return planned.select("doc_id", "size", "source_size", "target", "taken", F.when(F.col("copies") > 0, first).alias("first_position")).orderBy("first_position", "doc_id")


OP8_SQL = """
    with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
    sources as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as turn from sized group by source),
    weighed as (select *, case turn % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w, 2.0::double * source_size as most from sources),
    levels as (select *, most / w as ratio,
        (1.5::double * sum(source_size) over () - coalesce(sum(most) over (order by most / w, turn rows between unbounded preceding and 1 preceding), 0))
            / sum(w) over (order by most / w, turn rows between current row and unbounded following) as level from weighed),
    level as (select level as v from levels where level <= ratio order by ratio, turn limit 1),
    shares as (select source, turn, source_size, least(most, w * (select v from level)) as target from levels),
    ordered as (select d.doc_id, d.size, s.source_size, s.target, s.turn, case when s.source_size > 0 then floor(s.target / s.source_size) else 0 end as whole,
        coalesce(sum(d.size) over (partition by s.turn order by md5(d.doc_id::varchar), d.doc_id rows between unbounded preceding and 1 preceding), 0)::double as before
        from sized d join shares s on d.source is not distinct from s.source),
    copied as (select *, case when size > 0 then (whole + case when before + size / 2.0 <= target - whole * source_size then 1 else 0 end)::bigint else 0 end as copies from ordered),
    placed as (select *, case when copies > 0 then least(1.0::double, (before + size / 2.0) / target) end as u from copied)
    select doc_id, size, source_size, target, (copies * size)::bigint as taken,
        case when turn % 3 = 0 then round(u, 6)
            when turn % 3 = 1 then round(case when u < 0.625 then 2 * u / (1.5 + sqrt(greatest(2.25 - 2 * u, 0))) else 0.5 + 2 * (u - 0.625) / (1 + sqrt(greatest(1 - 2 * (u - 0.625), 0))) end, 6)
            else round(case when u < 0.375 then 2 * u / (0.5 + sqrt(greatest(0.25 + 2 * u, 0))) else 0.5 + 2 * (u - 0.375) / (1 + sqrt(greatest(1 + 2 * (u - 0.375), 0))) end, 6) end as first_position
    from placed"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spread(table(spark, sf_dir, "documents").select("lang", "source", "text")))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spread(table(spark, sf_dir, "documents").select("lang", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_url_filter": op2_url_filter,
    "op3_media_chunks": op3_media_chunks,
    "op4_bpe": op4_bpe,
    "op5_language_id": op5_language_id,
    "op6_near_dedup": op6_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_near_vectors": op10_near_vectors,
    "op11_source_divergence": op11_source_divergence,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_phrase_mining": op13_phrase_mining,
}

ORACLES: dict[str, str] = {
    "op2_url_filter": _op2_sql(),
    "op3_media_chunks": sql.OP3_SQL,
    "op6_near_dedup": sql.OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_mixing": OP8_SQL,
    "op9_substring_dedup": sql.OP9_SQL,
    "op10_near_vectors": sql.OP10_SQL,
    "op11_source_divergence": sql.OP11_SQL,
    "op12_exact_dedup": sql.OP12_SQL,
    "op13_phrase_mining": sql.OP13_SQL,
}
