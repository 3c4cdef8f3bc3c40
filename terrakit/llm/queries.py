"""The registered text queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakit.llm import (
    ann_forest,
    fill_in_middle,
    license_scan,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    personal_data,
    quality_classifier,
    quality_rules,
    sharding,
    url_filters,
    vector_codes,
)

Query = Callable[[SparkSession, str], DataFrame]


def default_tokenizer() -> str:
    """Path of the public word-level BPE vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_repeated_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(_documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir), default_tokenizer())


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of ``pages`` with a fetch day, against lists made of their own hosts."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.pmod(F.col("page_id") * 7919, F.lit(1500)).cast("long"))
    hosts = captures.withColumn("host", url_filters.host_of(F.col("url"))).filter("host is not null")
    entries = hosts.groupBy("host").agg(F.min("page_id").alias("p")).select(
        F.explode(F.array(*[
            F.struct(domain.alias("domain"), F.lit(name).alias("list"), day.cast("long").alias("day"), F.lit(action).alias("action"))
            for domain, name, day, action in (
                (F.col("host"), "block", F.col("p") * 31 % 900, "add"),
                (F.col("host"), "block", F.col("p") * 31 % 900 + 100 + F.col("p") % 300, "remove"),
                (F.col("host"), "allow", F.col("p") * 17 % 1500, "add"),
                (F.regexp_replace("host", r"^[^.]+\.", ""), "block", F.col("p") * 13 % 1500, "add"),
                (F.regexp_replace("host", r"^[^.]+\.", ""), "block", F.col("p") * 13 % 1500 + 40, "remove"),
            )
        ])).alias("e")
    ).select("e.*")
    judged = url_filters.judged_captures(captures, entries)
    return judged.select("page_id", "host", "day", "verdict", "matched")


def op9_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(_table(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(_documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))
    rows = vector_codes.with_label_errors(coded, books)
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data.find_personal_data(_documents(spark, sf_dir), masked=False)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in personal_data.KINDS]
    return rows.select(
        "doc_id", *counts, F.sha2(personal_data.written_spans(F.col("base")), 256).alias("base_sha256"),
        personal_data.written_spans(F.col("spans")).alias("spans"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.fill_in_middle(_documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def all_queries() -> dict[str, Query]:
    own = (
        op1_line_dedup, op2_ngram_jaccard_join, op3_sharding, op4_license_scan, op5_mixing, op6_quality_classifier,
        op7_packing, op8_url_filters, op9_ann_forest, op10_quality_rules, op11_vector_codes,
        op12_personal_data, op13_fill_in_middle, pipeline,
    )
    return {f.__name__: f for f in own}


OP1_SQL = r"""
with docs as (select doc_id, coalesce(text, '') as body from documents),
lines as (
  select doc_id, unnest(string_split(body, chr(10))) as line,
         unnest(range(len(string_split(body, chr(10))))) as pos from docs),
keyed as (
  select doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
often as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 20
  group by k having count(distinct doc_id) >= 3),
marked as (
  select l.doc_id, l.line, l.pos, o.keeper is not null and o.keeper <> l.doc_id as lost
  from keyed l left join often o on l.k = o.k)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where lost) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
from marked group by doc_id"""

OP8_SQL = r"""
with captures as (
  select page_id, nullif(lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '') as host,
         cast((page_id * 7919) % 1500 as bigint) as day from pages),
hosts as (select host, min(page_id) as p from captures where host is not null group by host),
entries as (
  select host as domain, 'block' as list, p * 31 % 900 as day, 'add' as action from hosts
  union all select host, 'block', p * 31 % 900 + 100 + p % 300, 'remove' from hosts
  union all select host, 'allow', p * 17 % 1500, 'add' from hosts
  union all select regexp_replace(host, '^[^.]+\.', ''), 'block', p * 13 % 1500, 'add' from hosts
  union all select regexp_replace(host, '^[^.]+\.', ''), 'block', p * 13 % 1500 + 40, 'remove' from hosts),
daily as (select domain, list, day, bool_or(action = 'remove') as off_now from entries group by domain, list, day),
spans as (select *, lead(day) over (partition by domain, list order by day) as until from daily),
active as (select * from spans where not off_now),
asked as (select distinct host, day from captures where host is not null),
hits as (
  select a.host, a.day, s.domain, s.list,
         row_number() over (partition by a.host, a.day order by length(s.domain) desc, (s.list = 'allow') desc) as r
  from asked a join active s on (a.host = s.domain or ends_with(a.host, '.' || s.domain))
   and a.day >= s.day and (s.until is null or a.day < s.until))
select c.page_id, c.host, c.day, coalesce(h.list, 'none') as verdict, h.domain as matched
from captures c left join hits h on h.host = c.host and h.day = c.day and h.r = 1"""


_OP11_ASSIGN = """
a{n} as materialized (
  select p.vec_id, p.label, p.j, p.part,
         min(struct_pack(d := cast(list_sum(list_transform(list_zip(p.part, b.entry),
             lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint), e := b.e)) as best
  from parts p join b{n} b on p.j = b.j group by all)"""

_OP11_UPDATE = """
s{n} as (
  select j, best.e as e, i, cast(floor(sum(part[i]) / count(*)) as bigint) as x
  from (select *, unnest(range(1, len(part) + 1)) as i from a{n}) group by all),
b{m} as materialized (
  select b.j, b.e, coalesce(n.entry, b.entry) as entry
  from b{n} b left join (select j, e, list(x order by i) as entry from s{n} group by j, e) n on b.j = n.j and b.e = n.e)"""

OP11_SQL = (
    r"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (
  select vec_id, label, j, v[j * len(v) // 16 + 1:(j + 1) * len(v) // 16] as part
  from (select *, unnest(range(16)) as j from kept)),
b0 as materialized (
  select j, row_number() over (partition by j order by vec_id) - 1 as e, part as entry from parts
  qualify row_number() over (partition by j order by vec_id) <= 64),"""
    + ",".join(
        [_OP11_ASSIGN.format(n=0), _OP11_UPDATE.format(n=0, m=1), _OP11_ASSIGN.format(n=1),
         _OP11_UPDATE.format(n=1, m=2), _OP11_ASSIGN.format(n=2)]
    )
    + r""",
coded as (
  select vec_id, label, string_agg(printf('%02x', best.e), '' order by j) as code, cast(sum(best.d) as bigint) as error
  from a2 group by vec_id, label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(array_to_string(entry, ','), ',' order by j, e)) from b2) as codebooks_sha256
from coded"""
)

OP13_SQL = r"""
with docs as (
  select doc_id, coalesce(text, '') as body, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as d from documents),
drawn as (
  select doc_id, body, regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens,
         cast('0x' || d[1:8] as bigint) as h1, cast('0x' || d[9:16] as bigint) as h2,
         cast('0x' || d[17:24] as bigint) as h3, cast('0x' || d[25:32] as bigint) as h4 from docs),
cuts as (
  select *, len(tokens) as n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as lo,
         greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as hi,
         case when body = '' or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>') or h3 % 100 >= 50
              then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from drawn),
parts as (
  select doc_id, n, form, body, case when lo = 0 then '' else array_to_string(tokens[1:lo], '') end as p,
         case when hi = lo then '' else array_to_string(tokens[lo + 1:hi], '') end as m,
         case when hi = n then '' else array_to_string(tokens[hi + 1:n], '') end as s from cuts)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
       sha256(case form when 'plain' then body when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(body) as restored_sha256
from parts"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1_SQL, "op8_url_filters": OP8_SQL, "op11_vector_codes": OP11_SQL,
        "op13_fill_in_middle": OP13_SQL,
    }
