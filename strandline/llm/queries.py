"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import (
    archives, bpe, jaccard, licences, mixing, negatives, quality, repeats, secrets, suffix_tree, token_files, topk, whitening,
)
from strandline.llm.common import table
from strandline.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_files")
def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.read_documents(token_files.write_files(docs, "doc_id", "text", tokenizer_file("word_bpe_49k.json"), end_id=2))


@query("op10_warc", """
    with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as payload_bytes from pages),
    d as (select *, sha256(html) as payload_digest from p),
    f as (select *, min(page_id) over (partition by payload_digest) as first from d)
    select page_id, payload_bytes, payload_digest,
           case when payload_bytes >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
           case when payload_bytes >= 100 and page_id > first then first end as refers_to
    from f
""")
def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = archives.convert(archives.write_arc(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
    return archives.read_back(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_quality_rules", r"""
    with d as (select doc_id, source, coalesce(text, '') as t from documents),
    w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
    i as (select doc_id, ws, unnest(range(1, len(ws) - 3)) as "at" from w),
    g as (select doc_id, "at", count(*) over (partition by doc_id, list_slice(ws, "at", "at" + 4)) as n from i),
    r as (select doc_id, count(distinct "at" + o.k) as n_repeat_words from g, range(5) o(k) where n > 1 group by doc_id),
    l as (select doc_id, source, t, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as no from d),
    lw as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
                  trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) as norm from l),
    u as (select doc_id, count(*) as n_dup_lines from (
        select doc_id, row_number() over (partition by doc_id, line order by no) as k from lw where n > 0) where k > 1 group by doc_id),
    h as (select source, greatest(20, count(distinct t) * 0.01) as lim from d group by source),
    c as (select source, norm from lw join h using (source) where n > 0 group by source, norm, lim having count(distinct t) > lim),
    m as (select doc_id, sum(n) as removed from lw semi join c using (source, norm) where n > 0 group by doc_id),
    s as (select w.doc_id, len(ws)::bigint as n_words,
                 (length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')))::bigint as word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
                 coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
                 coalesce(removed, 0) as removed
          from w left join u using (doc_id) left join r using (doc_id) left join m using (doc_id)),
    f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from s)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and not (removed > 0.5 * n_words or n_words - removed < 10) as kept
    from f
""")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.screen(table(spark, sf_dir, "documents"), "doc_id", "source", "text").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


WEIGHTS = {"src0": 0.10, "src1": 0.10, "src2": 0.08, "src3": 0.06}


@query("op4_mixing", """
    with d as (select doc_id, source, text, length(coalesce(text, ''))::double as mass from documents),
    m as (select source, sum(mass) as mass from d group by source),
    w as (select *, case source when 'src0' then 0.10 when 'src1' then 0.10 when 'src2' then 0.08 when 'src3' then 0.06 end::double as weight from m),
    t as (select sum(mass) as whole, sum(mass) filter (weight is null) as unnamed from w),
    r as (select source, case when mass > 0 then coalesce(weight, 0.66::double * mass / unnamed) / (0.34::double + 0.66::double) * 1.5::double * whole / mass
                              else 0 end as rate from w, t),
    k as (select d.doc_id, d.source, rate, greatest(1, ceil(rate / 32))::int as parts,
                 md5(coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))) as key
          from d join r on d.source is not distinct from r.source where rate > 0),
    u as (select *, rate / parts as pr, ('0x' || substr(md5('7:' || key || ':' || p.p::varchar), 1, 13))::bigint::double / 4503599627370496 as u
          from (select *, unnest(range(1, parts + 1)) as p from k) p),
    c as (select doc_id, source, key, rate, p, (select count(*) from (
              select j, sum(exp(-pr) * pow(pr, j) / gamma(j + 1)) over (order by j) as cum from range(0, 140) g(j)) where u >= cum) as n
          from u),
    n as (select doc_id, source, rate, sum(n) as n from c group by doc_id, source, key, rate)
    select doc_id, n.source, text, unnest(range(0, n::bigint))::int as copy, round(rate, 6) as rate from n join documents using (doc_id)
""")
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "source", "text", WEIGHTS, other=0.66, size=1.5)
    return mixed.select("doc_id", "source", "text", F.col("__copy").alias("copy"), F.round("__rate", 6).alias("rate"))


@query("op7_licences")
def licences_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op2_secrets")
def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")

    def number(no: int):
        return F.size(F.filter("__base", lambda s: s["no"] == no)).cast("long")

    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(secrets.written(F.col("__base")), 256).alias("base_sha256"),
        secrets.written(F.concat("__base", "__added")).alias("spans"),
    )


@query("op6_jaccard_join")
def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.join(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "set_id", "class_id", "class_size", "n_links")


@query("op9_repeats")
def repeats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find(table(spark, sf_dir, "documents"), "doc_id", "text")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), "n_words", spans.alias("spans"))


@query("op8_exact_topk", """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
               where vec_id is not null and len(embedding) > 0
                 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
          from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
    select query_id, rank, vec_id, score from r where rank <= 5
""")
def topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query("op3_byte_bpe")
def byte_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, "doc_id", "text", tokenizer_file("byte_bpe_multi_50k.tiktoken"), split_pattern(), digest=True)


@query("op11_hard_negatives", """
    with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                      list_transform(embedding, lambda x: floor(256 * x::double))::double[] as v from embeddings
               where vec_id is not null and label is not null and len(embedding) > 0
                 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.v, c.v)::bigint as score
          from e a join e c on a.vec_id % 50 = 0 and a.vec_id <> c.vec_id and len(a.v) = len(c.v)),
    p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
          qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
    n as (select p.*, s.vec_id as negative_id, s.score as negative_score,
                 row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank
          from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
    select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
""")
def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, F.col("vec_id") % 50 == 0)


@query("op13_whitening")
def whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    each = found.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n", F.col("deviation").cast("long").alias("deviation"),
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error",
    )


@query("op12_lm_scores")
def lm_scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True))
    found = suffix_tree.score(table(spark, sf_dir, "documents"), "doc_id", "text", ~held_out)
    return found.select(
        F.col("id").alias("doc_id"), F.coalesce(F.crc32(F.col("id").cast("string")) % 10 == 0, F.lit(True)).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_in_context",
    )
