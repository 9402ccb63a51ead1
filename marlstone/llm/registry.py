"""Queries over the given tables that apply the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import ann, bpe, chat_format, divergence, exact_topk, language_id, mixing, ngram_jaccard, quality, token_counts, toxicity, url_filters, whitening
from marlstone.llm.storage import Scratch, prepare

WORD_BPE, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = WORD_BPE) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(modulus: int):
    """The remainder of the checksum of a document's id, by which folds are dealt."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.learn_profiles(docs.where(fold(4) != 2).select("text", "lang"))
    rows = docs.select("doc_id", "text", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"))
    return language_id.identify(rows, profiles).select("doc_id", "held_out", "lang_pred", "score", "distance")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ngram_jaccard.similar_documents(docs, Scratch(spark, "jaccard"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary()
    coded = bpe.round_trip(docs, path)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against block and allow lists that derive from the pages' own hosts and paths.

    A page was fetched on a day that follows from its id.  A host, parent domain or first path
    step is listed, removed and listed again on days that follow from its letters.
    """
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7 % 366).cast("int")))
    host, path = url_filters.url_host(F.col("url")), F.regexp_extract("url", "^[^:]+://[^/?#]+/([^/?#]+)", 1)
    keys = F.array(
        F.struct(F.lit("domain").alias("kind"), host.alias("value")),
        F.struct(F.lit("domain").alias("kind"), F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("value")),
        F.struct(F.lit("path").alias("kind"), F.concat(host, F.lit("/"), path).alias("value")),
    )
    listed = pages.select(F.explode(keys).alias("key")).select("key.*").where("value <> '' and value not like '%/'").distinct()
    code = F.length("value") * 31 + F.ascii("value") * 7 + F.ascii(F.substring("value", 3, 1)) * 13 + F.ascii(F.substring("value", 5, 1)) * 5
    listed = listed.withColumn("code", code).where("code % 3 <> 0")
    verdict = F.when(F.col("code") % 5 == 0, F.lit("allow")).otherwise(F.lit("block")).alias("verdict")
    changes = [("add", 0), ("remove", 90), ("add", 200)]
    dated = [F.struct(F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("code") % 150 + later).cast("int")).alias("day")) for action, later in changes]
    entries = listed.select("kind", "value", verdict, F.explode(F.array(*dated)).alias("change")).select("kind", "value", "verdict", "change.*")
    return url_filters.filter_urls(captures, entries)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(fold(5) != 0).select("doc_id", "toxic")
    model = toxicity.train(docs, labels, Scratch(spark, "toxicity"))
    rows = docs.withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False)))
    return model.score(rows).select("doc_id", "held_out", "score", "predicted")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk.top_k(rows, F.col("vec_id") % 50 == 0, 5, Scratch(spark, "exact-topk"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, scratch=Scratch(spark, "mixing"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), scratch=Scratch(spark, "chat"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary(BYTE_RANKS)).select("doc_id", "n_tokens", "n_pretokens")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.neighbours(rows, F.col("vec_id") % 20 == 0, 20, Scratch(spark, "ann"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(rows, Scratch(spark, "whitening"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("text", "lang", "source")
    return divergence.audit(docs, Scratch(spark, "divergence"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(fold(5) != 0).select("doc_id", "quality")
    model = quality.train(docs, labels, Scratch(spark, "quality"))
    rows = docs.withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False)))
    return model.score(rows).select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_bpe": op3_bpe,
    "op4_url_filters": op4_url_filters,
    "op5_toxicity": op5_toxicity,
    "op6_exact_topk": op6_exact_topk,
    "op7_mixing": op7_mixing,
    "op8_chat_format": op8_chat_format,
    "op9_token_counts": op9_token_counts,
    "op10_ann": op10_ann,
    "op11_whitening": op11_whitening,
    "op12_divergence": op12_divergence,
    "op13_quality": op13_quality,
}

_CODE = "(length(value) * 31 + ascii(value) * 7 + ascii(substr(value, 3, 1)) * 13 + ascii(substr(value, 5, 1)) * 5)"

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": rf"""
with captures as (
  select page_id, url, date '2024-01-01' + cast(page_id * 7 % 366 as integer) as day,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)', 1)), '.') as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) as path,
    regexp_extract(url, '^[^:]+://[^/?#]+/([^/?#]+)', 1) as step
  from pages),
keys as (
  select distinct kind, value from (
    select 'domain' as kind, host as value from captures
    union all select 'domain', regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) from captures
    union all select 'path', host || '/' || step from captures)
  where value <> '' and value not like '%/'),
listed as (
  select kind, value, case when {_CODE} % 5 = 0 then 'allow' else 'block' end as verdict, cast({_CODE} % 150 as integer) as shift
  from keys where {_CODE} % 3 <> 0),
spans as (
  select kind, value, verdict, date '2024-01-01' + shift as since, date '2024-01-01' + (shift + 90) as until from listed
  union all select kind, value, verdict, date '2024-01-01' + (shift + 200), null from listed),
parts as (
  select page_id, url, day, host, string_split(host, '.') as labels, list_filter(string_split(path, '/'), lambda s: s <> '') as steps from captures),
keyed as (
  select page_id, url, day, 'domain' as kind, array_to_string(labels[len(labels) - i + 1:], '.') as value, i as weight
  from (select *, unnest(range(1, len(labels) + 1)) as i from parts where host <> '')
  union all
  select page_id, url, day, 'path', host || '/' || array_to_string(steps[1:i], '/'), 1000000 + i
  from (select *, unnest(range(1, len(steps) + 1)) as i from parts where host <> '')),
hits as (
  select k.page_id, k.weight, s.* from keyed k join spans s on k.kind = s.kind and k.value = s.value and s.since <= k.day and (s.until is null or k.day < s.until)
  qualify row_number() over (partition by k.page_id order by k.weight desc) = 1)
select c.page_id, c.url, c.day, coalesce(h.verdict = 'block', false) as blocked, h.kind as matched_kind, h.value as matched_value, h.since as matched_since
from captures c left join hits h on c.page_id = h.page_id
""",
    "op8_chat_format": r"""
with said as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as body from conversations),
people as (select distinct conv_id, speaker as perspective from said where speaker <> 'system'),
marked as (
  select s.conv_id, p.perspective, s.turn, s.speaker, s.body,
    case when s.speaker = p.perspective then '<|im_start|>assistant' || chr(10)
         when s.speaker = 'system' then '<|im_start|>system' || chr(10)
         else '<|im_start|>user name=' || regexp_replace(replace(replace(s.speaker, '<|', '< |'), '|>', '| >'), '[\x00-\x20=]+', '_', 'g') || chr(10) end as head
  from said s join people p on s.conv_id = p.conv_id),
pieces as (select *, head || replace(replace(body, '<|', '< |'), '|>', '| >') || '<|im_end|>' || chr(10) as piece from marked),
placed as (
  select *, row_number() over w as seq, cast(sum(length(piece)) over w as bigint) as "end" from pieces
  window w as (partition by conv_id, perspective order by turn, speaker, body rows unbounded preceding))
select conv_id, perspective, turn, seq, speaker, piece, speaker = perspective as learned, "end" - length(piece) as start, "end",
  case when speaker = perspective then "end" - length(piece) + length(head) else "end" end as learned_from
from placed
""",
    "op12_divergence": r"""
with docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (
  select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from docs),
kept as (select lang, term, count(*) as n from words group by lang, term having count(distinct r) >= 30),
langs as (select l.lang, count(k.term) as v, coalesce(sum(k.n), 0) as whole from (select distinct lang from docs) l left join kept k on l.lang = k.lang group by l.lang),
counts as (select w.lang, w.source, w.term, count(*) as n from words w join kept k on w.lang = k.lang and w.term = k.term group by all),
groups as (
  select g.lang, g.source, l.v, (select coalesce(sum(n), 0) from counts c where c.lang = g.lang and c.source = g.source) as whole
  from (select distinct lang, source from docs) g join langs l on g.lang = l.lang),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.whole + 5 * g.v)::hugeint as p
  from groups g join kept k on g.lang = k.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, coalesce((
    select sum(abs(x.p - y.p)) from shares x join shares y on x.lang = y.lang and x.term = y.term where x.lang = a.lang and x.source = a.source and y.source = b.source), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source),
terms as (
  select s.lang, s.source, s.term as item, (s.p - q)::bigint as value
  from shares s join (select k.lang, k.term, 1 + (1000000000::hugeint * (k.n + 5)) // (l.whole + 5 * l.v)::hugeint as q from kept k join langs l on k.lang = l.lang) t on s.lang = t.lang and s.term = t.term
  where s.n > 0 and s.p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
""",
}
