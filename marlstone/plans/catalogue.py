"""Queries that apply the operators to the given tables, each with the SQL that checks it.

``QUERIES`` maps a name to a function of (spark, directory); ``ORACLE_SQL`` maps names to
DuckDB SQL over the same tables.  The definitions of queries that need a stand-in for the
engine's own tables (links, chunks, ledger) are at the top of each section.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import chunk, hashing
from marlstone.functions import text as tx
from marlstone.functions import vector as vec
from marlstone.operators import analytics, ferment, fusion, graph, ledger, name_index, retrieval, rollups, sparse_index, vector_index
from marlstone.plans import graph_store, search
from marlstone.session import Store, bounded_batches
from marlstone.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ----- dense retrieval: every twentieth embedding, by its id, asks all of them

_DENSE = """
dense_all as (
  select q.vec_id as query_id, c.vec_id as id,
    round(1 - list_dot_product(q.embedding::double[], c.embedding::double[])
      / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(c.embedding::double[], c.embedding::double[]))), 6) + 0.0 as distance
  from (select * from embeddings where vec_id % 20 = 0) q, embeddings c),
dense_ranked as (select *, row_number() over (partition by query_id order by distance, id) as rank from dense_all)"""


def _dense_queries(spark, d):
    return _read(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _dense_corpus(spark, d):
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(f"with {_DENSE} select query_id, rank, id, distance from dense_ranked where rank <= 30")
def dense_topk(spark, d):
    return retrieval.dense_topk(_dense_queries(spark, d), _dense_corpus(spark, d), 30)


@query()
def vector_index_topk(spark, d):
    """The same by a stored index of cells; its recall against ``dense_topk`` is tested."""
    path = tables.passing_folder(spark, "vector-index")
    vector_index.build(_dense_corpus(spark, d), path)
    return vector_index.search(_dense_queries(spark, d), path, 30)


@query(f"with {_DENSE} select query_id, rank, id, round(1 - distance / 2, 7) as similarity from dense_ranked where rank <= 5")
def dense_topk_similarity(spark, d):
    top = retrieval.dense_topk(_dense_queries(spark, d), _dense_corpus(spark, d), 5)
    return top.select("query_id", "rank", "id", F.round(vec.similarity(F.col("distance")), 7).alias("similarity"))


@query(f"with {_DENSE} select count(*) as n, min(distance) as min_distance, round(max(distance), 6) as max_distance, round(avg(distance), 5) as mean_distance, case when max(distance) <= 2 then 'cosine' when max(distance) <= 10 then 'ip' else 'l2' end as metric from dense_ranked where rank <= 30")
def dense_distance_summary(spark, d):
    return retrieval.metric_of(dense_topk(spark, d))


@query(f"""
with {_DENSE}
select query_id, id, round((
  select avg(greatest(0, best)) from (
    select i, max(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))) as best from (
      select i, q.embedding[i * 16 + 1 : i * 16 + 16]::double[] as a, c.embedding[j * 16 + 1 : j * 16 + 16]::double[] as b
      from range(4) t(i), range(4) u(j)) group by i)), 6) as score
from dense_ranked join embeddings q on q.vec_id = query_id join embeddings c on c.vec_id = id where rank <= 30
""")
def maxsim(spark, d):
    """Multi-vector scores of every query's dense candidates."""
    e = _read(spark, d, "embeddings").select("vec_id", vec.token_vectors(F.col("embedding"), 4).alias("v"))
    asked, held = e.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), e.withColumnRenamed("vec_id", "id")
    return dense_topk(spark, d).join(asked, "query_id").join(held, "id").select("query_id", "id", vec.max_sim(F.col("q"), F.col("v")).alias("score"))


# the embedder of text queries: how often each letter occurs
_LETTERS = "list_transform(range(26), lambda i: (length(lower({c})) - length(replace(lower({c}), chr((97 + i)::int), '')))::double)"


def _letters(text):
    counts = lambda low: F.transform(F.sequence(F.lit(97), F.lit(122)), lambda i: (F.length(low) - F.length(F.replace(low, F.char(i)))).cast("double"))
    return F.element_at(F.transform(F.array(F.lower(text)), counts), 1)


@query(f"""
with q as (select item_id as query_id, {_LETTERS.format(c="text")} as a from benchmark where trim(text) <> ''), c as (select doc_id as id, {_LETTERS.format(c="text")} as b from documents where text is not null),
d as (select query_id, id, case when list_dot_product(a, a) > 0 and list_dot_product(b, b) > 0 then round(1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) + 0.0 else 1.0 end as distance from q, c)
select query_id, row_number() over (partition by query_id order by distance, id) as rank, id, distance from d qualify rank <= 10""")
def text_query(spark, d):
    """The benchmark's texts ask the documents through an embedder."""
    corpus = _read(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), _letters(F.col("text")).alias("vector"))
    return retrieval.text_topk(_read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), corpus, _letters, 10)


@query()
def text_query_hashed(spark, d):
    """The same by the hashing embedder, whose frequencies are those of all documents; near copies come first."""
    docs = _read(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    encode = hashing.embedder(docs, hashing.learn(docs))
    corpus = docs.select("id", encode(F.col("text")).alias("vector"))
    return retrieval.text_topk(_read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), corpus, encode, 10)


# ----- text functions

_TOKENS = r"list_transform(list_filter(regexp_extract_all(coalesce({c}, ''), '[\x{{4e00}}-\x{{9fa5}}]+|[A-Za-z0-9._-]+'), lambda t: length(t) > 1), lambda t: lower(t))"


def _tokens(c: str) -> str:
    return _TOKENS.format(c=c)


@query(f"select doc_id, len({_tokens('text')}) as n_tokens, len(list_distinct({_tokens('text')})) as n_distinct from documents")
def token_stats(spark, d):
    tokens = _read(spark, d, "documents").select("doc_id", tx.tokenize(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"with t as (select doc_id, unnest({_tokens('text')}) as token from documents) select token, count(*) as n, count(distinct doc_id) as docs from t group by token")
def token_frequencies(spark, d):
    t = _read(spark, d, "documents").select("doc_id", F.explode(tx.tokenize(F.col("text"))).alias("token"))
    per_doc = t.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


_POSTINGS = """
{name}_tokens as (select {key} as id, unnest({tokens}) as token from {table}),
{name}_counts as (select id, token, count(*) as n from {name}_tokens group by id, token),
{name} as materialized (select id, token, round(n / sum(n) over (partition by id), 6) as weight from {name}_counts)"""
_DOC_POSTINGS = _POSTINGS.format(name="postings", key="doc_id", tokens=_tokens("text"), table="documents")
_ASK_POSTINGS = _POSTINGS.format(name="asked", key="item_id", tokens=_tokens("text"), table="benchmark")


@query(f"with {_DOC_POSTINGS} select * from postings")
def postings(spark, d):
    return retrieval.postings(_read(spark, d, "documents"), "doc_id", "text")


@query(f"with {_DOC_POSTINGS} select token, count(*) as docs, round(sum(weight::decimal(12,6))::double, 2) as weight from postings group by token")
def sparse_features(spark, d):
    p = retrieval.postings(_read(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.round(F.sum(F.col("weight").cast("decimal(12,6)")).cast("double"), 2).alias("weight"))


_CLEAN = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_COMPLEXITY = rf"""
base as (select @key as id, {_CLEAN} as clean, {_tokens(_CLEAN)} as tokens from @table),
freq as (select id, token, count(*) as n from (select id, unnest(tokens) as token from base) group by id, token),
ent as (select id, -sum(n / total * ln(n / total + 1e-9)) as raw from freq join (select id as i, len(tokens) as total from base) on i = id group by id),
complexity as (
  select b.id, clean, len(tokens) as n_tokens,
    round(case when len(tokens) > 1 then least(1.0, raw / ln(greatest(2, len(tokens)))) else 0 end, 4) as entropy,
    round(least(1.0, len(regexp_extract_all(clean, '[A-Z0-9._\-#()《》]')) / greatest(1, length(clean)) * 5), 4) as specificity,
    round(least(1.0, len(tokens) / 12.0), 4) as length_factor
  from base b left join ent e on b.id = e.id)"""


def _complexity(key: str, table: str) -> str:
    return _COMPLEXITY.replace("@key", key).replace("@table", table)


@query(f"with {_complexity('item_id', 'benchmark')} select id as item_id, entropy, specificity, length_factor from complexity")
def query_complexity(spark, d):
    rows = _read(spark, d, "benchmark").select("item_id", tx.query_complexity(F.col("text")).alias("c"))
    return rows.select("item_id", "c.*")


_WEIGHTS = """
weights as (select id, case
    when clean = '' then [0.45, 0.35, 0.20]
    when regexp_full_match(clean, '[A-Za-z0-9._\\-+#]+') or n_tokens <= 2 then [0.20, 0.55, 0.25]
    when specificity > 0.4 and length_factor < 0.4 then [0.30, 0.45, 0.25]
    when length_factor > 0.6 then [0.55, 0.20, 0.25] else [0.40, 0.35, 0.25] end as w from complexity)"""


@query(f"with {_complexity('item_id', 'benchmark')}, {_WEIGHTS} select id as item_id, w[1]::double as dense, w[2]::double as sparse, w[3]::double as colbert from weights")
def adaptive_weights(spark, d):
    return _read(spark, d, "benchmark").select("item_id", tx.adaptive_weights(F.col("text")).alias("w")).select("item_id", "w.*")


@query(f"with {_complexity('doc_id', 'documents')} select id as doc_id, entropy from complexity")
def doc_entropy(spark, d):
    docs = _read(spark, d, "documents")
    rows = docs.select("doc_id", F.explode(tx.tokenize(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    totals = docs.select("doc_id", F.size(tx.tokenize(F.col("text"))).alias("total"))
    p = F.col("n") / F.col("total")
    sums = rows.join(totals, "doc_id").groupBy("doc_id").agg((-F.sum(p * F.log(p + 1e-9)) / F.log(F.greatest(F.lit(2), F.max("total")))).alias("raw"), F.max("total").alias("n_tokens"))
    out = docs.select("doc_id").join(sums, "doc_id", "left")
    return out.select("doc_id", F.round(F.when(F.col("n_tokens") > 1, F.least(F.lit(1.0), F.col("raw"))).otherwise(F.lit(0.0)), 4).alias("entropy"))


@query(rf"select doc_id, case when length({_CLEAN}) > 70 then left({_CLEAN}, 70) || '…' else {_CLEAN} end as preview from documents")
def preview(spark, d):
    return _read(spark, d, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query("select doc_id, left(text, 200) as short, left(text, 300) as medium, left(text, 500) as long from documents")
def truncate(spark, d):
    return _read(spark, d, "documents").select("doc_id", *[F.substring("text", 1, n).alias(c) for c, n in (("short", 200), ("medium", 300), ("long", 500))])


@query(r"""
with rows as (
  select doc_id, text, list_concat(regexp_extract_all(q, '[\x{4e00}-\x{9fa5}]{2,}'), list_transform(regexp_extract_all(q, '[a-zA-Z]+'), lambda x: lower(x))) as words
  from (select doc_id, text, substr(text, length(text) // 2 + 1, 25) as q from documents)),
found as (select *, list_min(list_filter(list_transform(words, lambda w: instr(lower(text), w)), lambda p: p > 0)) as hit from rows)
select doc_id, case when hit is null then replace(left(text, 200), chr(10), ' ')
  else trim(regexp_replace(substr(text, greatest(1, hit - 100), hit + 200 - greatest(1, hit - 100)), '\s+', ' ', 'g')) end as snippet
from found
""")
def snippet(spark, d):
    docs = _read(spark, d, "documents").withColumn("q", F.expr("substring(text, cast(length(text) div 2 + 1 as int), 25)"))
    return docs.select("doc_id", tx.snippet(F.col("text"), F.col("q")).alias("snippet"))


# Markdown around a whole document, the same on both sides
_DECORATED = r"'# T' || doc_id || chr(10) || chr(10) || '**B** [[p' || (doc_id % 7) || '|alias]] [[q#h]] ![i](u.png) [l](x.md) <b>x</b> `c`' || chr(10) || '- ' || text || chr(10) || '## *E* [[end]]'"
_DECORATED_SPARK = "concat('# T', doc_id, '\n\n**B** [[p', doc_id % 7, '|alias]] [[q#h]] ![i](u.png) [l](x.md) <b>x</b> `c`\n- ', text, '\n## *E* [[end]]')"
_CONVERTED = r"regexp_replace(regexp_replace(regexp_replace({c}, '\[\[([^\]|]*)\|([^\]|]*)(?:\|[^\]]*)?\]\]', '\2', 'g'), '\[\[([^\]#]*)#([^\]#]*)(?:#[^\]]*)?\]\]', '\1 > \2', 'g'), '\[\[([^\]]+)\]\]', '\1', 'g')"


def _cleaned(c: str) -> str:
    out = _CONVERTED.format(c=c)
    for pattern, by in ((r"!\[([^\]]*)\]\([^)]+\)", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"<[^>]+>", ""), (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"`([^`]+)`", r"\1"), (r"(?m)^[-*+]\s+", "• "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return out


@query(f"select doc_id, {_CONVERTED.format(c='md')} as converted from (select doc_id, {_DECORATED} as md from documents)")
def convert_wikilinks(spark, d):
    md = _read(spark, d, "documents").select("doc_id", F.expr(_DECORATED_SPARK).alias("md"))
    return md.select("doc_id", tx.convert_wikilinks(F.col("md")).alias("converted"))


@query(f"select doc_id, {_cleaned('md')} as cleaned from (select doc_id, {_DECORATED} as md from documents)")
def clean_markdown(spark, d):
    md = _read(spark, d, "documents").select("doc_id", F.expr(_DECORATED_SPARK).alias("md"))
    return md.select("doc_id", tx.clean_markdown(F.col("md")).alias("cleaned"))


@query(r"select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as body from pages")
def strip_html(spark, d):
    return _read(spark, d, "pages").select("page_id", tx.strip_html(F.col("html")).alias("body"))


# ----- sparse retrieval: the benchmark passages ask all documents

_RECALL = f"""
{_DOC_POSTINGS},
ask_tokens as (select distinct item_id as query_id, unnest({_tokens('text')}) as token from benchmark),
ask as (select *, count(*) over (partition by query_id) as n_tokens from ask_tokens),
recall as (select query_id, id, round(sum(round(weight * 1000000)::bigint) / max(n_tokens)) / 1000000 as score from ask join postings using (token) group by query_id, id having round(sum(round(weight * 1000000)::bigint) / max(n_tokens)) / 1000000 > 0),
plain as (select query_id, id, round(sum(weight), 6) as score from ask join postings using (token) group by query_id, id having round(sum(weight), 6) > 0)"""


def _asks(spark, d):
    return retrieval.distinct_tokens(_read(spark, d, "benchmark"), "item_id", "text")


@query(f"with {_RECALL} select query_id, row_number() over (partition by query_id order by score desc, id) as rank, id, score from recall qualify rank <= 10")
def sparse_recall(spark, d):
    return retrieval.sparse_recall(_asks(spark, d), _read(spark, d, "documents"), "doc_id", "text", 10)


@query(f"with {_RECALL} select query_id, row_number() over (partition by query_id order by score desc, id) as rank, id, score from recall qualify rank <= 10")
def sparse_index_recall(spark, d):
    """The same by a stored index that skips blocks of documents."""
    path = tables.passing_folder(spark, "sparse-index")
    sparse_index.build(_read(spark, d, "documents"), path, "doc_id", "text")
    return sparse_index.recall(_asks(spark, d), path, 10)


@query(f"with {_RECALL}, placed as (select *, row_number() over (partition by query_id order by score desc, id) as place from recall) select query_id, place - 5 as rank, id, score from placed where place between 6 and 15")
def sparse_recall_excluding(spark, d):
    """The next ten, without the five that were recalled before."""
    docs = _read(spark, d, "documents")
    before = retrieval.sparse_recall(_asks(spark, d), docs, "doc_id", "text", 5)
    return retrieval.sparse_recall(_asks(spark, d), docs, "doc_id", "text", 10, exclude=before)


@query(f"with {_RECALL} select query_id, row_number() over (partition by query_id order by score desc, id) as rank, id, score, round(1 - score, 6) as distance from plain qualify rank <= 5")
def sparse_only_topk(spark, d):
    top = retrieval.sparse_recall(_asks(spark, d), _read(spark, d, "documents"), "doc_id", "text", 5, normalize=False)
    return top.withColumn("distance", F.round(1 - F.col("score"), 6))


@query(f"""with {_RECALL}, {_ASK_POSTINGS},
pairs as (select query_id, id from recall qualify row_number() over (partition by query_id order by score desc, id) <= 10),
whole as (select id as query_id, sum(weight) as whole from asked group by id),
common as (select p.query_id, p.id, sum(least(a.weight, d.weight)) as common from pairs p join asked a on a.id = p.query_id join postings d on d.id = p.id and d.token = a.token group by p.query_id, p.id)
select p.query_id, p.id, round(least(1.0, coalesce(common / whole, 0)), 6) as score from pairs p left join common using (query_id, id) left join whole using (query_id)""")
def sparse_min_overlap(spark, d):
    pairs = sparse_recall(spark, d).select("query_id", "id")
    return retrieval.overlap_scores(pairs, _read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), _read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


# ----- hybrid retrieval: every twentieth of the rows that have an embedding and a document asks all of them

_HYBRID = f"""
{_DOC_POSTINGS},
corpus as materialized (select vec_id as id, embedding::double[] as vector, text from embeddings join documents on vec_id = doc_id),
queries as (select id as query_id, vector, text from corpus where id % 20 = 0),
dense_all as materialized (
  select q.query_id, c.id, round(1 - list_dot_product(q.vector, c.vector) / (sqrt(list_dot_product(q.vector, q.vector)) * sqrt(list_dot_product(c.vector, c.vector))), 6) + 0.0 as distance
  from queries q, corpus c),
dense as materialized (select *, row_number() over (partition by query_id order by distance, id) as rank from dense_all qualify rank <= 30),
docs as materialized (select p.* from postings p join corpus c on p.id = c.id),
ask_tokens as (select distinct query_id, unnest({_tokens('text')}) as token from queries),
ask as materialized (select *, count(*) over (partition by query_id) as n_tokens from ask_tokens),
recall as materialized (select query_id, id, round(sum(round(weight * 1000000)::bigint) / max(n_tokens)) / 1000000 as score from ask join docs using (token) group by query_id, id having round(sum(round(weight * 1000000)::bigint) / max(n_tokens)) / 1000000 > 0),
sparse as materialized (select r.*, row_number() over (partition by query_id order by score desc, id) as rank from recall r anti join dense using (query_id, id) qualify rank <= 10),
pool as materialized (
  select query_id, id, rank as pool_pos, distance, rank as dense_rank from dense
  union all select s.query_id, id, l.last + rank, -1.0, null from sparse s join (select query_id, max(rank) as last from dense group by query_id) l on s.query_id = l.query_id),
whole as materialized (select id as query_id, sum(weight) as whole from docs group by id),
common as materialized (select p.query_id, p.id, sum(least(a.weight, b.weight)) as common from pool p join docs a on a.id = p.query_id join docs b on b.id = p.id and b.token = a.token group by p.query_id, p.id),
sims as materialized (
  select p.query_id, p.id, round((select avg(greatest(0, best)) from (
    select i, max(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))) as best from (
      select i, q.vector[i * 16 + 1 : i * 16 + 16] as a, c.vector[j * 16 + 1 : j * 16 + 16] as b from range(4) t(i), range(4) u(j)) group by i)), 6) as colbert_score
  from pool p join queries q on q.query_id = p.query_id join corpus c on c.id = p.id),
scored as materialized (
  select pool.*, round(least(1.0, coalesce(common / whole, 0)), 6) as sparse_score, colbert_score
  from pool left join common using (query_id, id) left join whole using (query_id) join sims using (query_id, id)),
reciprocal as materialized (
  select *, row_number() over (partition by query_id order by sparse_score desc, pool_pos) as sparse_rank,
    case when dense_rank is not null then 1 / (60 + dense_rank) else 0.5 / 90 end + 1 / (60 + sparse_rank) as rrf from scored),
{_complexity('query_id', 'queries')}, {_WEIGHTS},
spread as (select *,
    min(rrf) over w as r0, max(rrf) over w as r1, min(sparse_score) over w as s0, max(sparse_score) over w as s1, min(colbert_score) over w as c0, max(colbert_score) over w as c1
  from reciprocal window w as (partition by query_id)),
fused as materialized (
  select p.query_id, p.id, pool_pos, distance, sparse_score, colbert_score, round(rrf, 8) as rrf, round(
    w[1]::double * (case when r1 > r0 then (rrf - r0) / (r1 - r0) else (rrf > 0)::int end)
    + w[2]::double * (case when s1 > s0 then (sparse_score - s0) / (s1 - s0) else (sparse_score > 0)::int end)
    + w[3]::double * (case when c1 > c0 then (colbert_score - c0) / (c1 - c0) else (colbert_score > 0)::int end), 6) as score
  from spread p join weights on weights.id = p.query_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, pool_pos) as rank from fused)"""


def _hybrid(spark, d):
    corpus = _read(spark, d, "embeddings").join(_read(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "text")
    corpus = tables.settle(corpus.repartition(2 * spark.sparkContext.defaultParallelism, "id"))  # read by every part of a search, in parts for all cores
    return corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector", "text"), corpus


@query(f"with {_HYBRID} select query_id, id, sparse_score, colbert_score, rrf, score from fused")
def hybrid_fuse(spark, d):
    return search.hybrid_pool(*_hybrid(spark, d), 5).select("query_id", "id", "sparse_score", "colbert_score", "rrf", "score")


@query(f"with {_HYBRID} select query_id, rank, id, score from ranked where rank <= 5")
def hybrid_topk(spark, d):
    return fusion.ranked(search.hybrid_pool(*_hybrid(spark, d), 5), 5).select("query_id", "rank", "id", "score")


@query(f"with {_HYBRID} select query_id, id, score, case when distance >= 0 then round(1 - distance / 2, 6) end as similarity, score >= 0.3 and coalesce(distance >= 0 and round(1 - distance / 2, 6) >= 0.55, false) as confidence_ok from ranked where rank = 1")
def confidence_gate(spark, d):
    return fusion.confidence_gate(fusion.ranked(search.hybrid_pool(*_hybrid(spark, d), 5), 1))


@query(f"""with {_HYBRID}, a as (select query_id, list(id) as a, min_by(id, rank) as fa from dense where rank <= 5 group by query_id), b as (select query_id, list(id) as b, min_by(id, rank) as fb from ranked where rank <= 5 group by query_id)
select query_id, len(list_intersect(a, b)) as overlap, fa <> fb as top1_changed from a join b using (query_id)""")
def compare_dense_hybrid(spark, d):
    queries, corpus = _hybrid(spark, d)
    dense = retrieval.dense_topk(queries.select("query_id", "vector"), corpus.select("id", "vector"), 5)
    return fusion.compare_rankings(dense, fusion.ranked(search.hybrid_pool(queries, corpus, 5), 5), 5)


_MMR = """
cands as (select query_id, list(struct_pack(id := id, score := score, distance := distance) order by score desc, pool_pos) as l from fused group by query_id),
steps as (
  select query_id, l, case when len(l) <= 5 then range(1, len(l) + 1) else [1::bigint] end as c from cands
  union all
  select query_id, l, list_append(c, -list_reverse_sort(list_transform(list_filter(range(1, len(l) + 1), lambda i: not list_contains(c, i)),
    lambda i: struct_pack(v := 0.7::double * l[i].score - 0.3::double * greatest(0, list_max(list_transform(c, lambda j: 1 - abs(l[i].distance - l[j].distance) / 2))), i := -i)))[1].i)
  from steps where len(c) < least(5, len(l))),
diverse as (
  select query_id, rank, l[c[rank]].id as id, l[c[rank]].score as score, l[c[rank]].distance as distance
  from (select query_id, l, c, unnest(range(1, len(c) + 1))::int as rank from steps where len(c) = least(5, len(l))))"""


@query(f"""with {_HYBRID}, a as (select query_id, list(id) as a, min_by(id, rank) as fa from dense where rank <= 5 group by query_id), b as (select query_id, list(id) as b, min_by(id, rank) as fb from ranked where rank <= 5 group by query_id)
select count(*) as queries, count(*) filter (fa <> fb) as top1_changed, round(avg(len(list_intersect(a, b))), 1) as mean_overlap from a join b using (query_id)""")
def comparison_summary(spark, d):
    return fusion.comparison_summary(compare_dense_hybrid(spark, d))


@query(f"with recursive {_HYBRID}, {_MMR} select query_id, rank, id, score, distance from diverse")
def mmr_rerank(spark, d):
    return fusion.diversify(search.hybrid_pool(*_hybrid(spark, d), 5), 5)


@query(rf"""with recursive {_HYBRID}, {_MMR},
gate as (select query_id, score >= 0.3 and distance >= 0 and round(1 - distance / 2, 6) >= 0.55 as confidence_ok from diverse where rank = 1),
worded as (
  select v.*, c.text, list_concat(regexp_extract_all(q.text, '[\x{{4e00}}-\x{{9fa5}}]{{2,}}'), list_transform(regexp_extract_all(q.text, '[a-zA-Z]+'), lambda x: lower(x))) as words
  from diverse v join corpus c using (id) join queries q using (query_id)),
found as (select *, list_min(list_filter(list_transform(words, lambda w: instr(lower(text), w)), lambda p: p > 0)) as hit from worded)
select query_id, rank, id, score, case when distance >= 0 then 1 - distance / 2 end as similarity, confidence_ok,
  case when hit is null then replace(left(text, 200), chr(10), ' ')
    else trim(regexp_replace(substr(text, greatest(1, hit - 100), hit + 200 - greatest(1, hit - 100)), '\s+', ' ', 'g')) end as snippet
from found join gate using (query_id)""")
def hybrid_search(spark, d):
    return search.search(*_hybrid(spark, d), 5)


@query(f"with {_DENSE} select query_id, id, round(1 / (60 + rank), 8) as rrf from dense_ranked where rank <= 30")
def rrf_single(spark, d):
    return dense_topk(spark, d).select("query_id", "id", F.round(fusion.reciprocal_rank(F.col("rank")), 8).alias("rrf"))


@query(f"with {_DENSE}, top as (select * from dense_ranked where rank <= 30), w as (select *, min(distance) over (partition by query_id) as lo, max(distance) over (partition by query_id) as hi from top) select query_id, id, round(case when hi > lo then (distance - lo) / (hi - lo) else (distance > 0)::int end, 6) as calibrated from w")
def calibrate_minmax(spark, d):
    return dense_topk(spark, d).select("query_id", "id", F.round(fusion.calibrated(F.col("distance")), 6).alias("calibrated"))


# ----- chunks

@query("""
with n as (select doc_id, text, case when length(text) <= 450 then 1 else greatest(1, ceil((length(text) - 100) / 350.0)) end::int as n from documents where length(text) >= 50),
pieces as (select doc_id, i as chunk_index, case when n = 1 then text else regexp_replace(substr(text, i * 350 + 1, 450), '^\\s+|\\s+$', '', 'g') end as chunk from n, lateral (select unnest(range(n)) as i))
select doc_id, chunk_index::int as chunk_index, chunk from pieces where chunk <> ''
""")
def chunk_fixed(spark, d):
    return chunk.explode_chunks(_read(spark, d, "documents"), chunk.fixed(F.col("text")), ["doc_id"])


@query("""
with t as (select doc_id, text, lang = 'en' as image from (select doc_id, lang, substr(text, 1, 60 + length(text) // 2) as text from documents)),
n as (select doc_id, text, case when length(text) <= 450 or (image and length(text) < 450) then 1 else greatest(1, ceil((length(text) - 100) / 350.0)) end::int as n from t where length(text) >= 50),
pieces as (select doc_id, i as chunk_index, case when n = 1 then text else regexp_replace(substr(text, i * 350 + 1, 450), '^\\s+|\\s+$', '', 'g') end as chunk from n, lateral (select unnest(range(n)) as i))
select doc_id, chunk_index::int as chunk_index, chunk from pieces where chunk <> ''
""")
def chunk_extracted(spark, d):
    """More than half of every text as if an extractor had found it, in images and other files."""
    rows = _read(spark, d, "documents").select("doc_id", F.expr("substring(text, 1, cast(60 + length(text) div 2 as int))").alias("text"), F.when(F.col("lang") == "en", "png").otherwise("pdf").alias("extension"))
    return chunk.explode_chunks(rows, chunk.extracted(F.col("text"), F.col("extension")), ["doc_id"])


@query("""
with n as (select doc_id, text, case when length(text) <= 450 then 0 else ceil((length(text) - 450) / 350.0) end::int as last from documents where length(text) >= 50),
pieces as (select doc_id, i as chunk_index, regexp_replace(substr(text, i * 350 + 1, 450), '^\\s+|\\s+$', '', 'g') as chunk, last from n, lateral (select unnest(range(last + 1)) as i))
select doc_id, chunk_index::int as chunk_index, chunk from pieces where chunk <> '' or last = 0
""")
def chunk_to_end(spark, d):
    return chunk.explode_chunks(_read(spark, d, "documents"), chunk.fixed_to_end(F.col("text")), ["doc_id"])


@query("""
with n as (select doc_id, text, greatest(1, ceil((length(text) - 100) / 350.0))::int as n from documents where length(text) > 0)
select doc_id, i::int as chunk_index, substr(text, i * 350 + 1, 450) as chunk from n, lateral (select unnest(range(n)) as i)
""")
def chunk_hard(spark, d):
    return chunk.explode_chunks(_read(spark, d, "documents"), chunk.hard(F.col("text")), ["doc_id"])


@query("""
with n as (select source, length(text) as len, greatest(1, ceil((length(text) - 100) / 350.0))::int as n from documents where length(text) > 0)
select source, count(*) as docs, sum(n)::bigint as chunks, max(n)::bigint as most, sum(len)::bigint as chars from n group by source
""")
def chunk_window_stats(spark, d):
    docs = _read(spark, d, "documents").where("length(text) > 0").select("source", F.length("text").alias("len"), chunk.count_windows(F.col("text")).alias("n"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("chunks"), F.max("n").cast("long").alias("most"), F.sum("len").alias("chars"))


@query()
def chunk_recursive(spark, d):
    return chunk.explode_chunks(_read(spark, d, "documents"), chunk.recursive(F.col("text")), ["doc_id"])


@query()
def chunk_headings(spark, d):
    md = _read(spark, d, "documents").select("doc_id", F.expr("concat('# T', doc_id, '\n', left(text, 300), '\n## S\n', text, '\n### D\n', right(text, 400))").alias("md"))
    parts = md.select("doc_id", F.posexplode(chunk.by_headings(F.col("md"), F.lit(450), F.lit(100))).alias("pos", "part"))
    return parts.select(F.format_string("%s#%03d", F.col("doc_id").cast("string"), F.col("pos") + 1).alias("chunk_id"), "doc_id", (F.col("pos") + 1).alias("seq"), "part.heading_path", "part.text")


# ----- hashes and what is known already

@query("select doc_id, left(md5(text), 12) as content_hash, sha256(text) as sha256 from documents")
def content_hash(spark, d):
    return _read(spark, d, "documents").select("doc_id", tx.short_hash(F.col("text"), 12).alias("content_hash"), F.sha2("text", 256).alias("sha256"))


@query("select doc_id, 'doc_' || left(md5(text), 8) || '_' || doc_id as row_id from documents where text is not null")
def row_ids(spark, d):
    return _read(spark, d, "documents").where("text is not null").select("doc_id", tx.row_id("doc", F.col("text"), F.col("doc_id")).alias("row_id"))


@query("select count(*) as files, sum(strlen(text))::bigint as bytes, max(strlen(text))::bigint as largest from documents")
def volume(spark, d):
    return analytics.volume(_read(spark, d, "documents").select(F.octet_length("text").alias("size")))


@query("select left(md5(text), 12) as content_hash, min(doc_id) as first_id, count(*) as copies from documents group by 1")
def dedup_exact(spark, d):
    return ledger.first_of_content(_read(spark, d, "documents"), "text", "doc_id")


@query("select c_custkey as source, c_name as name from customer where c_custkey not in (select o_custkey from orders where o_orderdate >= timestamp '2001-08-01' - interval 30 day)")
def anti_seen_source(spark, d):
    """Customers as sources that aren't among those of the last month's chunks."""
    files = _read(spark, d, "customer").select(F.col("c_custkey").alias("source"), F.col("c_name").alias("name"))
    return ledger.unseen(files, _orders(spark, d).where(F.col("ts") >= _now() - F.make_dt_interval(F.lit(30))), "source")


@query("with h as (select d.doc_id, left(md5(text), 12) as hash, l.doc_id is not null as known from documents d left join labels l using (doc_id)) select doc_id, hash from h where not known and hash not in (select hash from h where known)")
def anti_seen_hash(spark, d):
    """Documents without a label whose text no labelled document has."""
    docs, labels = _read(spark, d, "documents").select("doc_id", tx.short_hash(F.col("text"), 12).alias("hash")), _read(spark, d, "labels")
    return ledger.unseen(docs.join(labels, "doc_id", "left_anti"), docs.join(labels, "doc_id", "left_semi"), "hash").select("doc_id", "hash")


# ----- the ledger: labelled documents were stored, those of low quality have changed since, toxic ones are gone

_STORED = "stored as (select doc_id as rel_path, case when quality = 0 then repeat('0', 64) else sha256(text) end as sha256, (n_chars // 350 + 1) as chunk_count from documents join labels using (doc_id)), files as (select doc_id as rel_path, sha256(text) as sha256 from documents where doc_id not in (select doc_id from labels where toxic = 1))"
_DIFF = f"""with {_STORED}, diff as (
  select rel_path, case when s.sha256 is null then 'new' when f.sha256 is null then 'deleted' when s.sha256 = f.sha256 then 'unchanged' else 'changed' end as status, s.sha256 as old_sha, f.sha256 as new_sha
  from files f full join stored s using (rel_path))"""


def _stored(spark, d):
    docs = _read(spark, d, "documents").join(_read(spark, d, "labels"), "doc_id")
    return docs.select(F.col("doc_id").alias("rel_path"), F.when(F.col("quality") == 0, F.repeat(F.lit("0"), 64)).otherwise(F.sha2("text", 256)).alias("sha256"), F.expr("n_chars div 350 + 1").alias("chunk_count"))


def _files(spark, d):
    kept = _read(spark, d, "documents").join(_read(spark, d, "labels").where("toxic = 1"), "doc_id", "left_anti")
    return kept.select(F.col("doc_id").alias("rel_path"), F.sha2("text", 256).alias("sha256"))


@query(f"{_DIFF} select * from diff")
def ledger_diff(spark, d):
    return ledger.diff(_files(spark, d), _stored(spark, d))


@query(f"{_DIFF} select count(*) filter (status = 'new') as new, count(*) filter (status = 'changed') as changed, count(*) filter (status = 'unchanged') as unchanged, count(*) filter (status = 'deleted') as deleted from diff")
def ledger_diff_report(spark, d):
    return ledger.report(ledger_diff(spark, d))


@query(f"{_DIFF} select rel_path, coalesce(new_sha, old_sha) as sha256 from diff where status <> 'deleted'")
def ledger_upsert(spark, d):
    differences, stored = ledger_diff(spark, d), _stored(spark, d).select("rel_path", "sha256")
    written = differences.where("status in ('new', 'changed')").select("rel_path", F.col("new_sha").alias("sha256"))
    return ledger.remove(ledger.upsert(stored, written, "rel_path"), differences.where("status = 'deleted'"), "rel_path")


@query(f"{_DIFF} select rel_path, i::int as seq, rel_path || '#' || lpad(i::varchar, greatest(3, length(i::varchar))::int, '0') as chunk_id from diff join stored using (rel_path), lateral (select unnest(range(1, chunk_count + 1)) as i) where status = 'deleted'")
def tombstone(spark, d):
    return ledger.tombstones(ledger_diff(spark, d).where("status = 'deleted'"), _stored(spark, d))


@query("""
with routes as (select source as top_folder, 'team_' || source as collection from documents where lang = 'de' and source is not null group by source having count(*) % 2 = 0),
rules as (select doc_id, 'codes' as collection from labels where toxic = 1 group by doc_id)
select d.doc_id as rel_path, source as top_folder, coalesce(u.collection, r.collection, 'default') as collection,
  case when u.doc_id is null then 0 else 1200 end as chunk_size, case when u.doc_id is null then 0 else 200 end as overlap
from documents d left join rules u using (doc_id) left join routes r on d.source = r.top_folder""")
def route_files(spark, d):
    """Rules for the files that labels mark, routes for the folders with an even number of German files."""
    docs = _read(spark, d, "documents")
    files = docs.select(F.col("doc_id").alias("rel_path"), F.col("source").alias("top_folder"))
    routes = docs.where("lang = 'de' and source is not null").groupBy(F.col("source").alias("top_folder")).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 0")
    rules = _read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("match")).distinct()
    rules = rules.select("match", F.lit("codes").alias("collection"), F.lit(1200).alias("chunk_size"), F.lit(200).alias("overlap"))
    routed = ledger.route(files, routes.select("top_folder", F.concat(F.lit("team_"), "top_folder").alias("collection")), rules, "default")
    return routed.select("rel_path", "top_folder", "collection", F.coalesce("chunk_size", F.lit(0)).alias("chunk_size"), F.coalesce("overlap", F.lit(0)).alias("overlap"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def insert_if_absent(spark, d):
    rows = _read(spark, d, "documents").select("doc_id")
    return ledger.insert_if_absent(_read(spark, d, "labels").select("doc_id"), rows, "doc_id")[0]


# ----- the concept graph: pages as notes, hosts as sources
# A page's anchors are rewritten as Markdown, each as a wiki link and as [label](target).

_ANCHOR = r'(?s)<a [^>]*href="/?([^"]*)"[^>]*>(.*?)</a>'
_LABEL_NOT = r"<[^>]+>|[\[\]]"


def _plain(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


_LINKS = rf"""
md as (
  select page_id, split_part(split_part(url, '://', 2), '/', 1) as source, array_to_string(list_transform(list_transform(regexp_extract_all(html, '{_ANCHOR}'),
    lambda a: struct_pack(h := regexp_extract(a, '{_ANCHOR}', 1), l := regexp_replace(regexp_extract(a, '{_ANCHOR}', 2), '{_LABEL_NOT}', '', 'g'))),
    lambda a: '[[' || a.h || '|' || a.l || ']] [' || a.l || '](' || a.h || ')'), ' ') as t from pages),
wiki as (select page_id, source, unnest(a) as whole, generate_subscripts(a, 1) as pos from (select *, regexp_extract_all(t, '\[\[([^\]|#]+)(?:[|#][^\]]+)?\]\]') as a from md)),
marked as (select page_id, source, unnest(a) as whole, generate_subscripts(a, 1) as pos from (select *, regexp_extract_all(t, '\[([^\]]*)\]\(([^)]+)\)') as a from md)),
named as (
  select page_id, source, 0 as kind, pos, regexp_extract(whole, '\[\[([^\]|#]+)', 1) as target, string_split(whole[3:-3], '|')[-1] as shown from wiki where not starts_with(whole, '[[.')
  union all
  select page_id, source, 1, pos, case when label <> '' then label else target end, case when label <> '' then label else target end
  from (select *, regexp_extract(whole, '\[([^\]]*)\]\(([^)]+)\)', 1) as label, regexp_extract(whole, '\[([^\]]*)\]\(([^)]+)\)', 2) as target from marked) where not regexp_matches(target, '^(http|#|\.)')),
links as (select page_id, source, kind, pos, lower({_plain("target")}) as concept_id, {_plain("shown")} as display from named),
edges as (select concept_id, source, count(*) as n, first(display order by page_id, kind, pos) as display from links where concept_id <> '' group by concept_id, source),
graph as (select concept_id, first(display order by source) as concept_name, sum(n)::bigint as total_mentions, count(*) as n_sources, list_sort(list(source)) as backlinks from edges group by concept_id)"""


def _notes(spark, d):
    """``page_id, source, url, links`` of all pages."""
    anchors = F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(0))
    href = lambda a: F.regexp_extract(a, _ANCHOR, 1)
    label = lambda a: F.regexp_replace(F.regexp_extract(a, _ANCHOR, 2), _LABEL_NOT, "")
    link = lambda a: F.concat(F.lit("[["), href(a), F.lit("|"), label(a), F.lit("]] ["), label(a), F.lit("]("), href(a), F.lit(")"))
    md = F.array_join(F.transform(anchors, link), " ")
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return _read(spark, d, "pages").select("page_id", "url", host.alias("source"), tx.links(md).alias("links"))


def _edges(spark, d):
    return graph.mentions(_notes(spark, d), chunk="page_id")


@query(f"with {_LINKS} select page_id, concept_id, display from links")
def link_extraction(spark, d):
    return _notes(spark, d).select("page_id", F.explode("links").alias("link")).select("page_id", "link.*")


@query(f"with {_LINKS} select concept_id, source, n, display from edges")
def concept_mentions(spark, d):
    return _edges(spark, d)


@query(f"with {_LINKS} select concept_id, concept_name, total_mentions, n_sources, array_to_string(backlinks, ',') as backlinks from graph")
def concept_graph(spark, d):
    return graph.concepts(_edges(spark, d)).withColumn("backlinks", F.array_join("backlinks", ","))


@query(f"with {_LINKS} select count(*) as concepts, sum(n_sources)::bigint as edges, max(total_mentions) as max_mentions, round(avg(total_mentions), 4) as avg_mentions from graph")
def graph_stats(spark, d):
    return graph.stats(_edges(spark, d))


@query(f"with {_LINKS} select concept_id, total_mentions, case when total_mentions >= 8 then 2 when total_mentions >= 3 then 1 else 0 end as level from graph")
def concept_levels(spark, d):
    return graph.concepts(_edges(spark, d)).select("concept_id", "total_mentions", graph.level(F.col("total_mentions")).alias("level"))


@query(f"with {_LINKS}, shared as (select a.concept_id, b.concept_id as related_id, count(*) as shared from edges a join edges b on a.source = b.source and a.concept_id <> b.concept_id group by 1, 2) select concept_id, row_number() over (partition by concept_id order by shared desc, related_id) as rank, related_id, shared from shared qualify rank <= 5")
def related_concepts(spark, d):
    return graph.related(_edges(spark, d))


# every twentieth page asks for the words of the names that it mentions
_ASKED = rf"""{_LINKS},
asked as (select distinct word as query from (select unnest(string_split(lower(display), ' ')) as word from links where page_id % 20 = 0) where length(word) > 0),
hits as (
  select query, concept_id, concept_name, row_number() over (partition by query order by (concept_id <> query)::int, concept_id) as rank
  from asked join graph on contains(concept_id, query) or contains(lower(concept_name), query))"""


def _name_queries(spark, d):
    """Words of names as queries, with numbers, and an index of all concepts' names."""
    words = _notes(spark, d).where("page_id % 20 = 0").select(F.explode("links").alias("link")).select(F.explode(F.split(F.lower("link.display"), " ")).alias("text"))
    queries = tables.settle(words.where("text <> ''").distinct().withColumn("query_id", F.monotonically_increasing_id()))
    path = tables.passing_folder(spark, "name-index")
    name_index.build(graph.concepts(_edges(spark, d)).select("concept_id", "concept_name"), path)
    return queries, path


@query(f"with {_ASKED} select query, rank, concept_id, concept_name from hits where rank <= 20")
def concept_search(spark, d):
    queries, path = _name_queries(spark, d)
    found = name_index.search(queries, path, 20).join(queries, "query_id")
    return found.select(F.col("text").alias("query"), "rank", "concept_id", "concept_name")


@query(f"with {_ASKED} select query, concept_id, concept_name from hits where rank = 1")
def concept_lookup(spark, d):
    queries, path = _name_queries(spark, d)
    return name_index.lookup(queries, path).join(queries, "query_id").select(F.col("text").alias("query"), "concept_id", "concept_name")


@query(f"with {_LINKS} select concept_id, concept_name, total_mentions, n_sources from graph")
def concept_graph_incremental(spark, d):
    """The stored graph after two runs: pages without TLS first, then the whole of every source."""
    store, notes = Store(tables.passing_folder(spark, "graph")), _notes(spark, d)
    graph_store.update(spark, store, notes.where(F.startswith("url", F.lit("http://"))), None, "first", "page_id")
    grown = notes.where(F.startswith("url", F.lit("https://"))).select("source").distinct()
    graph_store.update(spark, store, notes.join(grown, "source", "left_semi"), None, "second", "page_id")
    return graph_store.concepts(spark, store)


@query(f"with {_LINKS} select concept_id, concept_name, total_mentions from graph order by total_mentions desc, concept_id limit 10")
def top_concepts(spark, d):
    return graph.concepts(_edges(spark, d)).select("concept_id", "concept_name", "total_mentions").orderBy(F.desc("total_mentions"), "concept_id").limit(10)


# The store of the last run holds what the pages without TLS mention, and each host that had a page.
_STORE = f"""{_LINKS},
held as (
  select e.concept_id, min(e.display) as concept_name, count(*) as n from links e join pages p using (page_id) where starts_with(p.url, 'http://') and e.concept_id <> '' group by e.concept_id
  union all select 'host ' || source, source, count(*) from md group by source),
store as (select concept_id, concept_name, n as mention_count, case when n >= 8 then 2 when n >= 3 then 1 else 0 end as enrichment_level,
    timestamp '2024-01-01' + to_days((n * 11 % 60)::int) as last_seen, n % 2 = 0 as needs_review from held),
pages_now as (
  select concept_id, coalesce(s.concept_name, g.concept_name) as concept_name, coalesce(total_mentions, mention_count) as mention_count,
    case when s.concept_id is null then 0 when g.concept_id is null then enrichment_level when total_mentions >= 8 then 2 when total_mentions >= 3 then 1 else 0 end as enrichment_level,
    case when g.concept_id is null then last_seen else timestamp '2024-03-01' end as last_seen,
    case when s.concept_id is null then false when g.concept_id is null then needs_review else true end as needs_review,
    case when s.concept_id is null then 'created' when g.concept_id is null then 'kept' else 'updated' end as action, s.enrichment_level as previous_level,
    case when s.concept_id is null then 'first seen, ' || total_mentions || ' mentions' when g.concept_id is not null and mention_count <> total_mentions then 'mentions: ' || mention_count || ' -> ' || total_mentions end as event
  from store s full join graph g using (concept_id))"""


def _store(spark, d):
    notes = _notes(spark, d)
    said = notes.where(F.startswith("url", F.lit("http://"))).select(F.explode("links").alias("link")).where("link.concept_id <> ''")
    said = said.groupBy("link.concept_id").agg(F.min("link.display").alias("concept_name"), F.count(F.lit(1)).alias("n"))
    hosts = notes.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("host "), "source").alias("concept_id"), F.col("source").alias("concept_name"), "n")
    n = F.col("n")
    seen = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((n * 11 % 60).cast("int"))
    return said.unionByName(hosts).select("concept_id", "concept_name", n.alias("mention_count"), graph.level(n).alias("enrichment_level"), seen.alias("last_seen"), (n % 2 == 0).alias("needs_review"))


def _reconciled(spark, d):
    return ferment.reconcile(_store(spark, d), graph.concepts(_edges(spark, d)), F.lit("2024-03-01").cast("timestamp"))


@query(f"with {_STORE} select concept_id, concept_name, mention_count, enrichment_level, last_seen, needs_review, action, event from pages_now")
def ferment_reconcile(spark, d):
    return _reconciled(spark, d).drop("previous_level")


@query(f"with {_STORE} select count(*) filter (action = 'created') as stubs_created, count(*) filter (action = 'updated' and enrichment_level > previous_level and enrichment_level >= 1) as upgrades_basic, count(*) filter (action = 'updated' and enrichment_level >= 2 and previous_level < 2) as upgrades_full, count(*) filter (event is not null) as timeline_entries, count(*) as pages from pages_now")
def ferment_report(spark, d):
    return ferment.report(_reconciled(spark, d))


@query(f"""with {_STORE}, g as ({ORACLE_SQL['graph_stats'].split(' ', 1)[1].removeprefix(_LINKS)}),
r as (select count(*) filter (action = 'created') as stubs, count(*) filter (action = 'updated' and enrichment_level > previous_level and enrichment_level >= 1) as basic, count(*) filter (action = 'updated' and enrichment_level >= 2 and previous_level < 2) as whole, count(*) as pages from pages_now),
gone as (select count(*) as removed from pages_now where enrichment_level = 0 and floor((epoch_us(timestamp '2024-03-01') - epoch_us(last_seen)) / 86400000000)::bigint > 30)
select concat_ws(' | ', '总计 ' || pages || ' 个概念页面', '图谱: ' || concepts || ' 概念, ' || edges || ' 边, 平均 ' || printf('%.1f', avg_mentions) || ' 次引用', case when stubs > 0 then '新建 ' || stubs || ' 个 stub 页面' end,
  case when basic + whole > 0 then '升级: ' || concat_ws(', ', case when basic > 0 then 'basic=' || basic end, case when whole > 0 then 'full=' || whole end) end, case when removed > 0 then '清理 ' || removed || ' 个孤立概念' end) as summary
from r, g, gone""")
def night_summary(spark, d):
    pages = _reconciled(spark, d)
    removed = ferment.stale_stubs(pages, F.lit("2024-03-01").cast("timestamp")).agg(F.count(F.lit(1)).alias("removed"))
    told = ferment.report(pages).crossJoin(graph_stats(spark, d)).crossJoin(removed)  # one row each
    return ferment.diff_summary(told.withColumn("enriched_basic", F.lit(0)).withColumn("enriched_full", F.lit(0)))


@query(f"with {_STORE} select concept_id, concept_name, mention_count, enrichment_level as current_level, case when mention_count >= 8 then 2 when mention_count >= 3 then 1 else 0 end as target_level from pages_now where needs_review")
def enrichment_queue(spark, d):
    return ferment.enrichment_queue(_reconciled(spark, d))


@query(f"with {_STORE} select concept_id, age_days from (select *, floor((epoch_us(timestamp '2024-03-01') - epoch_us(last_seen)) / 86400000000)::bigint as age_days from pages_now) where enrichment_level = 0 and age_days > 30")
def orphan_cleanup(spark, d):
    return ferment.stale_stubs(_reconciled(spark, d), F.lit("2024-03-01").cast("timestamp")).select("concept_id", "age_days")


@query(f"with {_STORE} select count(*) filter (enrichment_level = 0) as stubs, count(*) filter (enrichment_level = 1) as basic, count(*) filter (enrichment_level = 2) as full, sum(mention_count)::bigint as total_mentions, max(mention_count) as max_mentions, round(avg(mention_count), 1) as avg_mentions from pages_now")
def level_distribution(spark, d):
    return ferment.level_distribution(_reconciled(spark, d))


# Every twentieth vector asks as a concept, documents give text and source.
_EVIDENCE = """
firsts as (select vec_id as concept, vec_id as q from embeddings where vec_id % 20 = 0),
near as (
  select concept, c.vec_id as id, round(1 - list_dot_product(q.embedding::double[], c.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(c.embedding::double[], c.embedding::double[]))), 6) + 0.0 as distance
  from firsts join embeddings q on q.vec_id = q, embeddings c),
top as (select *, row_number() over (partition by concept order by distance, id) as rank from near),
evidence as (select t.*, source, text, round(greatest(0, 1 - distance / 2), 6) as similarity from top t join documents on doc_id = id)"""


def _evidence(spark, d, full: bool):
    top = retrieval.dense_topk(_dense_queries(spark, d), _dense_corpus(spark, d), 10 if full else 5).withColumnRenamed("query_id", "concept")
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return ferment.evidence(top.join(docs, "id"), full)


@query(f"with {_EVIDENCE} select concept::bigint as concept, count(*) filter (trim(left(text, 200)) <> '') as facts, count(distinct source) as sources, 0::bigint as contradictions, 0.5::double as confidence from evidence where rank <= 5 and similarity >= 0.4 group by concept")
def enrich_basic(spark, d):
    return ferment.compiled(_evidence(spark, d, False), False)


@query(f"""with {_EVIDENCE},
kept as (select *, row_number() over (partition by concept, source order by rank) = 1 as fresh, row_number() over (partition by concept order by rank) as pos from evidence where rank <= 10 and similarity >= 0.35),
marked as (select *, sum(fresh::int) over (partition by concept order by rank) - fresh::int as known from kept),
sums as (select concept, count(*) as facts, count(*) filter (fresh) as sources, count(*) filter (fresh and known >= 1 and pos >= 3) as contradictions from marked group by concept)
select concept::bigint as concept, facts, sources, contradictions, (case when contradictions > 0 then 0.55 else 0.75 end)::double as confidence from sums""")
def enrich_full(spark, d):
    return ferment.compiled(_evidence(spark, d, True), True)


@query(f"""with {_EVIDENCE},
kept as (select *, trim(left(text, 200)) as fact from evidence where rank <= 5 and similarity >= 0.4),
found as (select concept, list(fact order by rank) filter (fact <> '') as facts from kept group by concept)
select concept::bigint as concept, case when len(facts) > 0 then '关于 ' || chr(39) || 'label ' || concept || chr(39) || ' 的基础信息，基于 ' || len(facts) || ' 条相关片段' else '' end as summary, 0.5::double as confidence,
  array_to_string(facts[1:5], '~') as key_facts, '' as contradictions, '' as open_questions from found""")
def truth_basic(spark, d):
    return _truth(spark, d, False)


@query(f"""with {_EVIDENCE},
kept as (select *, trim(left(text, 300)) as fact, row_number() over (partition by concept, source order by rank) = 1 as fresh, row_number() over (partition by concept order by rank) as pos from evidence where rank <= 10 and similarity >= 0.35),
marked as (select *, sum(fresh::int) over (partition by concept order by rank) - fresh::int as known from kept),
sums as (
  select concept, list(fact order by rank) as facts, count(*) filter (fresh) as sources,
    coalesce(list('多源信息交叉验证中: ' || source || ' vs 其他来源' order by rank) filter (fresh and known >= 1 and pos >= 3), []) as odd from marked group by concept)
select concept::bigint as concept, chr(39) || 'label ' || concept || chr(39) || ' 的完整知识图谱，基于 ' || len(facts) || ' 条证据，来自 ' || sources || ' 个独立来源' as summary, (case when len(odd) > 0 then 0.55 else 0.75 end)::double as confidence,
  array_to_string(facts[1:8], '~') as key_facts, array_to_string(odd[1:3], '~') as contradictions, case when len(odd) > 0 then '多源信息存在差异，需要人工确认' else '' end as open_questions from sums""")
def truth_full(spark, d):
    return _truth(spark, d, True)


def _truth(spark, d, full: bool):
    rows = _evidence(spark, d, full).withColumn("name", F.concat(F.lit("label "), F.col("concept").cast("string")))
    told = ferment.truth(rows, full)
    return told.select("concept", "summary", "confidence", *[F.array_join(c, "~").alias(c) for c in ("key_facts", "contradictions", "open_questions")])


@query(f"""with {_STORE},
said as (select concept_id, event, 0 as pos from pages_now where event is not null),
before as (select concept_id, mention_count as entries from store where mention_count <= 3)
select concept_id, concept_name, coalesce(entries, 0)::int + 1 as seq, event, mention_count from said left join before using (concept_id) join pages_now p using (concept_id, event)""")
def concept_timeline(spark, d):
    """New entries after those that stored concepts have already, with their concept."""
    pages, store = _reconciled(spark, d), _store(spark, d)
    known = store.where("mention_count <= 3").select("concept_id", F.col("mention_count").cast("int").alias("seq"))
    events = pages.where("event is not null").select("concept_id", "event", F.lit(0).alias("pos"))
    return ferment.timeline_of(ferment.appended(known, events), pages).select("concept_id", "concept_name", "seq", "event", "mention_count")


# ----- collection analytics: orders as chunks, customers as sources

_AS_OF = "2001-08-01"
_CHUNKS = "chunks as (select o_custkey as source, o_orderstatus as type, o_orderdate as ts from orders)"


def _orders(spark, d):
    return _read(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("type"), F.col("o_orderdate").cast("timestamp").alias("ts"))


def _now():
    return F.lit(_AS_OF).cast("timestamp")


@query(f"with {_CHUNKS} select count(*) as total, count(distinct source) as sources, count(distinct type) as types, min(ts) as oldest, max(ts) as newest from chunks")
def kb_stats(spark, d):
    rows = _orders(spark, d).withColumn("source", F.col("source").cast("string"))
    return analytics.stats(rows)


@query(f"with {_CHUNKS} select type, count(*) as n from chunks group by type")
def type_breakdown(spark, d):
    return analytics.breakdown(_orders(spark, d), "type")


@query(f"with {_CHUNKS}, aged as (select *, floor((epoch_us(timestamp '{_AS_OF}') - epoch_us(ts)) / 86400000000)::bigint as age from chunks) select source, min(ts) as oldest, max(age) as age_days, count(*) as n from aged where age > 180 group by source")
def expired_sources(spark, d):
    return analytics.expired(_orders(spark, d), _now())


@query(f"with {_CHUNKS} select source, count(*) as n, min(ts) as oldest, floor((epoch_us(timestamp '{_AS_OF}') - epoch_us(min(ts))) / 86400000000)::bigint as age_days from chunks where ts < timestamp '{_AS_OF}' - interval 30 day group by source")
def expiring_soon(spark, d):
    return analytics.expiring(_orders(spark, d), _now())


@query(f"with {_CHUNKS} select source, count(*) as n, array_to_string(list_sort(list(distinct type)), ', ') as types, min(ts) as first_seen from chunks where ts >= timestamp '{_AS_OF}' - interval 7 day group by source")
def recent_additions(spark, d):
    return analytics.recent(_orders(spark, d), _now())


@query(f"with {_CHUNKS} select count(*) filter (ts >= timestamp '{_AS_OF}') as today_rows, count(distinct source) filter (ts >= timestamp '{_AS_OF}') as today_sources, count(*) filter (ts >= timestamp '{_AS_OF}' - interval 7 day) as week_rows, count(distinct source) filter (ts >= timestamp '{_AS_OF}' - interval 7 day) as week_sources from chunks")
def today_week_stats(spark, d):
    return analytics.today_and_week(_orders(spark, d), _now())


@query(f"with {_CHUNKS} select type, count(*) as n from chunks where ts >= timestamp '{_AS_OF}' group by type")
def today_by_type(spark, d):
    return analytics.today_by_type(_orders(spark, d), _now())


_GAPS = """
per as (select l_orderkey as source, min(l_linenumber) as first, max(l_linenumber) as last, count(distinct l_linenumber) as present from lineitem group by 1 having count(distinct l_linenumber) > 1),
gaps as (select *, last - first + 1 - present as n_missing from per where last - first + 1 > present)"""


def _numbers(spark, d):
    return _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("chunk_index"))


@query(f"with {_GAPS} select source, first, last, present, n_missing from gaps")
def orphan_chunks(spark, d):
    return analytics.gap_summary(_numbers(spark, d))


@query("with n as (select distinct l_orderkey as source, l_linenumber as after from lineitem), s as (select *, lead(after) over (partition by source order by after) as before from n) select source, after, before, (before - after - 1)::bigint as n_missing from s where before - after > 1")
def chunk_gaps(spark, d):
    return analytics.chunk_gaps(_numbers(spark, d))


_DEAD = """dead as (select o_orderkey from orders where cast(o_custkey as varchar) not in (select cast(c_custkey as varchar) from customer where c_acctbal >= 0) and cast(o_orderkey % 2000 as varchar) not in (select cast(c_custkey as varchar) from customer where c_acctbal >= 0))"""


def _dead(spark, d):
    rows = _read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 2000).alias("original_file"))
    files = _read(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("name"))
    return analytics.dead_links(rows, files)


@query(f"with {_DEAD} select o_orderkey from dead")
def dead_links(spark, d):
    return _dead(spark, d).select("o_orderkey")


@query(f"""with {_CHUNKS}, {_GAPS}, {_DEAD},
e as (select count(distinct source) as n from chunks where floor((epoch_us(timestamp '{_AS_OF}') - epoch_us(ts)) / 86400000000) > 180)
select e.n as expired, (select count(*) from dead) as dead, (select count(*) from gaps) as gaps, greatest(0, 100 - 5 * e.n - 3 * (select count(*) from dead) - 2 * (select count(*) from gaps)) as health from e""")
def health_score(spark, d):
    counts = analytics.expired(_orders(spark, d), _now()).agg(F.count(F.lit(1)).alias("expired"))
    counts = counts.crossJoin(_dead(spark, d).agg(F.count(F.lit(1)).alias("dead"))).crossJoin(analytics.gap_summary(_numbers(spark, d)).agg(F.count(F.lit(1)).alias("gaps")))
    return counts.withColumn("health", analytics.health_score(F.col("expired"), F.col("dead"), F.col("gaps")))


def _rolled(spark, d):
    """Orders as chunks, rolled up in one run for each kind."""
    rows, path = _orders(spark, d), tables.passing_folder(spark, "rollups")
    for run, some in (("finished", rows.where("type = 'F'")), ("other", rows.where("type <> 'F' or type is null"))):
        rollups.write(some, path, run)
    return rollups.read(spark, path), rows


@query(ORACLE_SQL["kb_stats"])
def rolled_stats(spark, d):
    return rollups.stats(_rolled(spark, d)[0])


@query(ORACLE_SQL["expired_sources"])
def rolled_expired(spark, d):
    found = rollups.expired(*_rolled(spark, d), _now())
    return found.withColumn("source", F.col("source").cast("long"))


@query(ORACLE_SQL["recent_additions"])
def rolled_recent(spark, d):
    return rollups.recent(*_rolled(spark, d), _now()).withColumn("source", F.col("source").cast("long"))


@query(ORACLE_SQL["today_week_stats"])
def rolled_today_week(spark, d):
    return rollups.today_and_week(*_rolled(spark, d), _now())


@query(f"""with h as ({ORACLE_SQL['health_score']})
select concat_ws(' | ', '知识库共 ' || (select count(*) from orders) || ' 条记录', case when expired > 0 then expired || ' 个来源已过期' end, case when dead > 0 then dead || ' 个死链接' end, case when gaps > 0 then gaps || ' 个文档存在碎片缺失' end,
  case when expired + dead + gaps = 0 then '一切正常!' end) as summary from h""")
def health_summary(spark, d):
    return analytics.health_summary(health_score(spark, d).crossJoin(_orders(spark, d).agg(F.count(F.lit(1)).alias("total"))))


@query("""with p as (select event_type as agent, value is null as failed, case when value >= 10 then 200 else 503 end as code from events where event_type is distinct from 'view')
select case when count(*) filter (failed or code <> 200) > 0 then 'warn' else 'pass' end as status, count(*) as checked, count(*) filter (not failed and code <> 200) as warned, count(*) filter (failed) as failed from p""")
def dependency_health(spark, d):
    """Events as probes of the services that they name; views aren't required."""
    code = F.when(F.col("value") >= 10, 200).otherwise(503)
    probes = _read(spark, d, "events").select((~F.col("event_type").eqNullSafe(F.lit("view"))).alias("required"), F.when(F.col("value").isNotNull(), code).alias("code"), F.lit(None).cast("string").alias("error"))
    return analytics.dependency_health(probes)


@query("select count(*) as total, count(*) filter (l.doc_id is not null and d.source <> 'src1') as complete, count(*) filter (l.doc_id is null) as missing_sparse, count(*) filter (d.source = 'src1') as missing_colbert from documents d left join labels l using (doc_id)")
def vector_completeness(spark, d):
    rows = _read(spark, d, "documents").join(_read(spark, d, "labels"), "doc_id", "left")
    return analytics.completeness(rows.select(F.col("quality").alias("sparse"), F.when(F.col("source") != "src1", F.lit(1)).alias("colbert")), "sparse", "colbert")


@query(f"""
with held as (select doc_id, max(quality) as quality from labels group by doc_id)
select d.doc_id, h.doc_id is null or quality = 0 as filled, case when h.doc_id is null then len(list_distinct({_tokens('text')})) else 1 end as n_entries,
  case when h.doc_id is null or quality = 0 then len({_tokens('text')}) else 1 end as n_tokens
from documents d left join held h using (doc_id)""")
def backfill(spark, d):
    """Rows with a label have a lexicon, those of good quality their tokens as well; the rest is filled."""
    held = _read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.lit(True).alias("known"))
    rows = _read(spark, d, "documents").select("doc_id", "text").join(held, "doc_id", "left")
    rows = rows.select("doc_id", "text", F.when(F.col("known"), F.lit('{"old":1.0}')).alias("sparse_lexicon"), F.when(F.col("quality") != 0, F.lit('[{"token":"old"}]')).alias("colbert_tokens"))
    rows = rows.withColumn("filled", F.col("sparse_lexicon").isNull() | F.col("colbert_tokens").isNull())
    full = retrieval.backfill(rows)
    entries, tokens = F.size(F.map_keys(F.from_json("sparse_lexicon", "map<string,double>"))), F.size(F.from_json("colbert_tokens", "array<struct<token:string>>"))
    return full.select("doc_id", "filled", entries.cast("long").alias("n_entries"), tokens.cast("long").alias("n_tokens"))


@query("select conv_id, row_number() over (partition by conv_id order by turn, role, text) as seq, turn, role, left(md5(text), 8) as source_hash from conversations")
def timeline_append(spark, d):
    rows = ferment.numbered(_read(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return rows.select("conv_id", "seq", "turn", "role", tx.short_hash(F.col("text"), 8).alias("source_hash"))


@query("""with probes as (select event_type, case when value >= 150 then 'fail' when value >= 100 then 'warn' else 'ok' end as status from events)
select event_type, count(*) as probes, case when max(status = 'fail') then 'critical' when max(status = 'warn') then 'warning' else 'healthy' end as health from probes group by event_type""")
def probe_rollup(spark, d):
    status = F.when(F.col("value") >= 150, "fail").when(F.col("value") >= 100, "warn").otherwise("ok")
    return analytics.roll_up(_read(spark, d, "events").select("event_type", status.alias("status")), "event_type")


@query("select time_bucket(interval 1 day, ts) as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def event_windows(spark, d):
    """An extension: tumbling windows, as the streaming job computes them."""
    from marlstone.streaming.windows import daily_counts

    return daily_counts(_read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query(f"""with {_CHUNKS}, w as (select * from chunks where ts >= timestamp '{_AS_OF}' - interval 7 day),
top as (select source, count(*) as n from w group by source order by n desc, source limit 5)
select (select count(*) from chunks) || ' rows from ' || (select count(distinct source) from chunks) || ' sources | today ' || (select count(*) from w where ts >= timestamp '{_AS_OF}') || ', week ' || (select count(*) from w)
  || ' rows from ' || (select count(distinct source) from w) || ' sources | most active: ' || (select string_agg(source || ' (' || n || ')', ', ' order by n desc, source) from top) as briefing""")
def briefing_text(spark, d):
    return analytics.briefing(_orders(spark, d), _now())


@query(f"with {_CHUNKS} select source, count(*) as n from chunks where type is distinct from 'F' group by source")
def purge_by_type(spark, d):
    return ledger.purge(_orders(spark, d), "F").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_DENSE}, top as (select * from dense_ranked where rank <= 30), m as (select case when max(distance) <= 2 then 'cosine' when max(distance) <= 10 then 'ip' else 'l2' end as metric from top) select query_id, id, metric, round(case metric when 'cosine' then 1 - distance / 2 when 'ip' then 1 - distance else 1 / (1 + distance) end, 7) as similarity from top, m")
def metric_similarity(spark, d):
    top = dense_topk(spark, d)
    metric = retrieval.metric_of(top).select("metric")
    return top.crossJoin(F.broadcast(metric)).select("query_id", "id", "metric", F.round(retrieval.similarity_by_metric(F.col("distance"), F.col("metric")), 7).alias("similarity"))


@query(f"select doc_id, 'N' || doc_id as title, coalesce(lang, 'none') as lang, 'H' || doc_id as heading, length('# H' || doc_id || chr(10) || text) as body_length from documents")
def note_front_matter(spark, d):
    """Front matter, title and body of notes made of the documents."""
    note = F.concat(F.lit("---\ntitle: \""), F.lit("N"), F.col("doc_id").cast("string"), F.lit("\"\nlang: "), F.coalesce("lang", F.lit("none")), F.lit("\n---\n# H"), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))
    rows = _read(spark, d, "documents").select("doc_id", note.alias("note")).select("doc_id", tx.front_matter(F.col("note")).alias("meta"), tx.body(F.col("note")).alias("body"))
    return rows.select("doc_id", F.col("meta")["title"].alias("title"), F.col("meta")["lang"].alias("lang"), tx.title(F.col("body"), F.lit("")).alias("heading"), F.length("body").cast("long").alias("body_length"))


@query("select page_id, case when len(links) > 0 then chr(10) || '[交叉引用: ' || array_to_string(links[1:10], ', ') || ']' else '' end as suffix from (select page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) as links from pages)")
def cross_references(spark, d):
    return _read(spark, d, "pages").select("page_id", tx.cross_references(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("suffix"))


@query("select vec_id, label, list_sum(list_transform(embedding, lambda x: x::double * x::double)) > 0 as has_length from embeddings where vec_id in (select doc_id from labels)")
def point_lookup(spark, d):
    """The vectors of the ids that another table names."""
    rows = ledger.by_ids(_read(spark, d, "embeddings"), _read(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id")
    return rows.select("vec_id", "label", (vec.norm(F.col("embedding")) > 0).alias("has_length"))
