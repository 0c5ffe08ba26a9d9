"""Registered queries of the ten operators, with production settings over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm import bpe, decontaminate, html, knn, langid, simhash, suffix_dedup, token_files, toxicity, warc
from twinsieve.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public vocabulary file lies; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op7_language_id(spark, sf_dir):
    """Languages of all documents."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op1_toxicity(spark, sf_dir):
    """Toxicity scores of all documents."""
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit_on_fold(documents, table(spark, sf_dir, "labels")))


@query
def op5_bpe_round_trip(spark, sf_dir):
    """Digests of all documents' ids and of the texts decoded from them."""
    documents = table(spark, sf_dir, "documents")
    lexicon = bpe.build_lexicon(documents, vocabulary_path())
    return bpe.round_trip(documents, vocabulary_path(), lexicon)


@query
def op4_token_files(spark, sf_dir):
    """What token files written from all documents hold of each."""
    folder = token_files.write_tokens(table(spark, sf_dir, "documents"), vocabulary_path())
    return token_files.read_digests(spark, folder)


@query
def op8_decontamination(spark, sf_dir):
    """Benchmark windows in all documents."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found).drop("longest")


ORACLES["op8_decontamination"] = r"""
with word as (select chr(0) as z, '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+' as p),
docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), (select p from word)) as w from documents),
items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), (select p from word)) as w from benchmark),
sized as (select item_id, w, least(10, len(w)) as size from items where len(w) > 0),
windows as (select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as s
  from (select *, unnest(range(1, len(w) - size + 2)) as i from sized)),
sizes as (select distinct size from windows),
places as (select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as s
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, sizes)),
found as (select distinct p.doc_id, p.i, p.size, x.item_id from places p join windows x on p.size = x.size and p.s = x.s),
hit as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + size)) as k from found) group by doc_id),
named as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n, 0) as n_hit, coalesce(x.n, 0) as n_items,
  sha256(coalesce(x.names, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from docs d left join hit h using (doc_id) left join named x using (doc_id)
"""


@query
def op3_top_k(spark, sf_dir):
    """The ten nearest rows of every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return knn.top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


ORACLES["op3_top_k"] = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as e
  from embeddings where embedding is not null and vec_id is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, c.vec_id,
  cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0)
select query_id, cast(r as integer) as rank, vec_id, score from (select *,
  row_number() over (partition by query_id order by score desc, vec_id) as r from pairs) where r <= 10
"""


@query
def op2_warc(spark, sf_dir):
    """What the archives of all pages say of each."""
    folder = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, folder, payloads=False).drop("url", "payload")


ORACLES["op2_warc"] = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
o as (select d, n, max(page_id) as page_id from p where n >= 1000 group by d, n)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
  case when o.page_id <> p.page_id then 'revisit' else 'response' end as record_type,
  case when o.page_id <> p.page_id then o.page_id end as refers_to
from p left join o on p.d = o.d and p.n = o.n
"""


@query
def op6_html_extraction(spark, sf_dir):
    """Main texts of all pages."""
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op9_simhash(spark, sf_dir):
    """Fingerprints and components of near copies of all documents."""
    return simhash.report(simhash.near_duplicates(table(spark, sf_dir, "documents")))


@query
def op10_suffix_dedup(spark, sf_dir):
    """What is kept of all documents without 50-byte strings that start in earlier ones."""
    return suffix_dedup.report(suffix_dedup.removals(table(spark, sf_dir, "documents")))


ORACLES["op10_suffix_dedup"] = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select *, unnest(range(n - 49)) as i from d where n >= 50)),
f as (select s, min(doc_id) as first from w group by s having min(doc_id) < max(doc_id)),
gone as (select distinct w.doc_id, unnest(range(w.i, w.i + 50)) as p from w join f using (s) where w.doc_id > f.first),
cut as (select doc_id, count(*) as n_removed, count(*) filter (where new) as n_spans, list(p) as ps from (select *,
  coalesce(p - lag(p) over (partition by doc_id order by p) > 1, true) as new from gone) group by doc_id),
kept as (select d.doc_id, string_agg(substr(h, 2 * i + 1, 2), '' order by i) as h from (select *, unnest(range(n)) as i from d) d
  left join gone g on g.doc_id = d.doc_id and g.p = d.i where g.p is null group by d.doc_id)
select d.doc_id, cast(d.n as bigint) as n_bytes, coalesce(c.n_removed, 0) as n_removed, coalesce(c.n_spans, 0) as n_spans,
  sha256(unhex(coalesce(k.h, ''))) as kept_sha256
from d left join cut c using (doc_id) left join kept k using (doc_id)
"""


@query
def op11_resampling(spark, sf_dir):
    """A quarter of all documents with at least 20 words, drawn towards the benchmark's words."""
    from twinsieve.llm import resample

    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_embedding_dedup(spark, sf_dir):
    """Links at cosine 0.9 or more, components and kept rows of all embeddings."""
    from twinsieve.llm import embed_dedup

    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op13_conversation_trie(spark, sf_dir):
    """Every node of the prefix trie of all rebuilt conversations."""
    from twinsieve.llm import conv_trie

    return conv_trie.trie(table(spark, sf_dir, "conversations"))
