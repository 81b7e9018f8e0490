"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumula.llm import cotraining, lexical_search, line_dedup, mixture_packing, mpeg_audio, packing, periodic_runs, quality_rules, sentencepiece_codec, simhash, token_counts, token_files, toxicity
from cumula.llm.common import held_out, table


#: Tokens beyond which a document is over the limit.
TOKEN_LIMIT = 1024


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, their spans and the decoded text, as digests."""
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that repeat an earlier one."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document carried in MPEG audio frames and read back."""
    return mpeg_audio.media_digests(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by two co-trained views."""
    docs = table(spark, sf_dir, "documents")
    scored = cotraining.score(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("kept"), "by_words", "by_page")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule metrics and verdict of every document."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), quality_rules.trusted_ids(table(spark, sf_dir, "labels")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written in range-coded stripes and read back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: The id behind every document of op11.
MIXTURE_END = 2


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in windows that hold each source at its share of all tokens."""
    pieces = mixture_packing.pack_mixture(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), MIXTURE_END)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of a document; one in ten, by crc32 of its id, repeats a stretch to its end."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, and what is left without their repeats."""
    return periodic_runs.run_digests(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), prepare=repeated_tail))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_media_columns": op6_media_columns,
    "op7_simhash": op7_simhash,
    "op8_cotraining": op8_cotraining,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_files": op10_token_files,
    "op11_mixture_packing": op11_mixture_packing,
    "op12_lexical_search": op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

#: Lines of ten characters or more, trimmed; a partner one edit away shares the first or the last five.
LINE_DEDUP_SQL = r"""
with d as (select doc_id, text, row_number() over () as rid from documents),
raw as (select rid, doc_id, unnest(string_split(text, chr(10))) as s0, unnest(range(len(string_split(text, chr(10))))) as line from d where text is not null),
li as (select rid, doc_id, line, s0, trim(s0, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as s from raw),
el as (select s, min(struct_pack(doc_id := doc_id, line := line)) as f from li where length(s) >= 10 group by s),
near as (
  select a.s from el a join el b on left(a.s, 5) = left(b.s, 5) and a.f > b.f and abs(length(a.s) - length(b.s)) <= 1 and levenshtein(a.s, b.s) <= 1
  union
  select a.s from el a join el b on right(a.s, 5) = right(b.s, 5) and a.f > b.f and abs(length(a.s) - length(b.s)) <= 1 and levenshtein(a.s, b.s) <= 1),
marked as (
  select li.*, length(li.s) >= 10 and (near.s is not null or struct_pack(doc_id := li.doc_id, line := li.line) > el.f) as gone
  from li left join el on li.s = el.s left join near on li.s = near.s),
per as (
  select rid, count(*)::int as n_lines, (count(*) filter (where gone))::int as n_removed,
         string_agg(s0, chr(10) order by line) filter (where not coalesce(gone, false)) as kept,
         coalesce(bool_or(s <> '') filter (where not coalesce(gone, false)), false) as worded
  from marked group by rid)
select d.doc_id, case when d.text is null then null else coalesce(per.kept, '') end as text,
       coalesce(per.n_lines, 0) as n_lines, coalesce(per.n_removed, 0) as n_removed,
       coalesce(per.n_removed > 0 and not per.worded, false) as emptied
from d left join per on d.rid = per.rid
"""

#: Terms of every text, then every document's score for every item that shares a term with it.
LEXICAL_SEARCH_SQL = r"""
with d as (select row_number() over () as rid, doc_id, text from documents),
t as (select rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
tf as (select rid, doc_id, term, count(*)::bigint as tf from t group by all),
n as (select rid, sum(tf)::bigint as n from tf group by rid),
s as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from n),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, s group by term, n_docs),
i as (select row_number() over () as iid, item_id, text from benchmark),
it as (select distinct iid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from i),
scored as (
  select it.iid, it.item_id, tf.rid, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * n.n * s.n_docs) // s.n_terms))))::bigint as score
  from it join tf using (term) join w using (term) join n on n.rid = tf.rid, s
  group by all having score > 0),
ranked as (select *, row_number() over (partition by iid order by score desc, doc_id, rid)::int as rank from scored)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""

ORACLES: dict[str, str] = {
    "op4_line_dedup": LINE_DEDUP_SQL,
    "op12_lexical_search": LEXICAL_SEARCH_SQL,
}
