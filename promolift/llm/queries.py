"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolift.llm.chat import as_trees, digests, format_trees
from promolift.llm.exact_dedup import exact_dedup
from promolift.llm.html import extract
from promolift.llm.jaccard import jaccard_classes
from promolift.llm.line_dedup import line_dedup
from promolift.llm.lm import score_texts
from promolift.llm.negatives import hard_negatives
from promolift.llm.packing import pack
from promolift.llm.pieces import decode_texts, encode_texts
from promolift.llm.quality import quality
from promolift.llm.sharding import shard_documents
from promolift.llm.token_files import placed, read_files, write_files
from promolift.llm.whitening import whitened_components

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_streaming_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    decoded = decode_texts(encode_texts(table(spark, folder, "documents"), path), path)
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).alias("round_trip"))


def op2_reply_trees(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)],
        "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_trees(as_trees(rows.unionByName(extra)), most_branches=1))


def op3_wavelet_files(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    files = write_files(table(spark, folder, "documents"), path, "dropped", end_id=2)
    # Checksums before the join: ids need not travel.
    rows = read_files(files).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return placed(rows, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_classes(table(spark, folder, "documents"), width=3, percent=90).drop("n_connecting_links")


def op5_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(table(spark, folder, "documents"), path, "kept", end_id=1).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


def op6_label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"))


def op7_site_style_tree(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


def op9_adaptive_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_qdwh_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened_components(table(spark, folder, "embeddings"), most=8)


def op12_elias_fano_lm(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scores = score_texts(table(spark, folder, "documents"), training=~F.coalesce(held_out, F.lit(False)))
    return scores.withColumn("held_out", ~F.col("training")).drop("training")


def op13_gnat_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(
        "vec_id", "embedding",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, anchor=F.col("id") % 100 == 0, scale=256, positives=5, top=10, low=30, high=90)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_streaming_viterbi, op2_reply_trees, op3_wavelet_files, op4_jaccard_join, op5_mixture_packing, op6_label_propagation, op7_site_style_tree, op8_exact_dedup, op9_adaptive_quality, op10_line_dedup,
        op11_qdwh_whitening, op12_elias_fano_lm, op13_gnat_negatives)
}

ORACLES: dict[str, str] = {
    "op2_reply_trees": """
        with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') s from conversations
                   union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
                   union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e as (select *, length(r) + length(s)
                  + len(regexp_extract_all(r, '</?s>|\\[/?INST\\]|\\[/?TURN\\]|\\[SAYS\\]'))
                  + len(regexp_extract_all(s, '</?s>|\\[/?INST\\]|\\[/?TURN\\]|\\[SAYS\\]'))
                  + 15 + case when r = 'assistant' then 6 else 9 end as n from t)
        select conv_id, count(*) as n_turns,
               sha256(string_agg(r || chr(10) || s || chr(10), '' order by turn)) as turns_sha256,
               cast(coalesce(sum(length(s)) filter (r = 'assistant'), 0) as bigint) as loss_chars,
               sha256(coalesce(string_agg(s, '' order by turn) filter (r = 'assistant'), '')) as loss_sha256,
               cast(sum(n) as bigint) as formatted_chars
        from e group by conv_id""",
    "op7_site_style_tree": """
        with b as (
            select page_id, url, generate_subscripts(l, 1) as i, unnest(l) as block
            from (select page_id, url, string_split_regex(
                      regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') l from pages)),
        c as (select page_id, url, i, trim(regexp_replace(replace(regexp_replace(
                  regexp_replace(block, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;', '&'),
                  '\\s+', ' ', 'g')) as said from b)
        select page_id, url, coalesce(string_agg(said, chr(10) order by i) filter (said <> ''), '') as text,
               length(coalesce(string_agg(said, chr(10) order by i) filter (said <> ''), '')) as n_chars
        from c group by page_id, url""",
    "op8_exact_dedup": """
        with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g')) s
                   from documents),
             g as (select s, min(doc_id) keep_id, count(*) n from t group by s)
        select doc_id, keep_id, n as group_size, doc_id = keep_id as kept, s as text_sha256
        from t join g using (s)""",
    "op9_adaptive_quality": """
        with w as (
            select doc_id, lang, source, text,
                   list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') words
            from documents),
        p as (select doc_id, generate_subscripts(words, 1) as i, words from w where len(words) > 8),
        grams as (select doc_id, i, array_to_string(words[i:i+7], ' ') g from p where i + 7 <= len(words)),
        dup as (select doc_id, i, count(*) over (partition by doc_id, g) c from grams),
        cov as (select distinct doc_id, i + k as pos from dup, (select unnest(range(8)) k) where c > 1),
        rep as (select doc_id, count(*) n from cov group by doc_id),
        m as (select w.doc_id, lang, source, cast(len(words) as bigint) n_words,
                     cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) word_chars,
                     cast(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols,
                     cast(len(nb) - len(list_distinct(nb)) as bigint) n_dup_lines, cast(len(nb) as bigint) n_lines,
                     cast(coalesce(rep.n, 0) as bigint) n_repeat_words
              from (select *, list_filter(string_split(coalesce(text, ''), chr(10)),
                                          lambda x: regexp_matches(x, '[^ \\t-\\r]')) nb from w) w
              left join rep using (doc_id)),
        f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m),
        v as (select doc_id, lang, source, base_failed, unnest([
                {'m': 'word_length', 'v': 20 * word_chars // greatest(n_words, 1), 'least': 20, 'below': 10},
                {'m': 'symbols', 'v': 200 * n_symbols // greatest(n_words, 1), 'least': 10, 'below': null},
                {'m': 'dup_lines', 'v': 100 * n_dup_lines // greatest(n_lines, 1), 'least': 10, 'below': null},
                {'m': 'repeats', 'v': 100 * n_repeat_words // greatest(n_words, 1), 'least': 5, 'below': null}],
                recursive := true) from f),
        b as (select *, case when v > 1000 then 1000 + cast(floor(100 * log2(v / 1000.0)) as bigint) else v end as bin
              from v),
        own as (select lang, source, m, any_value(least) s, any_value(below) w, count(*) n,
                       quantile_disc(bin, 0.25) q1, quantile_disc(bin, 0.75) q3
                from b where not base_failed group by all),
        by_lang as (select lang, m, any_value(least) s, any_value(below) w, count(*) n,
                       quantile_disc(bin, 0.25) q1, quantile_disc(bin, 0.75) q3
                    from b where not base_failed group by all),
        everything as (select m, any_value(least) s, any_value(below) w, count(*) n,
                       quantile_disc(bin, 0.25) q1, quantile_disc(bin, 0.75) q3
                       from b where not base_failed group by all),
        picked as (select o.lang, o.source, o.m, o.s, o.w,
                    case when o.n >= 50 then o.q1 when l.n >= 50 then l.q1 else e.q1 end as q1,
                    case when o.n >= 50 then o.q3 when l.n >= 50 then l.q3 else e.q3 end as q3
                from own o join by_lang l on o.lang is not distinct from l.lang and o.m = l.m
                join everything e on o.m = e.m),
        cut as (select *, q3 + 4 * greatest(q3 - q1, s) as most,
                       case when w is not null then q1 - 4 * greatest(q3 - q1, w) end as fewest from picked),
        over as (select b.doc_id, bool_or(coalesce(b.bin > cut.most, false) or coalesce(b.bin < cut.fewest, false)) as bad
                 from b left join cut on b.lang is not distinct from cut.lang
                  and b.source is not distinct from cut.source and b.m = cut.m group by b.doc_id)
        select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               not base_failed and not bad as kept
        from f join over using (doc_id)""",
    "op10_line_dedup": """
        with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
        k as (select *, translate(regexp_replace(line, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
        dead as (select key, max(doc_id) keeper from k where length(key) >= 20
                 group by key having count(distinct doc_id) >= 3),
        j as (select k.doc_id, i, line, keeper is not null and keeper <> k.doc_id as gone
              from k left join dead on k.key = dead.key)
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
        from j group by doc_id""",
}
