"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagveil.llm import decontaminate, fuzzy_digest, langid, lattice_lm, mixing, ogg, packing, prefix_trie, quality, simhash, token_counts, url_filter, whitening
from tagveil.llm.common import table


def op2_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.ogg_digests(table(spark, sf_dir, "documents"))


def op4_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_naive_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_empirical_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_digest.digests(table(spark, sf_dir, "documents"))


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


def op6_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"))


def op11_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_chan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_heavy_path_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_ogg": op2_ogg,
    "op4_viterbi_counts": op4_viterbi_counts,
    "op5_sum_of_squares": op5_sum_of_squares,
    "op9_naive_bayes_langid": op9_naive_bayes_langid,
    "op10_empirical_bayes_quality": op10_empirical_bayes_quality,
    "op8_golay_simhash": op8_golay_simhash,
    "op3_improbable_features": op3_improbable_features,
    "op1_pareto_mix": op1_pareto_mix,
    "op7_link_trust": op7_link_trust,
    "op6_subword_lattice": op6_subword_lattice,
    "op11_aho_corasick_decontamination": op11_aho_corasick_decontamination,
    "op12_chan_whitening": op12_chan_whitening,
    "op13_heavy_path_trie": op13_heavy_path_trie,
}

_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAMINATION_SQL = f"""with d as (select doc_id, row_number() over () as r, {_WORDS_SQL} as w from documents),
    i as (select coalesce(cast(item_id as varchar), '') as item, {_WORDS_SQL} as w from benchmark),
    s as (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as k from i where len(w) > 0),
    v as (select distinct item, cast(least(10, len(w)) as int) as n, array_to_string(w[k:k + 9], ' ') as win from s),
    t as (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from v) where len(w) >= n),
    h as (select r, k, t.n, item from t join v on v.n = t.n and v.win = array_to_string(t.w[k:k + t.n - 1], ' ')),
    p as (select r, unnest(range(k, k + n)) as pl from (select distinct r, k, n from h)),
    n as (select r, count(distinct pl) as n_hit from p group by r),
    o as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from h) group by r)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join n using (r) left join o using (r)"""

# crc32 of a decimal number, bit by bit
_CRC_SQL = "xor(list_reduce(list_concat([cast(4294967295 as bigint)], list_transform(str_split(cast({0} as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda a, b: list_reduce(list_concat([xor(a, b)], [cast(0 as bigint) for z in range(8)]), lambda x, y: case when x % 2 = 1 then xor(x // 2, cast(3988292384 as bigint)) else x // 2 end)), cast(4294967295 as bigint))"
_TRIE_SQL = f"""with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p from conversations where conv_id is not null),
    z as (select conv_id, count(*) as n from t group by conv_id),
    c as (select z.conv_id, z.n, {_CRC_SQL.format("z.conv_id")} % 6 as h, z.conv_id - z.conv_id % 100 as base, coalesce(b.n, 0) as nb from z left join z b on b.conv_id = z.conv_id - z.conv_id % 100),
    r as (select c.conv_id, t.p as pl, role, text from c join t on t.conv_id = c.base and t.p <= c.h union all select c.conv_id, t.p - c.h + least(c.h, c.nb), role, text from c join t on t.conv_id = c.conv_id and t.p > c.h),
    k as (select conv_id, pl, length(text) as chars, array_to_string(list(md5(role || chr(1) || text)) over (partition by conv_id order by pl), ' ') as k, count(*) over (partition by conv_id) as n from r),
    a as (select *, coalesce(lag(k) over (partition by conv_id order by pl), '') as pk from k union all select conv_id, 0, 0, '', coalesce((select any_value(n) from k where k.conv_id = c.conv_id), 0), null from c),
    g as (select k, pl, min(conv_id) as conv_id, count(*) as n_convs, any_value(pk) as pk, any_value(chars) as chars, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (pl = n), '')) as ends_sha256 from a group by k, pl),
    q as (select pk, count(*) as n_children from g where pk is not null group by pk),
    m as (select g.*, coalesce(n_children, 0) as n_children from g left join q on g.k = q.pk),
    s as (select a.k, sum(case when m.n_children = 0 then 1 else 0 end) as n_leaves, sum((m.n_convs - 1) * m.chars) as saved_tokens from m join a on a.conv_id = m.conv_id and a.pl <= m.pl group by a.k)
    select m.conv_id, cast(m.pl as bigint) as depth, o.conv_id as parent_conv_id, m.n_convs, m.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, m.ends_sha256 from m join s on m.k = s.k left join g o on o.k = m.pk"""

ORACLE_SQL: dict[str, str] = {"op11_aho_corasick_decontamination": _DECONTAMINATION_SQL, "op13_heavy_path_trie": _TRIE_SQL}
