"""Queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import kept_digests

    return kept_digests(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules

    return apply_rules(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import components

    return components(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import by_limit, encoded_lengths, length_histogram

    return by_limit(length_histogram(encoded_lengths(_table(spark, sf_dir, "documents"))))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(_table(spark, sf_dir, "embeddings"))


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .window_packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import rank

    return rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_warc": op2_warc,
        "op3_decontamination": op3_decontamination,
        "op4_quality_rules": op4_quality_rules,
        "op5_packing": op5_packing,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_secret_scan": op7_secret_scan,
        "op8_license_scan": op8_license_scan,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_token_counts": op10_token_counts,
        "op11_whitening": op11_whitening,
        "op12_window_packing": op12_window_packing,
        "op13_ranked_search": op13_ranked_search,
    }


_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
with d as (select row_number() over () as r, doc_id, {_SPACED.format("coalesce(text, '')")} as w from documents),
k as (select r, doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) as h from (select *, unnest(range(1, len(w) - 18)) as s from d)),
f as (select h, min({{'d': doc_id, 's': s}}) as first from k group by h),
g as (select distinct r, unnest(range(s, s + 20)) as at from k join f using (h) where {{'d': doc_id, 's': s}} > first),
x as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as at from d),
o as (select x.r, count(g.at) as gone, coalesce(string_agg(word, ' ' order by x.at) filter (g.at is null), '') as kept from x left join g on x.r = g.r and x.at = g.at group by x.r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join o using (r)
"""

_OP2 = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
r as (select *, case when octet_length(b) >= 1000 then max(page_id) over (partition by b) else page_id end as top from p)
select page_id, octet_length(b) as payload_bytes, sha1(b) as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from r
"""

_OP3 = f"""
with d as (select row_number() over () as r, doc_id, {_PLAIN} as w from documents), b as (select distinct item_id, {_PLAIN} as w from benchmark),
i as (select distinct item_id, len(v) as n, array_to_string(v, ' ') as k from (select item_id, w[s:s + 9] as v from (select *, unnest(range(1, greatest(len(w) - 8, 2))) as s from b where len(w) > 0))),
k as (select r, s, n, array_to_string(w[s:s + n - 1], ' ') as k from (select *, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from i) where len(w) >= n)),
h as (select r, s, i.n, item_id from k join i on k.k = i.k and k.n = i.n),
c as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + n)) as p from h) group by r),
j as (select r, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as items from h group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join c using (r) left join j using (r)
"""

_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP13 = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS.format(_LOWER)} as w from documents),
t as (select r, doc_id, len(w) as n, unnest(w) as term from d where len(w) > 0),
i as (select distinct item_id, unnest({_TERMS.format(_LOWER)}) as term from benchmark),
s as (select count(*) as docs, sum(len(w)) as words from d where len(w) > 0),
p as (select r, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*) as tf from t where term in (select term from i) group by r, term),
f as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as weight from p, s group by term),
e as (select item_id, r, any_value(doc_id) as doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) as score from p join f using (term) join i using (term), s group by item_id, r),
k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank, doc_id, score from e where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from k where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators whose whole result SQL can tell; the tests hold the others against plain versions."""
    return {"op1_substring_dedup": _OP1, "op2_warc": _OP2, "op3_decontamination": _OP3, "op13_ranked_search": _OP13}
