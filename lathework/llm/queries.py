"""The corpus queries: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import ann, decontaminate, langid, mixing, pii, secret_scan, simhash, suffix_dedup, warc, window_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.remove_repeated_windows(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_strings(_table(spark, sf_dir, "documents"))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of ``op2_secret_scan`` SQL can express: the base spans."""
    return op2_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of ``op6_pii`` SQL can express: the base spans."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_multi_index, op2_secret_scan, op3_language_id, op4_source_mixing, op5_simhash_golay, op6_pii, op7_decontamination, op8_window_dedup, op9_warc, op10_suffix_dedup,
        secret_base, pii_base,
    )
    return {f.__name__: f for f in operators}


def _base_spans(kinds: dict[str, tuple[str, str]]) -> str:
    """SQL for base spans: ``kinds`` maps each name to its pattern and to the condition that keeps a match ``m``.

    Matches and the gaps between them give the places.
    """
    found = " union all ".join(f"select doc_id, {k} k, '{name}' kind, regexp_extract_all(t, '{p}') ms, regexp_split_to_array(t, '{p}') gaps from d" for k, (name, (p, _)) in enumerate(kinds.items()))
    keep = " or ".join(f"(kind = '{name}' and {condition})" for name, (_, condition) in kinds.items())
    counts = ", ".join(f"count(*) filter (kind = '{name}') n_{name}" for name in kinds)
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
found as ({found}),
each_ as (select doc_id, k, kind, ms[i] m, list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) a from (select *, unnest(range(1, len(ms) + 1)) i from found)),
kept as (select doc_id, k, kind, cast(a as bigint) a, cast(a as bigint) + length(m) e from each_ where {keep}),
told as (select doc_id, {counts}, string_agg(kind || ':' || a || ':' || e, ',' order by a, k) spans from kept group by doc_id)
select doc_id, {", ".join(f"coalesce(n_{name}, 0) n_{name}" for name in kinds)}, sha256(coalesce(spans, '')) base_sha256 from d left join told using (doc_id)"""


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([case when j % 2 = 1 then c else 2 * c - 9 * cast(2 * c > 9 as integer) end for c, j in [cast(x as integer) for x in string_split(reverse({_DIGITS}), '')]]) % 10 = 0"


#: SQL for the operators that SQL can express on whole tables; the others are tested against brute force.
ORACLES = {
    "op7_decontamination": r"""
with cut as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
items as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
numbered as (select *, row_number() over (order by item) item_row from items),
windows as (select item, item_row, i place, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') k from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from numbered where len(w) > 0)),
sizes as (select distinct n from windows),
starts as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from cut, sizes where len(w) >= n)),
hits as (select doc_id, i, s.n, item, item_row, place from starts s join windows using (n, k)),
chains as (select doc_id, item, item_row, n, place - i diagonal, i, i - row_number() over (partition by doc_id, item_row, n, place - i order by i) chain from hits),
matches as (select doc_id, item, min(i) - 1 a, max(i) - min(i) + n size from chains group by doc_id, item, item_row, n, diagonal, chain),
told as (select doc_id, string_agg(size || ':' || a || ':' || item, ',' order by a, size desc, item) matches from (select distinct doc_id, item, a, size from matches) group by doc_id),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from (select distinct doc_id, i, n from hits)) group by doc_id),
found as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) list from hits group by doc_id)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(list, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(matches, '') matches
from cut left join words using (doc_id) left join found using (doc_id) left join told using (doc_id)""",
    "op8_window_dedup": r"""
with cut as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
starts as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) k from (select doc_id, w, unnest(range(1, len(w) - 18)) i from cut where len(w) >= 20)),
late as (select doc_id, i from (select *, row_number() over (partition by k order by doc_id, i) r from starts) where r > 1),
gone as (select doc_id, list(distinct p) ps from (select doc_id, unnest(range(i, i + 20)) p from late) group by doc_id)
select doc_id, len(w) n_words, coalesce(len(ps), 0) n_removed,
  sha256(array_to_string(case when ps is null then w else list_filter(w, lambda x, j: not list_contains(ps, j)) end, ' ')) kept_sha256
from cut left join gone using (doc_id)""",
    "op9_warc": """
with page as (select page_id, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) d from pages),
firsts as (select d, min(page_id) f from page where n >= 100 group by d)
select page_id, n payload_bytes, page.d payload_digest, case when f <> page_id then 'revisit' else 'response' end record_type, case when f <> page_id then f end refers_to
from page left join firsts on firsts.d = page.d and n >= 100""",
    "op10_suffix_dedup": """
with t as (select doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n from documents),
long as (select doc_id, i, md5(substr(h, 2 * i + 1, 800)) k from (select doc_id, h, unnest(range(0, n - 399)) i from t where n >= 400)),
short as (select doc_id, i, md5(substr(h, 2 * i + 1, 480)) k from (select doc_id, h, unnest(range(0, n - 239)) i from t where n >= 240)),
twice as (select 400 size, doc_id, i from (select doc_id, i, count(*) over (partition by k) c from long) where c > 1
  union all select 240, doc_id, i from (select doc_id, i, count(*) over (partition by k) c from short) where c > 1),
numbered as (select size, doc_id, i, sum(case when i - p <= size then 0 else 1 end) over (partition by size, doc_id order by i) g
  from (select *, lag(i) over (partition by size, doc_id order by i) p from twice)),
gone as (select size, doc_id, min(i) a, max(i) + size b from numbered group by size, doc_id, g),
cut as (select doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) head, max(b) last, sum(b - a) n_removed, count(*) n_spans
  from (select doc_id, a, b, h, lag(b, 1, 0) over (partition by doc_id order by a) before from gone join t using (doc_id) where size = 400) group by doc_id),
told as (select doc_id, sum(b - a) n_repeated from gone where size = 240 group by doc_id)
select doc_id, n n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, coalesce(n_spans, 0) n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) kept_sha256, cast(coalesce(n_repeated, 0) as bigint) n_repeated
from t left join cut using (doc_id) left join told using (doc_id)""",
    "secret_base": _base_spans({
        "assign": (_ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6"), "access": ("AKIA[A-Z0-9]+", "length(m) >= 20"), "hex": ("[0-9a-f]+", "length(m) >= 24"),
    }),
    "pii_base": _base_spans({
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len([x for x in string_split(m, '.') if length(ltrim(x, '0')) > 3 or (length(ltrim(x, '0')) = 3 and ltrim(x, '0') > '255')]) = 0"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) between 12 and 19 and {_LUHN}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15"),
    }),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
