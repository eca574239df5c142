"""The queries of this subpackage and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    cells, conversations, dedup, exact_search, language, licenses, manifest, mixing, neighbours, packing,
    quality, simhash, toxicity, url_reputation,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = cells.usable(_table(spark, folder, "embeddings"), zero=False)
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, 20)


def _exact(spark: SparkSession, folder: str) -> DataFrame:
    vectors = cells.usable(_table(spark, folder, "embeddings"))
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * 256))
    return exact_search.top_k(vectors.select("vec_id", whole.alias("vector")), F.col("vec_id") % 50 == 0, 5)


def _held_out(divisor: int, remainder: int) -> "F.Column":
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(hashed % divisor == remainder, F.lit(False))


def _judged(scores: DataFrame, divisor: int, remainder: int) -> DataFrame:
    return scores.withColumn("held_out", _held_out(divisor, remainder)).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int")
    )


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    labels = _table(spark, folder, "labels").where(~_held_out(5, 0))
    model = quality.fit(documents, labels.select("doc_id", F.col("quality").alias("label")))
    scores = quality.score_documents(documents, model)
    return _judged(scores, 5, 0).select("doc_id", "held_out", "score", "predicted")


def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    labels = _table(spark, folder, "labels").where(~_held_out(4, 2))
    model = toxicity.fit(documents, labels.select("doc_id", F.col("toxic").alias("label")))
    scores = toxicity.score_documents(documents, model)
    return _judged(scores, 4, 2).select("doc_id", "held_out", "score", "predicted")


def _packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), tokenizer_path())


def _urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    judged = url_reputation.judge_urls(pages, long_suffixes=url_reputation.LONG_SUFFIXES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, folder, "documents"))


def _dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.near_duplicates(_table(spark, folder, "documents"))


def _mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


def _language(spark: SparkSession, folder: str) -> DataFrame:
    model = language.fit_text(_table(spark, folder, "documents"))
    return language.identify(_table(spark, folder, "pages"), model)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    text = F.translate("text", _UPPER, _LOWER)
    others = [F.col(name) for name in manifest.FIELDS if name != "text"]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, manifest.leaf_hash(*others, text))
    built = manifest.build(manifest.document_leaves(documents, carried=tampered))
    root = F.lit(built.root)
    again = manifest.folded(F.coalesce("carried", "leaf"), F.col("path"))
    return built.proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"),
        manifest.proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == root)


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damaged(_table(spark, folder, "conversations")))


def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_probminhash_dedup": _dedup,
        "op2_adaptive_dimension_scan": _neighbours,
        "op3_raked_mixing": _mixing,
        "op4_bradley_terry_quality": _quality,
        "op5_large_item_packing": _packing,
        "op6_url_reputation": _urls,
        "op7_license_scan": _licenses,
        "op8_pivot_distance_search": _exact,
        "op9_weak_toxicity": _toxicity,
        "op10_language_evidence": _language,
        "op11_merkle_manifest": _manifest,
        "op12_conversation_repair": _conversations,
        "op13_simhash_tiles": _simhash,
    }


_URL_RULES = " ".join(
    f"""when (host = '{rule.partition("/")[0]}' or ends_with(host, '.{rule.partition("/")[0]}'))
             and starts_with(path, '/{rule.partition("/")[2]}') then '{{{number}}}'"""
    for number, (rule, _) in enumerate(sorted(url_reputation.RULES, key=lambda r: -len(r[0])))
)


def _cases(column: int) -> str:
    ordered = sorted(url_reputation.RULES, key=lambda r: -len(r[0]))
    return f"case {_URL_RULES.format(*[rule[column] for rule in ordered])} end"


def _shrunk(level: str, key: str, prior: str, prior_key: str) -> str:
    """One level of the beta-binomial priors; ``prior`` names the level above."""
    join = f"join {prior} u using ({prior_key})" if prior_key else "cross join (select m as mean from whole) u"
    return f"""
        select {key}, strength * u.mean + good as a, strength * (1 - u.mean) + labelled - good as b,
               a / (a + b) as mean
        from {level}_sums {join} cross join (
          select least(greatest(coalesce(m * (1 - m) / nullif(sum(labelled * (good / labelled - m) ** 2)
                   / sum(labelled), 0) - 1, 1000.0), 1.0), 1000.0) as strength
          from {level}_sums, whole where labelled > 0 group by m) s"""


_URLS_SQL = f"""
    with parts as (
      select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest
      from pages),
    split as (
      select page_id,
             translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
      from parts),
    ruled as (select *, {_cases(0)} as rule, {_cases(1)} as by_rule from split),
    host_sums as (
      select host, array_to_string(string_split(host, '.')[-2:], '.') as two,
             two in ({", ".join(f"'{suffix}'" for suffix in url_reputation.LONG_SUFFIXES)}) as long,
             case when long then array_to_string(string_split(host, '.')[-3:], '.') else two end as domain,
             case when long then two else string_split(host, '.')[-1] end as suffix,
             sum(case by_rule when 'allow' then 1.0 else 0.0 end) as good, count(by_rule) as labelled
      from ruled group by host),
    domain_sums as (select domain, suffix, sum(good) as good, sum(labelled) as labelled from host_sums group by all),
    suffix_sums as (select suffix, sum(good) as good, sum(labelled) as labelled from domain_sums group by all),
    whole as (select coalesce(sum(good) / nullif(sum(labelled), 0), 0.5) as m from suffix_sums),
    suffixes as ({_shrunk("suffix", "suffix", "", "")}),
    domains as ({_shrunk("domain", "domain", "suffixes", "suffix")}),
    hosts as ({_shrunk("host", "host", "domains", "domain")})
    select page_id, host, path, rule,
           coalesce(by_rule, case when mean + {url_reputation.DEVIATIONS} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
                                       < {url_reputation.THRESHOLD} then 'block' else 'allow' end) as verdict
    from ruled join hosts using (host)"""


def _crc(text: str) -> str:
    """The crc32 of a text of ASCII characters."""
    return f"""xor(list_reduce(list_prepend(4294967295::ubigint,
          list_transform(range(length({text})), lambda i: ascii(substr({text}, i + 1, 1))::ubigint)),
          lambda s, c: list_reduce(list_prepend(xor(s, c), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]),
            lambda v, z: xor(v >> 1, 3988292384::ubigint * (v & 1)))), 4294967295::ubigint)"""


def _leaf(text: str) -> str:
    fields = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
    parts = [f"coalesce(strlen({x})::varchar || ':' || {x}, '-')" for x in fields]
    return f"sha256({' || '.join(parts)})"


def _tree(name: str, leaves: str) -> str:
    """The nodes over ``leaves`` (``k, pos, n, h``), and what stands before and after each in its run."""
    run = f"partition by k, lvl, pos // {manifest.FAN} order by pos rows between"
    return f"""
    {name} as (
      select k, 0 as lvl, pos, n, h from {leaves}
      union all
      select k, lvl + 1, pos // {manifest.FAN}, (n + {manifest.FAN - 1}) // {manifest.FAN}, sha256(string_agg(h, '' order by pos))
      from {name} where n > 1 group by k, lvl, pos // {manifest.FAN}, n),
    {name}_sides as materialized (
      select k, lvl, pos, coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as before,
             coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as after
      from {name} where n > 1)"""


def _folds(name: str, start: str, sides: str) -> str:
    """From rows ``row, k, pos, own, proof`` up to the last level, as ``{name}_end``."""
    return f"""
    {name} as (
      select row, k, pos, 0 as lvl, own, proof from {start}
      union all
      select row, f.k, f.pos // {manifest.FAN}, f.lvl + 1, sha256(before || own || after), proof || before || after
      from {name} f join {sides} s on f.k = s.k and f.lvl = s.lvl and f.pos = s.pos),
    {name}_end as (select * from {name} qualify row_number() over (partition by row order by lvl desc) = 1)"""


_MANIFEST_SQL = f"""
    with recursive leaves as materialized (
      select doc_id, coalesce('=' || lang, '') as k, {_leaf("text")} as leaf,
             case when {_crc("doc_id::varchar")} % 3 = 0 then {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} end as changed
      from documents),
    numbered as materialized (
      select *, row_number() over () as row, count(*) over (partition by k) as n,
             row_number() over (partition by k order by doc_id nulls first, leaf, changed) - 1 as pos
      from leaves),
    bottom as (select k, pos, n, leaf as h from numbered), {_tree("nodes", "bottom")},
    subroots as materialized (
      select k, h, row_number() over (order by k) - 1 as pos, count(*) over () as n from nodes where n = 1),
    second as (select '' as k, pos, n, h from subroots), {_tree("upper", "second")},
    first as (select row, k, pos, coalesce(changed, leaf) as own, '' as proof from numbered),
    {_folds("climbed", "first", "nodes_sides")},
    arrived as (select row, '' as k, s.pos as pos, own, proof from climbed_end c join subroots s on c.k = s.k),
    {_folds("finished", "arrived", "upper_sides")}
    select doc_id, leaf, s.h as subroot, r.h as root, sha256(proof) as proof_sha256, own as folded_root, own = r.h as verified
    from numbered l join finished_end f using (row) join subroots s on l.k = s.k, (select h from upper where n = 1) r"""


def _edit(of: str, letter: str, line: str = "''", cost: str = "") -> str:
    """``of`` (cost, audit, lines) with one more edit; null stays null."""
    more = conversations.COSTS[letter]
    return f"case when {of} is not null then {{'c': {of}.c + {more}{cost}, 'a': {of}.a || '{letter}', 't': {of}.t || {line}}} end"


def _next(to: str, sources: list[str], role: str) -> str:
    """The cheapest way to a state by deleting a row, or by one that comes from ``sources`` and keeps or gets a role."""
    line = "chr(10) || {} || ':' || text"
    stays = [_edit(x, "R", line.format(f"'{role}'"), " + cut") for x in sources] if role != "system" else []
    kept = [f"case when left(role, 1) = '{role[0]}' then {_edit(x, 'K', line.format('role'), ' + cut')} end" for x in sources]
    may = ", ".join(f"case when not gone then {x} end" for x in stays + kept)
    return f"list_min([{_edit(to, 'D')}, {may}])"


_CONVERSATIONS_SQL = f"""
    with recursive fates as (
      select conv_id, coalesce(conv_id::varchar, ' ') as k, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
             coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as place
      from conversations),
    dealt as materialized (select *, {_crc("place")} % 20 as fate from fates),
    damaged as (
      select conv_id, k, turn, case when fate = 4 then 'user' else role end as role,
             case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
             unnest(range(case when fate = 3 then 2 else 1 end)) as copy
      from dealt where fate <> 0),
    seen as (
      select *, row_number() over (partition by k, role, text order by turn nulls first) as nth,
             rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as shown
      from damaged),
    rows as materialized (
      select k, turn, role, text, row_number() over o as i, count(*) over (partition by k) as n,
             lag(role) over o as earlier,
             case when shown = '' then 'b' when nth > 1 then 'd' when right(shown, 1) not in ('.', '!', '?') then 't' else '' end as fault,
             fault in ('b', 'd') as gone, (fault = 't')::bigint as cut
      from seen window o as (partition by k order by turn nulls first, role, text, nth)),
    steps as (
      select k, 0 as i, {{'c': 0::bigint, 'a': '', 't': ''}} as s0, case when false then s0 end as s, s as u, s as a
      from (select distinct k from dealt)
      union all
      select k, i, {_edit("s0", "D")}, {_next("s", ["s0"], "system")}, {_next("uu", ["s0", "s", "aa"], "user")},
             {_next("aa", ["uu"], "assistant")}
      from (select *, list_min([a, {_edit("uu", "I", "chr(10) || 'assistant:'")}]) as aa
            from (select p.k, r.i, s0, s, u, a, role, text, gone, cut, list_min([u, {", ".join(_edit(x, "I", "chr(10) || 'user:'") for x in ("s0", "s", "a"))}]) as uu
                  from steps p join rows r on p.k = r.k and r.i = p.i + 1))),
    ends as (
      select k, list_min([s0, a, {_edit("uu", "I", "chr(10) || 'assistant:'")}]) as best
      from (select *, list_min([u, {", ".join(_edit(x, "I", "chr(10) || 'user:'") for x in ("s0", "s"))}]) as uu
            from steps qualify row_number() over (partition by k order by i desc) = 1)),
    counts as (
      select k, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
             count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
             count(*) filter (earlier is not null and left(earlier, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal
      from rows group by k)
    select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
           coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.c as cost, best.a as audit,
           sha256(substr(best.t, 2)) as repaired_sha256
    from (select distinct conv_id, k from dealt) join ends using (k) left join counts using (k)"""


def oracle_sql() -> dict[str, str]:
    """The other operators train models, or read words and vectors in ways that SQL cannot."""
    return {
        "op6_url_reputation": _URLS_SQL,
        "op11_merkle_manifest": _MANIFEST_SQL,
        "op12_conversation_repair": _CONVERSATIONS_SQL,
    }
