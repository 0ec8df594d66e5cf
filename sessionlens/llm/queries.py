"""Registered queries of the corpus operators, (spark, folder) -> DataFrame over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlens.llm import (bpe, collocations, decontaminate, exact_dedup, mixing, ngram_join, periodic_runs, quality, sharding, suffix_dedup, token_count,
                             url_filter, warc)
from sessionlens.llm.common import keep, new_path

WORD = r"[^\x20\x09-\x0D]+"


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mixing(spark, folder):
    docs = keep(table(spark, folder, "documents").select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")), "sizes")
    plan = mixing.plan_mix(docs, mixing.ranked_weights(docs))
    return mixing.mix(docs, plan).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                                         "source", "copies")


def op2_kd_sharding(spark, folder):
    """Dimensions: language, length and checksum of the text; equal texts agree in all, so cuts keep them together
    unless the median falls among them."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    crc = F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint")
    docs = table(spark, folder, "documents").select("doc_id", "lang", size.alias("n_bytes"), crc.alias("text_crc32"))
    dims = ["lang", "n_bytes", "text_crc32"]
    points = keep(sharding.with_points(docs, dims, F.col("n_bytes") + 8, "doc_id"), "points")
    levels = sharding.kd_cuts(points, len(dims), shards=24)
    rows = sharding.kd_assign(points, len(dims), levels)
    placed = sharding.with_slots(rows, 24, ["doc_id", "n_bytes", "text_crc32"])
    return placed.select("doc_id", (F.col("n_bytes") + 8).alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op3_decontamination(spark, folder):
    """Documents that contain an item of the benchmark, with the item."""
    found = decontaminate.find_items(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "coverage", "exact")


def op4_exact_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    index, _ = exact_dedup.build_index(docs)
    return exact_dedup.mark_copies(docs, index).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_suffix_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, suffix_dedup.repeated_spans(docs))


def op6_ngram_jaccard(spark, folder):
    return ngram_join.jaccard_components(table(spark, folder, "documents").select("doc_id", "text")).drop("row")


def op7_warc(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.col("url").alias("target_uri"), "html")
    records = warc.mark_revisits(pages, "page_id", "html")
    place = new_path(spark, "warc")
    manifest = keep(warc.write_bundles(records, place), "manifest")
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    return warc.read_records(manifest, place).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                                     number("refers_to").alias("refers_to"))


#: host, path, verdict
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
             ("com", "/de/", "block")]


def op8_url_filter(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, folder, "labels").where(~held)
    weights = quality.train(docs, labels)
    scored = quality.score(docs.withColumn("held_out", F.coalesce(held, F.lit(False))), weights)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_token_counts(spark, folder, vocabulary: str | None = None):
    if vocabulary is None:
        import public_tokenizers
        vocabulary = str(public_tokenizers.path("word_bpe_49k.json"))
    counts = token_count.count_tokens(table(spark, folder, "documents").select("doc_id", "text"), vocabulary)
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op11_bpe(spark, folder, vocabulary: str | None = None):
    if vocabulary is None:
        import public_tokenizers
        vocabulary = str(public_tokenizers.path("word_bpe_49k.json"))
    encoded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), vocabulary).drop("text")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    encoded = encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    return bpe.decode(encoded, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_collocations(spark, folder):
    return collocations.collocations(collocations.frequent_phrases(table(spark, folder, "documents").select("lang", "text")))


#: Documents whose checksum ends in 0 repeat a stretch of their own words from a place on.
REPEATING = r"""
case when crc32(cast(doc_id as string)) % 10 = 0 then transform(array(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)), w ->
  transform(array(crc32(cast(doc_id as string)) div 10 % size(w)), a ->
    transform(array(1 + (size(w) - a) div (3 + crc32(cast(doc_id as string)) div 10 % 8)), p ->
      array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' '))[0])[0])[0]
else text end"""


def op13_periodic_runs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.expr(REPEATING).alias("text"))
    runs = periodic_runs.find_runs(docs)
    best = F.expr("""aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (best, r) ->
        if(best is null or cast(r.length as decimal(19, 0)) * best.period > cast(best.length as decimal(19, 0)) * r.period, r, best))""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return runs.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_kd_sharding, op3_decontamination, op4_exact_dedup, op5_suffix_dedup, op6_ngram_jaccard, op7_warc, op8_url_filter, op9_quality,
    op10_token_counts, op11_bpe, op12_collocations, op13_periodic_runs)}

# --- SQL twins -------------------------------------------------------------------------

ORACLE = {
    "op1_mixing": r"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint u from documents),
sources as (
  select source, sum(size)::bigint source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double weight
  from docs group by source),
ratios as (
  select *, row_number() over (order by 3.0 * source_size / weight, source nulls last) k from sources),
levels as (
  select k, weight, source_size, ((select sum(source_size) from sources)
      - coalesce(sum(3 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by k desc) as level from ratios),
level as (select min_by(level, k) as level from levels where level * weight < 3.0 * source_size),
targets as (
  select source, source_size, least(3.0 * source_size, weight * (select level from level))::double target from sources),
plan as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end whole from targets),
heap as (
  select d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size rest,
    sum(size) over (partition by d.source order by u) upto, sum(size) over (partition by d.source, u) own
  from docs d join plan p on d.source is not distinct from p.source)
select doc_id, size, source_size, target,
  (least(whole + case when u <= coalesce(last, -1) then 1 else 0 end, 3) * size)::bigint taken, source,
  least(whole + case when u <= coalesce(last, -1) then 1 else 0 end, 3)::bigint copies
from (select *, max(case when upto - own / 2 <= rest then u end) over (partition by source) last from heap)""",
    "op3_decontamination": r"""
with texts as (select 'd' k, doc_id id, text from documents union all select 'b', item_id, text from benchmark),
raw as (select k, id, regexp_extract_all(coalesce(text, ''), '\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+|[.!?\n]') r from texts),
slots as (
  select k, id, r, list_transform(r, lambda w, i: case
    when w[1] between '0' and '9' then '<number>'
    when lower(w) = w then case when i > 1 and r[i - 1][1] between '0' and '9' and w in (UNITS) then '<unit>' else w end
    when i > 1 and length(w) > 1 and lower(w[1]) <> w[1] and lower(w[2:]) = w[2:] and r[i - 1] not in ('.', '!', '?', chr(10)) then '<name>'
    else lower(w) end) s from raw),
plain as (
  select k, id, list_filter(r, lambda w: w not in ('.', '!', '?', chr(10))) r, list_filter(s, lambda w: w not in ('.', '!', '?', chr(10))) s from slots),
widths as (select distinct least(8, len(s)) w from plain where k = 'b' and len(s) > 0),
wins as (
  select k, id, w, "at", list_slice(p.r, "at" + 1, "at" + w) r, list_slice(p.s, "at" + 1, "at" + w) s, len(p.s) - w + 1 n
  from (select * from plain join widths on w <= len(s) and (k = 'd' or w = least(8, len(s)))) p, unnest(range(len(p.s) - w + 1)) t("at")),
met as (
  select d.id doc_id, b.id item_id, b.n, b."at", d."at" - b."at" shift,
    list_filter(list_transform(range(1, b.w + 1), lambda i: {'kind': b.s[i], 'said': b.r[i], 'found': d.r[i]}), lambda x: starts_with(x.kind, '<')) p
  from wins d join wins b on d.w = b.w and d.s = b.s and d.k = 'd' and b.k = 'b'
  where len(list_filter(b.s, lambda w: not starts_with(w, '<'))) >= 4),
aligned as (
  select doc_id, item_id, n, shift, count(distinct "at") windows, list_distinct(flatten(list(list_transform(p, lambda x: {'said': x.said, 'found': x.found})))) p
  from met group by all)
select doc_id, item_id, max(windows)::bigint windows, max(windows / n) coverage,
  bool_or(len(list_filter(p, lambda x: x.said <> x.found)) = 0) "exact"
from aligned where windows >= 0.3 * n and len(list_distinct(list_transform(p, lambda x: x.said))) = len(p)
group by all""".replace("UNITS", ", ".join(f"'{unit}'" for words in decontaminate.UNITS.values() for unit in words)),
    "op4_exact_dedup": """
select doc_id, max(doc_id) over g keep_id, count(*) over g group_size, doc_id = max(doc_id) over g kept,
  sha256(coalesce(text, '')) text_sha256
from documents window g as (partition by coalesce(text, ''))""",
    "op6_ngram_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
  from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) s from w),
n as (select doc_id, count(*) n from s group by 1),
b as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from b join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
reach as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(w.doc_id, coalesce(r.low, w.doc_id)) component_id
from w left join n on n.doc_id = w.doc_id left join (select x, min(y) low from reach group by 1) r on r.x = w.doc_id""",
    "op7_warc": """
with p as (select page_id, coalesce(html, '') body, sha1(coalesce(html, '')) h from pages),
d as (select *, min(page_id) over (partition by body) first from p)
select page_id, strlen(body)::bigint payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, ((5 * i) // 4 + 1)::int, 2))::int >> (3 - (5 * i) % 4)::int) & 31) + 1)::int, 1)), 'string_agg', '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type,
  case when page_id <> first then first end refers_to
from d""",
    "op8_url_filter": r"""
with u as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
r(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best as (
  select host, path, arg_max(h || p, length(h || p)) rule, arg_max(v, length(h || p)) verdict
  from (select distinct host, path from u) u join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by all)
select page_id, u.host, u.path, rule, coalesce(verdict, 'allow') verdict from u left join best b on u.host = b.host and u.path = b.path""",
    "op12_collocations": r"""
with w as (
  select coalesce(lang, 'und') lang, regexp_extract_all(p, '[^\x20\x09]+') w
  from (select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) p from documents)),
f as (
  select lang, k, phrase, count(*)::hugeint a
  from (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) phrase from w, (select unnest(range(1, 6)) k))
  group by all),
n as (select lang, sum(a)::hugeint n from f where k = 1 group by 1),
often as materialized (select * from f where a >= 100),
c as (select * from often where k > 1),
halves as (
  select lang, phrase, a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') head, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') tail
  from c, (select unnest(range(1, 5)) cut) where cut < k),
cuts as (
  select h.lang, h.phrase, h.a, cut, l.a l, r.a r, n, (1000 * h.a * n) // (l.a * r.a) score
  from halves h join often l on l.lang = h.lang and l.phrase = head join often r on r.lang = h.lang and r.phrase = tail join n on n.lang = h.lang),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
stay as (
  select * from best b where not exists (
    select 1 from c where c.lang = b.lang and c.a = b.a and len(c.phrase) > len(b.phrase) and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) "rank", phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n,
  score::bigint score
from stay qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000""",
}
