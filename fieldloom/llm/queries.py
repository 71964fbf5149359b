"""The queries of the training-data operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm.common import table
from fieldloom.llm.decontaminate import benchmark_matches
from fieldloom.llm.exact_dedup import exact_dedup
from fieldloom.llm.hard_negatives import hard_negatives
from fieldloom.llm.html_wrapper import extract_pages
from fieldloom.llm.license_scan import NOTICES, PHRASES, license_scan, wanted
from fieldloom.llm.line_dedup import line_dedup
from fieldloom.llm.mixing import mix_to_targets
from fieldloom.llm.ngram_join import near_duplicates
from fieldloom.llm.quality import quality_scores
from fieldloom.llm.sharding import hilbert_shards
from fieldloom.llm.suffix_dedup import repeated_spans
from fieldloom.llm.url_filter import filter_urls
from fieldloom.llm.vector_codes import codebook_digest, encode, train_codebooks
from fieldloom.llm.vectors import scaled, usable
from fieldloom.plans.joins import lookup_join
from fieldloom.session import stored

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(make: Query) -> Query:
        QUERIES[name] = make
        if oracle is not None:
            ORACLES[name] = oracle
        return make

    return register


# --- 1: lines --------------------------------------------------------------------------------

_MASKED_SQL = r"""
lines as (
  select doc_id, line_no, case when regexp_matches(plain, '[0-9]') then regexp_replace(plain, '[^ ]*[0-9][^ ]*', '<*>', 'g') else plain end as masked
  from (select doc_id, u.line_no - 1 as line_no, trim(regexp_replace(parts[u.line_no], '[ \t\r]+', ' ', 'g'), ' ') as plain
        from (select doc_id, string_split(text, chr(10)) as parts from documents), unnest(range(1, len(parts) + 1)) as u(line_no))),
leafed as (
  select *, len(string_split(masked, ' ')) as n, concat_ws(' ', len(string_split(masked, ' ')), array_to_string(string_split(masked, ' ')[1:4], ' ')) as leaf
  from lines where len(string_split(masked, ' ')) >= 3),
each_line as (
  select leaf, masked, min(doc_id) as a, max(doc_id) as b from leafed
  where leaf in (select leaf from leafed group by leaf having min(doc_id) < max(doc_id)) group by leaf, masked),
counts as (select leaf, count(*) as n_lines from each_line group by leaf),
words as (
  select leaf, u.pos, string_split(masked, ' ')[u.pos] as word
  from each_line, unnest(range(1, len(string_split(masked, ' ')) + 1)) as u(pos)),
tops as (
  select leaf, pos, max(c) as top from (select leaf, pos, word, count(*) as c from words group by all) group by leaf, pos),
fixed as (select t.leaf, pos, top >= 0.9 * n_lines as is_fixed from tops t join counts c on t.leaf = c.leaf),
general as (select leaf from fixed where pos > 4 group by leaf having avg(is_fixed::int) >= 0.6),
templates as (
  select w.leaf, w.masked, string_agg(case when f.is_fixed or g.leaf is null then w.word else '<*>' end, ' ' order by w.pos) as template
  from (select e.leaf, e.masked, u.pos, string_split(e.masked, ' ')[u.pos] as word
        from each_line e, unnest(range(1, len(string_split(e.masked, ' ')) + 1)) as u(pos)) w
  join fixed f on w.leaf = f.leaf and w.pos = f.pos left join general g on w.leaf = g.leaf
  group by w.leaf, w.masked),
recurring as (
  select t.leaf, template, min(a) as keeper from templates t join each_line e on t.leaf = e.leaf and t.masked = e.masked
  group by t.leaf, template having min(a) < max(b)),
lost as (
  select l.doc_id, l.line_no from leafed l join templates t on l.leaf = t.leaf and l.masked = t.masked
  join recurring r on t.leaf = r.leaf and t.template = r.template where l.doc_id <> r.keeper)
"""


@query("op1_line_dedup", rf"""
with {_MASKED_SQL},
split as (
  select doc_id, u.line_no - 1 as line_no, parts[u.line_no] as line
  from (select doc_id, string_split(text, chr(10)) as parts from documents), unnest(range(1, len(parts) + 1)) as u(line_no))
select s.doc_id, count(*)::int as n_lines, count(x.doc_id)::int as n_dropped,
       coalesce(string_agg(s.line, chr(10) order by s.line_no) filter (where x.doc_id is null), '') as text
from split s left join lost x on s.doc_id = x.doc_id and s.line_no = x.line_no
group by s.doc_id
""")
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The whole text of every document less lines whose template recurs."""
    return line_dedup(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


# --- 2: exact copies -------------------------------------------------------------------------


@query("op2_exact_dedup", r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare from documents)
select doc_id,
       first_value(doc_id) over (partition by bare order by length(text) desc, doc_id
                                 rows between unbounded preceding and unbounded following) as keep_id,
       count(*) over (partition by bare) as group_size,
       row_number() over (partition by bare order by length(text) desc, doc_id) = 1 as kept,
       sha256(bare) as text_sha256
from d
""")
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup(spark, f"{folder}/documents.parquet")
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


# --- 3: quality ------------------------------------------------------------------------------


@query("op3_quality")
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """A score for every document, learned from the labels that are not held out."""
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


# --- 4: repeated strings ---------------------------------------------------------------------


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What every document loses of strings of 50 bytes that an earlier document has."""
    found = repeated_spans(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


# --- 5: near copies --------------------------------------------------------------------------


@query("op5_ngram_join")
def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """The component of every document under links of Jaccard similarity 0.8 or more."""
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


# --- 6: benchmark passages -------------------------------------------------------------------


@query("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item."""
    found = benchmark_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "overlap", "answer", "similarity", "at")


# --- 7: shards -------------------------------------------------------------------------------


@query("op7_hilbert_shards")
def op7_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen shards of all documents, in curve order of language, source and length."""
    sharded = hilbert_shards(table(spark, folder, "documents"))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert")


# --- 8: URL filters --------------------------------------------------------------------------

#: (action, host, path)
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


@query("op8_url_filter", r"""
with rules(action, rh, rp) as (values
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
urls as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
found as (
  select page_id, host, path, rh || rp as rule, action,
         row_number() over (partition by page_id order by length(rh) desc nulls last, length(rp) desc) as place
  from urls left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from found where place = 1
""")
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The fixed rules on every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return filter_urls(table(spark, folder, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


# --- 9: page texts ---------------------------------------------------------------------------


@query("op9_html_text")
def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page, by its host's wrapper."""
    found = extract_pages(table(spark, folder, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", "n_chars")


# --- 10: mixing ------------------------------------------------------------------------------

#: Wanted shares of tokens. What is not named counts together.
MIX_TARGETS = {
    "source": {f"src{i}": 0.05 for i in range(20)},
    "lang": {"en": 0.55, "de": 0.17, "es": 0.11, "fr": 0.17},
    "topic": {"general": 0.9, "licence": 0.04, "access": 0.02, "contact": 0.04},
}
#: Share of all tokens that is sampled.
MIX_FRACTION = 0.5


@query("op10_mix_targets")
def op10_mix_targets(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_to_targets(table(spark, folder, "documents"), MIX_TARGETS, MIX_FRACTION)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled")


# --- 11: licenses ----------------------------------------------------------------------------


def _license_sql() -> str:
    """Every window against every template, without an index."""
    templates = [(k, t, [w for w in t.words() if w]) for k, t in enumerate([*PHRASES, *NOTICES])]
    core = max(len(w) for _, _, w in templates)
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ",\n    ".join(
        f"({k}, '{t.label}', {quoted(w)}, {len(set(w))}, {wanted(len(set(w)), 1.0) if t.phrase else wanted(len(set(w)))}, "
        f"{str(t.phrase).lower()}, {str(k < len(PHRASES)).lower()})"
        for k, t, w in templates
    )
    return rf"""
with templates(k, label, phrase, size, share, is_phrase, is_base) as (values
    {rows}),
texts as materialized (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from documents),
windows as materialized (
  select doc_id, u.p0, list_slice(words, u.p0 + 1, u.p0 + {2 * core}) as w
  from texts, unnest(range(0, greatest(len(words), 1), {core})) as u(p0) where len(words) > 0),
pairs as materialized (
  select doc_id, p0, w, k, label, phrase, size, is_phrase, is_base, len(list_intersect(list_distinct(w), list_distinct(phrase))) as overlap
  from windows, templates where len(list_intersect(list_distinct(w), list_distinct(phrase))) >= share),
found as (
  select *, case when is_phrase then list_filter(range(p0, p0 + least({core}, len(w))),
              lambda p: list_slice(w, p - p0 + 1, p - p0 + len(phrase)) = phrase) end as places
  from pairs),
hits as (select * from found where not is_phrase or len(places) > 0),
marks as (
  select doc_id, sum(len(places)) filter (where is_base)::bigint as n_base, min(list_min(places)) filter (where is_base)::bigint as first_word,
         max(list_max(places)) filter (where is_base)::bigint as last_word,
         array_to_string(list_sort(list(distinct label) filter (where is_base)), ',') as base_labels,
         array_to_string(list_sort(list(distinct label)), ',') as labels, max(overlap::double / size) as score
  from hits group by doc_id)
select t.doc_id, len(t.words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from texts t left join marks m on t.doc_id = m.doc_id
"""


@query("op11_license_scan", _license_sql())
def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices in every text."""
    found = license_scan(table(spark, folder, "documents"), PHRASES, NOTICES)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


# --- 12: hard negatives ----------------------------------------------------------------------

_FINITE_SQL = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


@query("op12_hard_negatives", f"""
with kept as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and {_FINITE_SQL}),
scores as materialized (
  select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as alike, list_dot_product(a.v, r.v)::bigint as score
  from kept a join kept r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, id as positive_id, score as positive_score
  from (select *, row_number() over (partition by anchor_id order by score desc, id) as place from scores where alike) where place <= 5),
negatives as (
  select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::int as rank,
         id as negative_id, positive_score, score as negative_score
  from positives p join scores s on p.anchor_id = s.anchor_id and not alike
   and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select * from negatives where rank <= 10
""")
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of another label that score between 30 and 90 % of an anchor's positives."""
    rows = table(spark, folder, "embeddings").filter(usable(F.col("embedding")) & F.col("label").isNotNull()).select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        scaled(F.col("embedding"), 256).alias("vector"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


# --- 13: vector codes ------------------------------------------------------------------------


def _codes_sql(rounds: int = 6) -> str:
    """The rounds one after another, every part against every entry."""
    near = """
near{k} as materialized (
  select r, p, e, d from (
    select r, p, e, d, row_number() over (partition by r, p order by d, e) as place from (
      select t.r, t.p, b.e, coalesce(list_sum(list_transform(list_zip(t.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0)::bigint as d
      from points t join books{k} b on t.p = b.p)) where place = 1),"""
    update = """
sums{k} as (
  select p, e, i, sum(t.x[i])::bigint as s, count(*) as n from near{k} join points t using (r, p), unnest(range(1, len(t.x) + 1)) as u(i) group by p, e, i),
books{next} as materialized (
  select b.p, b.e, coalesce(m.c, b.c) as c from books{k} b left join (
    select p, e, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from sums{k} group by p, e) m on b.p = m.p and b.e = m.e),"""
    steps = "".join(near.format(k=k) + update.format(k=k, next=k + 1) for k in range(rounds)) + near.format(k=rounds)
    return f"""
with kept as materialized (
  select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v
  from embeddings where {_FINITE_SQL}),
points as materialized (
  select r, u.p, list_slice(v, u.p * (len(v) // 8) + 1, (u.p + 1) * (len(v) // 8)) as x from kept, unnest(range(0, 8)) as u(p)),
books0 as materialized (select p, r - 1 as e, x as c from points where r <= 16),
{steps}
codes as (
  select r, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from near{rounds} group by r),
digest as (
  select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from books{rounds})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
from kept join codes using (r), digest
"""


@query("op13_vector_codes", _codes_sql())
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all vectors with codebooks learned from all of them."""
    rows = table(spark, folder, "embeddings").filter(usable(F.col("embedding"))).select(
        F.col("vec_id").alias("id"), "label", scaled(F.col("embedding"), 4096).alias("vector"))
    rows = stored(rows, "vectors")  # read by every round
    books = train_codebooks(rows)
    coded = stored(encode(rows, books), "codes")
    # Nulls in a struct are equal to each other.
    keyed = coded.withColumn("group", F.struct("label"))
    sums = keyed.groupBy("group").agg(F.sum("error").alias("label_error"))
    return lookup_join(keyed, sums, ["group"]).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


# --- the pipeline ----------------------------------------------------------------------------


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
