"""Named queries of this folder, one per operator, with SQL for DuckDB where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm import bpe, decontaminate, lines, machine, mixing, negatives, pii, repeats, search, secrets, simhash, urls, warc
from docaudit.llm.common import table, written
from docaudit.session import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = lines.line_first(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[F.col("quality")[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines",
        "n_lines_removed", "words_removed", "kept")])


_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES["op10_line_quality"] = rf"""
with doc as (select row_number() over () as rn, doc_id, coalesce(text, '') as txt from documents),
word as (select rn, doc_id, txt, [x for x in string_split_regex(txt, '[\x20\x09-\x0D]+') if x <> ''] as w from doc),
place as (select rn, w, unnest(range(1, len(w) - 3)) as i from word where len(w) >= 5),
again as (select rn, i, count(*) over (partition by rn, list_slice(w, i, i + 4)) as c from place),
covered as (select rn, least(5, i - lag(i, 1, -5) over (partition by rn order by i)) as n from again where c > 1),
repeats as (select rn, sum(n)::bigint as n_repeat_words from covered group by rn),
line0 as (select rn, unnest(string_split(txt, chr(10))) as line, unnest(range(len(string_split(txt, chr(10))))) as i from doc),
line1 as (select rn, line, i, row_number() over (partition by rn, line order by i) as nth, trim(line, {_CHARS}) as s from line0),
line2 as (select *, string_split_regex(s, '[\x20\x09-\x0D]+') as w from line1 where s <> ''),
line3 as (select rn, line, nth, len(w) as n,
    len(regexp_extract_all(s, '[#*$%&<>~^]{{2,}}|!{{2,}}')) as noise,
    len(string_split_regex(s, ' [|»•·>] ')) as pieces, len(list_distinct(w)) as kinds,
    regexp_matches(s, '{lines.BOILERPLATE}') as furniture from line2),
line4 as (select *, (noise >= 2 and noise * 3 >= n) or (pieces >= 4 and n <= 4 * pieces) or furniture
    or (n >= 10 and kinds * 4 < n) or nth > 1 as gone from line3),
lines as (select rn, count(*) as n_lines, count(*) filter (gone) as n_lines_removed,
    coalesce(sum(n) filter (gone), 0)::bigint as words_removed, count(*) filter (nth > 1) as n_dup_lines from line4 group by rn),
counts as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(txt, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines,
    coalesce(n_lines_removed, 0)::bigint as n_lines_removed, coalesce(words_removed, 0)::bigint as words_removed
    from word left join repeats using (rn) left join lines using (rn)),
failed as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts)
select *, not base_failed and words_removed <= 0.5 * n_words as kept from failed
"""


@query
def op7_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


#: The contract's rules.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/"))


@query
def op9_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


ORACLES["op9_url_template_tree"] = rf"""
with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
split as (select page_id, regexp_extract(rest, '^[^/?#]*') as h, rest from cut),
page as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from split),
fit as (select *, (host = 'com' or suffix(host, '.com')) as com, (host = 'net' or suffix(host, '.net')) as net,
    (host = 'example.com' or suffix(host, '.example.com')) as ex, (host = 'www.example.com' or suffix(host, '.www.example.com')) as www from page),
ruled as (select page_id, host, path, case when www and starts_with(path, '/en/') then 'www.example.com/en/'
    when ex and starts_with(path, '/en/') then 'example.com/en/' when net and starts_with(path, '/es/') then 'net/es/'
    when net and starts_with(path, '/fr/') then 'net/fr/' when com and starts_with(path, '/') then 'com/' end as rule from fit),
seen as (select *, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' end as ruled,
    [case when regexp_matches(x, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$') then '{{uuid}}'
    when regexp_matches(x, '^[0-9a-fA-F]{{8,}}$') and regexp_matches(x, '[0-9]') and regexp_matches(x, '[a-fA-F]') then '{{hex}}'
    else regexp_replace(x, '[0-9]+', '{{n}}', 'g') end for x in string_split(path, '/')] as form from ruled),
forms as (select host, form, count(*) as pages, count(*) filter (ruled = 'allow') as good, count(*) filter (ruled = 'block') as bad
    from seen group by 1, 2),
places as (select *, unnest(form) as segment, unnest(range(len(form))) as i from forms),
step as (select *, array_to_string(form[1:i], '/') as parent from places),
child as (select host, i, parent, segment, sum(pages) as pages, sum(good) as good, sum(bad) as bad from step group by all),
kinds as (select *, count(*) over w as children, sum(pages) over w as all_pages, sum(good) over w as g, sum(bad) over w as b
    from child window w as (partition by host, i, parent)),
tested as (select *, case when good + bad > 0 and g + b - good - bad > 0 then
    pow(good / (good + bad) - (g - good) / (g + b - good - bad), 2) > {urls.CRITICAL} * (g / (g + b)) * (1 - g / (g + b))
    * (1 / (good + bad) + 1 / (g + b - good - bad)) else true end as apart from kinds),
tokens as (select host, i, parent, segment, case when children >= {urls.WIDE} and 2 * children >= all_pages then '*'
    when not apart then '{{alike}}' else segment end as token from tested),
tree as (select host, form, any_value(good) as good, any_value(bad) as bad, string_agg(token, '/' order by i) as template
    from step join tokens using (host, i, parent, segment) group by 1, 2),
pure as (select host, template, (sum(good) + 1) / (sum(good) + sum(bad) + 2) as purity from tree group by 1, 2)
select page_id, host, path, rule, template, purity,
    coalesce(ruled, case when purity < {urls.MIN_PURITY} then 'block' else 'allow' end) as verdict
from seen join tree using (host, form) join pure using (host, template)
"""


@query
def op5_warc_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    warc.write_archives(pages, folder)
    index = written(warc.index_archives(spark, folder), "warc-index")
    read = warc.read_records(index, payloads=False)
    key = pages.schema["page_id"].dataType
    return read.select(F.col("id").cast(key).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
                       F.col("type").alias("record_type"), F.col("refers_to").cast(key).alias("refers_to"))


ORACLES["op5_warc_by_index"] = """
with page as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes,
    sha1(coalesce(html, '')) as payload_digest from pages),
best as (select payload_digest, max(page_id) as best from page where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, payload_digest,
    case when page_id < best then 'revisit' else 'response' end as record_type,
    case when page_id < best then best end as refers_to
from page left join best using (payload_digest)
"""


@query
def op3_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    model = machine.train(docs, labels, learn=~held_out)
    return machine.score(docs, model).select(
        F.col("id").alias("doc_id"), held_out.alias("held_out"), "score",
        (F.col("score") >= machine.THRESHOLD).cast("int").alias("predicted"))


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "cover", "exact")


@query
def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    shares = [F.col("p")[k].alias(f"p_{name}") for k, name in enumerate(mixing.DOMAINS)]
    return mixed.select(F.col("id").alias("doc_id"), "tokens", *shares, "rate", "copies")


#: The key of these queries. A deployment passes its own and keeps it secret.
PSEUDONYM_KEY = "docaudit pseudonyms, demonstration key"


@query
def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return found.select("doc_id", F.col("pii.text").alias("text"), *[
        F.col("pii")[f"n_{kind}"].alias(f"n_{kind}") for kind, _ in pii.KINDS])


@query
def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return tokens.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


@query
def op12_lemp_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


ORACLES["op12_lemp_negatives"] = """
with given as (select vec_id::bigint as id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, embedding from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0
    and len([x for x in embedding if x is not null and isfinite(x::double)]) = len(embedding)),
item as (select id, label, [floor(256 * x::double) for x in embedding] as v from given),
anchor as (select * from item where id % 100 = 0),
pair as (select a.id as anchor_id, b.id as other, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
    from anchor a join item b on a.id <> b.id),
positive as (select anchor_id, other as positive_id, score as positive_score from pair where same
    qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, other))::int as rank,
    other as negative_id, positive_score, score as negative_score
from positive join pair using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, other) <= 10
"""


@query
def op13_presence_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


ORACLES["op13_presence_masks"] = r"""
with low as (select 'd' as side, doc_id as id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
    union all select 'i', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
word as (select side, id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from low),
posting as (select id as doc_id, term, count(*) as tf from word where side = 'd' group by 1, 2),
doc as (select doc_id, sum(tf)::bigint as n from posting group by 1),
total as (select count(*)::bigint as docs, sum(n)::bigint as terms from doc),
weight as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from posting, total group by term, docs),
part as (select doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)) as x
    from posting join doc using (doc_id), total),
score as (select id as item_id, doc_id, sum(w * x)::bigint as score
    from (select distinct id, term from word where side = 'i') join weight using (term) join part using (term) group by 1, 2)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from score where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""
