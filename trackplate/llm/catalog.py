"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, brown, hardneg, hostrules, jaccard, langid, linecrf, linededup, mixing, secrets, variants, vectordup, warc
from .common import id_remainder, table
from .registry import query


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_secrets")
def op1_secrets(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE]

    def told(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def n_of(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(n_of, base),
        F.sha2(told(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"))


WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

LINES_SQL = f"""
with l as (select doc_id, i - 1 as line, {WORDS_SQL.replace("text", "lower(x[i])")} as w from (
             select doc_id, x, unnest(range(1, len(x) + 1)) as i from (select doc_id, string_split(text, chr(10)) as x from documents))),
s as (select doc_id, line, list_sort(list_distinct(w)) as w from l where len(w) > 0),
c as (select w, min(struct_pack(d := doc_id, l := line)) as pos, len(w) as n from s group by w),
t as (select pos, n, unnest(w) as token from c),
gone as (select distinct y.pos from t x join t y on x.token = y.token and x.pos < y.pos and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
         group by x.pos, y.pos, x.n, y.n having 9 * count(*) >= 4 * (x.n + y.n)),
k as (select pos.d as doc_id, count(*) as kept from c where pos not in (select pos from gone) group by 1),
n as (select doc_id, count(*) as n_lines from s group by doc_id),
x as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(0, len(string_split(text, chr(10))))) as line from documents),
stay as (select pos.d as d, pos.l as l from c where pos not in (select pos from gone)),
r as (select doc_id, sha256(string_agg(x, chr(10) order by line)) as text_sha256 from x left join stay on d = doc_id and l = line
      where d is not null or not regexp_matches(x, '[^\\x20\\x09-\\x0D]') group by 1)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, (coalesce(n_lines, 0) - coalesce(kept, 0))::bigint as n_removed,
  case when text is not null then coalesce(text_sha256, sha256('')) end as text_sha256
from documents left join n using (doc_id) left join k using (doc_id) left join r using (doc_id)
"""


@query("op2_line_dedup", LINES_SQL)
def op2_line_dedup(spark, sf_dir):
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.sha2("text", 256).alias("text_sha256"))


HOST_SQL = f"""
with d as (select doc_id, source, coalesce(text, '') as text, {WORDS_SQL} as w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
win as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n
        from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
rep as (select doc_id, count(distinct i + k) as n from win, (values (0), (1), (2)) as t(k) where n > 1 group by doc_id),
c as (select d.doc_id, source, len(w)::bigint as n_words, len(array_to_string(w, ''))::bigint as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, len(l)::bigint as n_lines,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
      from d left join rep using (doc_id)),
f as (select source, rule, count(*) as docs, sum(failed::int) as failed from (
        unpivot (select source, {", ".join(f"({r}) as {n}" for n, r in hostrules.RATED.items())} from c)
        on {", ".join(hostrules.RATED)} into name rule value failed) group by source, rule),
m as (select rule, avg(failed / docs) as mean, var_pop(failed / docs) as var from f group by rule),
b as (select f.source, f.rule, (failed + mean * s) / (docs + s) > least({hostrules.HOST_LIMIT}::double, mean + {hostrules.HOST_SPREADS}::double * sqrt(mean * (1 - mean) / (s + 1))) as binds from f join
        (select *, case when var > 0 then least({hostrules.MOST_STRENGTH}, greatest({hostrules.LEAST_STRENGTH}, mean * (1 - mean) / var - 1))
                   else {hostrules.MOST_STRENGTH} end as s from m) m on f.rule = m.rule),
h as (select source, {", ".join(f"bool_or(binds and rule = '{n}') as binds_{n}" for n in hostrules.RATED)} from b group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (
    {" or ".join(f"((binds_{n} or binds_base) and ({r}))" for n, r in hostrules.RULES.items())}) as kept
from c join h on c.source is not distinct from h.source
"""


@query("op3_host_rules", HOST_SQL)
def op3_host_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return hostrules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_sorted_projections")
def op4_sorted_projections(spark, sf_dir):
    return vectordup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op5_jaccard_join")
def op5_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


WARC_SQL = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) else page_id end as kept from p)
select page_id, payload_bytes, payload_digest, case when page_id = kept then 'response' else 'revisit' end as record_type,
  case when page_id <> kept then kept end as refers_to from m
"""


@query("op6_warc_merge", WARC_SQL)
def op6_warc_merge(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_language_id")
def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(id_remainder("doc_id", 4) != 2))
    return langid.identify(docs.drop("lang"), model).select(
        "doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


MIX_SQL = f"""
with d as (select doc_id, source, size, -ln((('0x' || substr(md5(doc_id::varchar), 1, 12))::bigint + 0.5) / 281474976710656.0)
             / (1 - least(1.0, coalesce(symbols::double / nullif(size, 0), 1.0)) / 2) as key
           from (select doc_id, source, len({WORDS_SQL})::bigint as size,
                   len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) as symbols from documents)),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, (array[3, 1, 2])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from s),
q as (select *, {mixing.SHARE} * sum(source_size) over () - 2 * coalesce(sum(source_size) over (
        order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
        sum(w) over (order by source_size / w, source nulls last rows between current row and unbounded following) as open from w),
v as (select source, source_size, w, rest, open, rest * w <= 2 * source_size * open as fits,
        row_number() over (order by source_size / w, source nulls last) as k from q),
l as (select arg_min(rest, k) as rest, arg_min(open, k) as open, min(k) as k from v where fits),
t as (select source, source_size, case when v.k >= l.k then w * l.rest::double / l.open::double else 2.0 * source_size end as target from v, l),
e as (select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs from t)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::bigint - epochs * source_size - before)))::bigint as taken
from (select d.*, source_size, target, epochs, coalesce(sum(size) over (partition by d.source order by key, doc_id::varchar
        rows between unbounded preceding and 1 preceding), 0) as before
      from d join e on d.source is not distinct from e.source)
"""


@query("op8_source_mix", MIX_SQL)
def op8_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_line_quality")
def op9_line_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = id_remainder("doc_id", 3) != 1
    chain = linecrf.train(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return linecrf.quality(docs, chain).select(
        "doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op10_bpe")
def op10_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_digests(docs, vocabulary_file()).drop("text")


#: crc32 of the UTF-8 bytes of `keyed`, from the table of its polynomial.
CRC_SQL = """
tab as (select list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, i:
          case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as crc_of),
crc as (select keyed, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(strlen(keyed)), lambda i:
          ('0x' || substr(hex(encode(keyed)), 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, crc_of[xor(c & 255, b) + 1]))) as h from k, tab)
"""

VARIANT_SQL = f"""
with recursive r as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as run from documents),
d as (select coalesce(doc_id::varchar, '') || ':' || run as keyed, run, count(*) as n from r group by 1, 2),
k as (select keyed from d),
{CRC_SQL},
o as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n
      from d join crc using (keyed)),
v as (select word, sum(n)::bigint as n from o where length(word) >= 5 group by word having sum(n) >= 3),
c as (select word, n, i, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) as gap, substr(word, 1, i - 1) || substr(word, i + 1) as less
      from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
e as (select a.word, b.word as other, b.n from c a join c b on a.gap = b.gap and a.word <> b.word
      union select c.word, v.word, v.n from c join v on c.less = v.word
      union select v.word, c.word, c.n from c join v on c.less = v.word),
b as (select word, count(*) as n_near, arg_min(struct_pack(other := other, n := n), struct_pack(a := -n, b := other)) as best from e group by word),
f as (select v.word, v.n, case when best.n >= 2 * v.n then best.other end as form, case when best.n >= 2 * v.n then best.n end as form_n,
        coalesce(n_near, 0)::bigint as n_near from v left join b on v.word = b.word),
p(word, step) as (select word, word from f union all select p.word, f.form from p join f on f.word = p.step where f.form is not null)
select f.word, f.n, f.form, f.form_n::bigint as form_n, f.n_near, p.step as root
from f join p on p.word = f.word join f ends on ends.word = p.step and ends.form is null
"""


@query("op11_spelling_variants", VARIANT_SQL)
def op11_spelling_variants(spark, sf_dir):
    found = variants.runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc").cast("string"), F.lit("")), F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    typed = F.when(F.col("h") % 97 == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return variants.group_variants(found.withColumn("h", h).select(typed.alias("word")))


@query("op12_brown_lm")
def op12_brown_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder("doc_id", 7) == 2
    return brown.class_scores(docs, ~held_out).select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


NEGATIVE_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
           from embeddings where label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s as (select a.vec_id as anchor_id, v.vec_id as id, a.label = v.label as same, list_dot_product(a.q, v.q)::bigint as score
      from v a join v on a.vec_id <> v.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank,
  id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 100 * score between 30 * positive_score and 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 10
"""


@query("op13_hard_negatives", NEGATIVE_SQL)
def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hardneg.whole_numbers(rows.withColumn("label", label), "embedding", 256)
    return hardneg.hard_negatives(vectors, F.col("vec_id") % 100 == 0, vector="embedding").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
