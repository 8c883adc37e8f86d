"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, license_scan, lz_fingerprint, mixing, near_dedup, ngram_model, piece_tokens, ppm_language, suffix_dedup, token_counts, topk, vector_codes, warc
from .common import crc_of_id, read_table


def op1_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_of_id() % 7 == 2
    found = ngram_model.score(docs, ngram_model.train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score")


def op6_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_of_id() % 4 == 2
    tables = ppm_language.fit(ppm_language.gram_counts(docs.where(~held_out)))
    return ppm_language.classify(docs, tables).withColumn("held_out", held_out)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of a document: a directory for each source, in it one for each thousand and hundred ids; ids divisible by 100 are licence files."""
    docs, number = read_table(spark, sf_dir, "documents"), F.col("doc_id")
    thousand, hundred = F.floor(number / 1000), F.floor(number / 100)
    folder = F.concat(F.lit("/"), F.coalesce("source", F.lit("unknown")), F.lit("/"), thousand, F.lit("/"))
    of_folder, of_part = F.concat(folder, F.lit("LICENSE")), F.concat(folder, hundred, F.lit("/LICENSE"))
    path = F.when(number % 1000 == 0, of_folder).when(number % 100 == 0, of_part).otherwise(F.concat(folder, hundred, F.lit("/"), number, F.lit(".txt")))
    found = license_scan.scan(docs.select(F.col("doc_id").alias("row"), path.alias("path"), "text"))
    return found.select(F.col("row").alias("doc_id"), "path", "license", "similarity", "license_from", "license_path")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_members(warc.archive(read_table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op10_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_tokens.token_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.encode(read_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fits_chars: how many characters of the text take 1024 tokens at most."""
    import public_tokenizers

    found = token_counts.table(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.longest_within(found, "1024").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "fits_chars")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.best(collocations.phrases(read_table(spark, sf_dir, "documents")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_MIX = f"""
with d as (select doc_id, source, {_SIZE}::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from d group by source),
w as (select *, [3, 1, 2][((place - 1) % 3 + 1)::int]::double as weight, (source_size * 2)::double as most from s),
r as (select *, most / weight as ratio, row_number() over (order by most / weight, source nulls last) as pos, (sum(source_size) over ())::double * 1.5 as whole from w),
l as (select *, (whole - coalesce(sum(most) over (order by pos rows between unbounded preceding and 1 preceding), 0.0))
         / sum(weight) over (order by pos rows between current row and unbounded following) as level from r),
f as (select *, (select arg_min(level, pos) from l where level <= ratio) as common from l),
t as (select source, source_size, case when common is null then most else least(most, common * weight) end as target from f),
c as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
        ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0 as u
      from d join t on d.source is not distinct from t.source),
n as (select *, (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end)::bigint as copies from c)
select doc_id, size, source_size, target, size * copies as taken, copies from n
"""

_TOPK = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint as score
      from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""

_WARC = """
with p as (select page_id, url, octet_length(encode(coalesce(html, '')))::bigint as n, sha1(coalesce(html, '')) as digest from pages),
r as (select *, case when n >= 1000 then max(page_id) over (partition by digest) end as first_id from p)
select page_id, n as payload_bytes, digest as payload_digest, case when first_id > page_id then 'revisit' else 'response' end as record_type,
       case when first_id > page_id then first_id end as refers_to, url from r
"""


_SUFFIX = """
with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
w as (select doc_id, unnest(list_transform(range(n - 99), lambda s: {'s': s, 'k': md5(b[s + 1 : s + 100])})) as w from d where n >= 100),
f as (select k, min((doc_id::hugeint << 40) + s) as earliest from (select doc_id, w.s as s, w.k as k from w) group by k having count(*) > 1),
later as (select doc_id, w.s as s from w join f on w.k = f.k where (doc_id::hugeint << 40) + w.s > earliest),
runs as (select doc_id, s, sum(case when s > before + 100 or before is null then 1 else 0 end) over (partition by doc_id order by s) as run
         from (select doc_id, s, lag(s) over (partition by doc_id order by s) as before from later)),
spans as (select doc_id, min(s) as a, max(s) + 100 as z from runs group by doc_id, run),
edges as (select doc_id, list(a order by a) as starts, list(z order by a) as stops, count(*) as n_spans, sum(z - a)::bigint as n_removed from spans group by doc_id)
select d.doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(case when n_spans is null then b else unhex(array_to_string(list_transform(range(len(starts) + 1),
    lambda i: hex(b[case when i = 0 then 1 else stops[i] + 1 end : case when i = len(starts) then n else starts[i + 1] end])), '')) end) as kept_sha256
from d left join edges using (doc_id)
"""


_CODE_ROUND = """
d{k} as (select p.part, p.vec_id, p.x, b.entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::bigint as far from p join b{k} b on b.part = p.part),
a{k} as materialized (select * from d{k} qualify row_number() over (partition by part, vec_id order by far, entry) = 1),
s{k} as (select part, entry, pos, sum(x[pos])::hugeint as s, count(*)::hugeint as n from a{k}, range(1, (select max(len(x)) from p) + 1) t(pos) group by part, entry, pos),
m{k} as (select part, entry, list(((s - ((s % n) + n) % n) // n)::bigint order by pos) as c from s{k} group by part, entry),
b{next} as materialized (select b.part, b.entry, coalesce(m.c, b.c) as c from b{k} b left join m{k} m on m.part = b.part and m.entry = b.entry),
"""

_CODES = f"""
with v as (select vec_id, label, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, label, part, e[part * (len(e) // 16) + 1 : (part + 1) * (len(e) // 16)] as x from v, range(16) t(part)),
b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x as c from p qualify entry < 64),
{_CODE_ROUND.format(k=0, next=1)}{_CODE_ROUND.format(k=1, next=2)}{_CODE_ROUND.format(k=2, next=3)}
h as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from b2),
r as (select vec_id, string_agg(format('{{:02x}}', entry), '' order by part) as code, sum(far)::bigint as error from a2 group by vec_id)
select r.vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from r join v using (vec_id), h
"""

_COLLOCATIONS = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
s as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
x as (select lang, unnest(list_transform(range(len(w)), lambda i: {'a': w[i + 1], 'b': w[i + 2], 'c': w[i + 3]})) as x from s),
w as materialized (select lang, x.a as a, x.b as b, x.c as c from x),
n as (select lang, count(*) as n from w group by lang),
one as materialized (select lang, a, count(*) as f from w group by lang, a),
two as materialized (select lang, a, b, count(*) as f from w where b is not null group by lang, a, b having count(*) >= 10),
three as materialized (select lang, a, b, c, count(*) as f from w where c is not null group by lang, a, b, c having count(*) >= 10),
longer as (select lang, a, b, max(f) as longest from (select lang, a, b, f from three union all select lang, b, c, f from three) group by lang, a, b),
cuts as (select t.lang, t.a || ' ' || t.b as phrase, 1 as k, t.f as a, x.f as l, y.f as r from two t join one x on x.lang = t.lang and x.a = t.a join one y on y.lang = t.lang and y.a = t.b
           left join longer g on g.lang = t.lang and g.a = t.a and g.b = t.b where longest is null or 100 * longest < 50 * t.f
         union all select t.lang, t.a || ' ' || t.b || ' ' || t.c, 1, t.f, x.f, y.f from three t join one x on x.lang = t.lang and x.a = t.a join two y on y.lang = t.lang and y.a = t.b and y.b = t.c
         union all select t.lang, t.a || ' ' || t.b || ' ' || t.c, 2, t.f, x.f, y.f from three t join two x on x.lang = t.lang and x.a = t.a and x.b = t.b join one y on y.lang = t.lang and y.a = t.c),
scored as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cuts),
least_cut as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank from least_cut)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": _SUFFIX, "op3_mixing": _MIX, "op5_topk": _TOPK, "op9_warc": _WARC, "op11_vector_codes": _CODES, "op13_collocations": _COLLOCATIONS}
