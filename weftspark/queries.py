"""The registered queries of the texture and package operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import channels, names
from .operators import activity, blocks, catalog, raster, scanlines, sets
from .plans import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inputs: a file listing from part, texels and planes from embeddings, packages from orders and customer, events as they are.


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = """concat('/lib/', case when p_size % 9 = 0 then 'B' else 'a' end, cast(p_partkey div 4 as string),
      case p_size % 4 when 0 then '_' when 1 then '-' when 2 then ' ' else '__' end,
      case p_partkey % 4 when 0 then 'BaseColor' when 1 then 'ROUGHNESS' when 2 then 'metallic' else 'Normal' end,
      case p_size % 5 when 0 then '.png' when 1 then '.TGA' when 2 then '.jpg' when 3 then '.jpeg' else '.bmp' end)"""
    return table(spark, sf_dir, "part").select(F.expr(path).alias("path"), F.col("p_partkey").alias("ord"))


_LISTING = """listing as (select concat('/lib/', case when p_size % 9 = 0 then 'B' else 'a' end, cast(p_partkey // 4 as varchar),
      case p_size % 4 when 0 then '_' when 1 then '-' when 2 then ' ' else '__' end,
      case p_partkey % 4 when 0 then 'BaseColor' when 1 then 'ROUGHNESS' when 2 then 'metallic' else 'Normal' end,
      case p_size % 5 when 0 then '.png' when 1 then '.TGA' when 2 then '.jpg' when 3 then '.jpeg' else '.bmp' end) as path, p_partkey as ord from part)"""
_FILES = _LISTING + """, files as (select *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)[.][^.]*$', '\\1') as stem from listing
  where lower(regexp_extract(path, '[.]([^./]*)$', 1)) in ('png', 'tga', 'jpg', 'jpeg'))"""
_SETS = _FILES + """, kinds as (select *, regexp_extract(lower(stem), '(basecolor|roughness|metallic|normal)$', 1) as kind from files),
  named as (select *, regexp_replace(substr(stem, 1, length(stem) - length(kind)), '[_ -]+$', '') as prefix from kinds where kind <> ''),
  sets as (select prefix, max(path) filter (kind = 'basecolor') as basecolor, max(path) filter (kind = 'roughness') as roughness,
    max(path) filter (kind = 'metallic') as metallic, max(path) filter (kind = 'normal') as normal from named group by prefix
    having basecolor is not null and roughness is not null and metallic is not null and normal is not null)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((F.col("e").cast("double") + 0.5) * 255))).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e")).select("vec_id", "p", v.alias("v"))


def _value(e: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((e.cast("double") + 0.5) * 255))).cast("int")


def set_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one 4 x 4 raster for each vector, four vectors to a set: base colour, roughness, metallic, normal."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", _value).alias("v")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(3))))
    sample = lambda k: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda x: F.get("v", (F.col("y") * 4 + x) * 4 + k))
    return rows.select(F.floor(F.col("vec_id") / 4).alias("texture_id"), (F.col("vec_id") % 4).alias("part"), "y", *[sample(k).alias(c) for k, c in enumerate("rgba")])


def raster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rasters, each on its own."""
    return set_lines(spark, sf_dir).withColumn("texture_id", F.col("texture_id") * 4 + F.col("part")).drop("part")


def plane_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one 8 x 8 plane for each vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("texture_id"), F.transform("embedding", _value).alias("all"))
    return rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("texture_id", "y", F.slice("all", F.col("y") * 8 + 1, F.lit(8)).alias("v"))


def texels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = set_lines(spark, sf_dir).withColumn("texture_id", F.struct("texture_id", "part"))
    return scanlines.texels(lines, tuple("rgba")).select("texture_id.texture_id", "texture_id.part", "y", "x", *"rgba")


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanlines.texels(raster_lines(spark, sf_dir), tuple("rgba"))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanlines.texels(plane_lines(spark, sf_dir), ("v",))


_SAMPLES = "samples as (select vec_id, i - 1 as p, least(255, greatest(0, floor((embedding[i]::double + 0.5) * 255)))::int as v from embeddings, (select unnest(range(1, 65)) as i))"
_TEXELS = _SAMPLES + """, texels as (select vec_id // 4 as texture_id, vec_id % 4 as part, (p // 16)::int as y, (p // 4 % 4)::int as x,
  max(v) filter (p % 4 = 0) as r, max(v) filter (p % 4 = 1) as g, max(v) filter (p % 4 = 2) as b, max(v) filter (p % 4 = 3) as a from samples group by all)"""
_PLANES = _SAMPLES + ", planes as (select vec_id as texture_id, (p // 8)::int as y, (p % 8)::int as x, v from samples)"
_RASTERS = _TEXELS + ", rasters as (select texture_id * 4 + part as texture_id, y, x, r, g, b, a from texels)"
_PACKED = _TEXELS + """, packed as (select n.texture_id, n.y, n.x, 255 - (2126 * s.r + 7152 * s.g + 722 * s.b) // 10000 as pr, n.g as pg,
  (2126 * m.r + 7152 * m.g + 722 * m.b) // 10000 as pb, n.r as pa from texels n join texels s using (texture_id, y, x) join texels m using (texture_id, y, x)
  where n.part = 3 and s.part = 1 and m.part = 2)"""


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("basecolor"), F.lit("roughness"), F.lit("metallic"), F.lit("normal")), (F.col("part") + 1).cast("int"))
    return scanlines.texels(scanlines.pack_maps(set_lines(spark, sf_dir).withColumn("kind", kind)), ("pr", "pg", "pb", "pa"))


@query(f"with {_SETS} select * from sets")
def texture_sets(spark, sf_dir):
    return sets.find_sets(listing(spark, sf_dir))


@query(f"with {_FILES} select path from files")
def image_filter(spark, sf_dir):
    return sets.image_files(listing(spark, sf_dir)).select("path")


def _numbered(spark, sf_dir):
    path = "concat('/mips/', p_partkey div 8, '/p', p_size % 7, case p_partkey % 4 when 0 then '.jpeg' when 1 then '.tga' when 2 then '.png' else '.txt' end)"
    return table(spark, sf_dir, "part").select(F.expr(path).alias("path"))


@query("""with f as (select '/mips/' || (p_partkey // 8) as dir, p_size % 7 as i, p_partkey % 4 as e from part where p_partkey % 4 < 3),
 b as (select dir, i, case max(e) when 2 then '.png' when 1 then '.tga' else '.jpeg' end as ext from f group by dir, i)
 select dir, i::int as i, dir || '/p' || i || ext as path, (row_number() over (partition by dir order by i) - 1)::int as level from b""")
def mip_sequence(spark, sf_dir):
    return sets.numbered_sequence(_numbered(spark, sf_dir))


@query(f"with {_TEXELS} select texture_id, y, x, r, g, b, 0 as a from texels where part = 0")
def merge_base_color(spark, sf_dir):
    return raster.merge_base_color(texels(spark, sf_dir).where("part = 0"), "keep")


@query(f"with {_PACKED} select * from packed")
def merge_packed_normal(spark, sf_dir):
    return _packed(spark, sf_dir)


@query(f"with {_PACKED}, {_SETS} select s.prefix, k.* from packed k join sets s on k.texture_id = regexp_extract(s.prefix, '([0-9]+)$', 1)::bigint")
def merge_sets(spark, sf_dir):
    """Flagship: packed normal maps of the complete texture sets."""
    found = sets.find_sets(listing(spark, sf_dir)).select("prefix", F.regexp_extract("prefix", "([0-9]+)$", 1).cast("bigint").alias("texture_id"))
    return _packed(spark, sf_dir).join(found, "texture_id")


@query(f"with {_RASTERS} select texture_id, y, x, r, g, b, a as alpha from rasters")
def split_color(spark, sf_dir):
    return raster.split_color(rasters(spark, sf_dir))


@query(f"with {_PACKED} select texture_id, y, x, 255 - pr as roughness, pb as metallic, pa as normal_r, pg as normal_g, 255 as normal_b, 255 as normal_a from packed")
def split_packed(spark, sf_dir):
    return raster.split_packed(_packed(spark, sf_dir).select("texture_id", "y", "x", F.col("pr").alias("r"), F.col("pg").alias("g"), F.col("pb").alias("b"), F.col("pa").alias("a")))


def _packed_names(spark, sf_dir):
    end = "case p_size % 6 when 0 then '_c' when 1 then '_n' when 2 then '_n_c' when 3 then '_c_n' when 4 then '_C_c' else '' end"
    return table(spark, sf_dir, "part").select(F.expr(f"concat('/in/t', p_partkey div 3, {end}, '.dds')").alias("path"), F.col("p_partkey").alias("ord"))


_NAMES = """names as (select '/in/t' || (p_partkey // 3) || case p_size % 6 when 0 then '_c' when 1 then '_n' when 2 then '_n_c' when 3 then '_c_n' when 4 then '_C_c' else '' end || '.dds' as path, p_partkey as ord from part),
 stems as (select *, regexp_extract(path, '([^/]*)[.]dds$', 1) as stem from names),
 outs as (select path, ord, regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '(_c)+$', ''), '(_C)+$', ''), '(_n)+$', ''), '(_N)+$', '') as prefix,
   unnest(case when lower(stem) like '%\\_c' escape '\\' then ['BaseColor', 'Alpha'] when lower(stem) like '%\\_n' escape '\\' then ['Roughness', 'Metallic', 'Normal'] else [] end) as channel from stems)"""


@query(f"with {_NAMES} select path, channel, prefix || '_' || channel || '.png' as name from outs")
def split_names(spark, sf_dir):
    return sets.split_outputs(_packed_names(spark, sf_dir)).drop("ord")


@query(f"with {_NAMES}, o as (select path, ord, prefix || '_' || channel || '.png' as name from outs) select name, arg_max(path, ord) as path, count(*) as inputs from o group by name")
def output_collisions(spark, sf_dir):
    files = _packed_names(spark, sf_dir)
    return sets.collisions(sets.split_outputs(files))


@query("""with f as (select '/in/' || (p_partkey % 300) || case p_size % 3 when 0 then '.v2' when 1 then '' else '.a.b' end || '.png' as path from part),
 s as (select path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)[.][^.]*$', '\\1') as stem from f) select path, regexp_replace(stem, '^(.+)[.][^.]*$', '\\1') || '.dds' as name from s""")
def convert_names(spark, sf_dir):
    path = F.expr("concat('/in/', p_partkey % 300, case p_size % 3 when 0 then '.v2' when 1 then '' else '.a.b' end, '.png')")
    return table(spark, sf_dir, "part").select(path.alias("path")).withColumn("name", names.convert_name(F.col("path")))


@query(f"with {_TEXELS} select texture_id, part, y, x, 0 as black, 255 as white, a as kept from texels")
def alpha_override(spark, sf_dir):
    mode = lambda m: channels.override_alpha(F.col("a"), m)
    return texels(spark, sf_dir).select("texture_id", "part", "y", "x", mode("black").alias("black"), mode("white").alias("white"), mode("keep").alias("kept"))


@query(f"with {_TEXELS} select texture_id, part, y, x, (2126 * r + 7152 * g + 722 * b) // 10000 as v from texels")
def luma(spark, sf_dir):
    return texels(spark, sf_dir).select("texture_id", "part", "y", "x", channels.luma(F.col("r"), F.col("g"), F.col("b")).alias("v"))


def _resample_sql(n: int, m: int) -> str:
    return f"""with {_PLANES}, w as (select o.o, i.i, 2 * greatest({n}, {m}) - abs((2 * i.i + 1) * {m} - (2 * o.o + 1) * {n}) as w from (select unnest(range({m})) as o) o, (select unnest(range({n})) as i) i
      where 2 * greatest({n}, {m}) - abs((2 * i.i + 1) * {m} - (2 * o.o + 1) * {n}) > 0)
      select texture_id, wy.o::int as y, wx.o::int as x, ((2 * sum(wx.w * wy.w * v) + sum(wx.w * wy.w)) // (2 * sum(wx.w * wy.w)))::int as v
      from planes join w wx on wx.i = planes.x join w wy on wy.i = planes.y group by texture_id, wy.o, wx.o"""


@query(_resample_sql(8, 5))
def resample_down(spark, sf_dir):
    return scanlines.texels(scanlines.resample(plane_lines(spark, sf_dir), 8, 5), ("v",))


@query(_resample_sql(8, 16))
def resample_up(spark, sf_dir):
    return scanlines.texels(scanlines.resample(plane_lines(spark, sf_dir), 8, 16), ("v",))


@query("""with l as (select vec_id // 4 as texture_id, (vec_id % 4)::int as level, case when vec_id // 4 % 7 = 3 and vec_id % 4 = 2 then 3 else greatest(1, 8 >> (vec_id % 4)::int) end as width, greatest(1, 8 >> (vec_id % 4)::int) as height from embeddings),
 e as (select *, greatest(1, first_value(width) over w >> level) as expected_width, greatest(1, first_value(height) over w >> level) as expected_height from l window w as (partition by texture_id order by level))
 select *, case when width <> expected_width or height <> expected_height then 'level ' || level || ': expected ' || expected_width || 'x' || expected_height || ', got ' || width || 'x' || height end as error from e""")
def mip_validate(spark, sf_dir):
    size = "greatest(1, shiftright(8, cast(vec_id % 4 as int)))"
    levels = table(spark, sf_dir, "embeddings").selectExpr("vec_id div 4 as texture_id", "cast(vec_id % 4 as int) as level", f"case when vec_id div 4 % 7 = 3 and vec_id % 4 = 2 then 3 else {size} end as width", f"{size} as height")
    return raster.mip_errors(levels)


@query("select p_partkey, ((p_size + 3) // 4 * ((p_partkey % 50 + 4) // 4) * 16)::bigint as bytes from part")
def bc3_size(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", channels.bc3_size(F.col("p_size"), F.col("p_partkey") % 50 + 1).alias("bytes"))


def _le(x: str) -> str:
    digits = f"lpad(printf('%X', ({x})::bigint), 8, '0')"
    return f"substr({digits}, 7, 2) || substr({digits}, 5, 2) || substr({digits}, 3, 2) || substr({digits}, 1, 2)"


_HEADER = " || ".join(
    ["'44445320'", _le("124"), _le("case when bc3 then 659463 else 135183 end"), _le("h"), _le("w"), _le("case when bc3 then (w + 3) // 4 * ((h + 3) // 4) * 16 else w * 4 end"), _le("0"), _le("n"), f"repeat('00', 44)", _le("32")]
    + [_le("case when bc3 then 4 else 65 end"), "case when bc3 then '44585435' else '00000000' end", _le("case when bc3 then 0 else 32 end"), "case when bc3 then repeat('00', 16) else 'FF00000000FF00000000FF00000000FF' end", _le("case when n > 1 then 4198408 else 4096 end"), "repeat('00', 16)"]
)


@query(f"with t as (select p_partkey, (p_size * 4)::bigint as w, (p_partkey % 64 + 1)::bigint as h, p_partkey % 5 + 1 as n, p_size % 2 = 0 as bc3 from part) select p_partkey, {_HEADER} as header from t")
def dds_header(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", raster.dds_header(F.col("p_size") * 4, F.col("p_partkey") % 64 + 1, F.col("p_partkey") % 5 + 1, F.col("p_size") % 2 == 0).alias("header"))


@query(f"with {_RASTERS} select texture_id, string_agg(printf('%02X%02X%02X%02X', r, g, b, a), '' order by y, x) as payload from rasters group by texture_id")
def dds_rgba8(spark, sf_dir):
    return raster.rgba8_payload(raster_lines(spark, sf_dir)).select("texture_id", F.hex("payload").alias("payload"))


@query(f"with {_TEXELS} select texture_id, count(distinct part)::int as levels, string_agg(printf('%02X%02X%02X%02X', r, g, b, a), '' order by part, y, x) as payload from texels group by texture_id")
def mip_payload(spark, sf_dir):
    t = set_lines(spark, sf_dir)
    level = t.withColumn("texture_id", F.struct("texture_id", "part"))
    one = raster.rgba8_payload(level).select(F.col("texture_id.texture_id").alias("texture_id"), F.col("texture_id.part").alias("level"), "payload")
    return raster.assemble_levels(one).select("texture_id", "levels", F.hex("payload").alias("payload"))


_ALPHA = """cells as (select texture_id, y // 4 as yb, x // 4 as bx, y % 4 * 4 + x % 4 as i, v from planes),
 ends as (select *, max(v) over w as a0, min(v) over w as a1 from cells window w as (partition by texture_id, yb, bx)),
 steps as (select *, case when a0 = a1 then 0 else (14 * (a0 - v) + (a0 - a1)) // (2 * (a0 - a1)) end as step from ends),
 alpha as (select texture_id, yb as "by", bx, max(a0) as a0, max(a1) as a1, sum((case when step = 0 then 0 when step = 7 then 1 else step + 1 end)::bigint << (3 * i))::bigint as a_bits from steps group by texture_id, yb, bx)"""


@query(f"with {_PLANES}, {_ALPHA} select * from alpha")
def bc3_alpha(spark, sf_dir):
    return raster.bc3_alpha(plane_lines(spark, sf_dir))


_COLOR = """box as (select texture_id, max(r) as hr, min(r) as lr, max(g) as hg, min(g) as lg, max(b) as hb, min(b) as lb,
   16 * sum(r * g) - sum(r) * sum(g) < 0 as tr, 16 * sum(b * g) - sum(b) * sum(g) < 0 as tb from rasters group by texture_id),
 corner as (select texture_id, ((case when tr then lr else hr end) * 31 + 127) // 255 * 2048 + (hg * 63 + 127) // 255 * 32 + ((case when tb then lb else hb end) * 31 + 127) // 255 as c0,
   ((case when tr then hr else lr end) * 31 + 127) // 255 * 2048 + (lg * 63 + 127) // 255 * 32 + ((case when tb then hb else lb end) * 31 + 127) // 255 as c1 from box),
 wide as (select *, [((c0 // 2048) * 255 + 15) // 31, ((c0 // 32 % 64) * 255 + 31) // 63, ((c0 % 32) * 255 + 15) // 31] as p0,
   [((c1 // 2048) * 255 + 15) // 31, ((c1 // 32 % 64) * 255 + 31) // 63, ((c1 % 32) * 255 + 15) // 31] as p1 from corner),
 pal as (select texture_id, c0, c1, [p0, p1, [(2 * p0[1] + p1[1]) // 3, (2 * p0[2] + p1[2]) // 3, (2 * p0[3] + p1[3]) // 3], [(p0[1] + 2 * p1[1]) // 3, (p0[2] + 2 * p1[2]) // 3, (p0[3] + 2 * p1[3]) // 3]] as p from wide),
 far as (select t.texture_id, y * 4 + x as i, k, (r - p[k + 1][1]) ** 2 + (g - p[k + 1][2]) ** 2 + (b - p[k + 1][3]) ** 2 as d from rasters t join pal using (texture_id), (select unnest(range(4)) as k)),
 code as (select texture_id, i, arg_min(k, d * 4 + k) as k from far group by texture_id, i),
 color as (select texture_id, 0 as by, 0 as bx, any_value(c0) as c0, any_value(c1) as c1, sum(k::bigint << (2 * i)::int)::bigint as c_bits from code join pal using (texture_id) group by texture_id)"""


@query(f"with {_RASTERS}, {_COLOR} select * from color")
def bc3_color(spark, sf_dir):
    return raster.bc3_color(raster_lines(spark, sf_dir))


@query(f"""with {_RASTERS}, planes as (select texture_id, y, x, a as v from rasters), {_ALPHA}, {_COLOR},
 e as (select texture_id, a0, a1, a_bits, c_bits, p, i from alpha join color using (texture_id) join pal using (texture_id), (select unnest(range(16)) as i)),
 k as (select *, ((c_bits >> (2 * i)::int) & 3)::int as cc, ((a_bits >> (3 * i)::int) & 7)::int as ac from e)
 select texture_id, (i // 4)::int as y, (i % 4)::int as x, p[cc + 1][1]::int as r, p[cc + 1][2]::int as g, p[cc + 1][3]::int as b,
   (case ac when 0 then a0 when 1 then a1 else ((8 - ac) * a0 + (ac - 1) * a1) // 7 end)::int as a from k""")
def bc3_decode(spark, sf_dir):
    t = raster_lines(spark, sf_dir)
    return raster.bc3_decode(raster.bc3_alpha(t.select("texture_id", "y", F.col("a").alias("v"))), raster.bc3_color(t))


def _package_files(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.when(F.col("c_custkey") % 5 == 0, ".disabled").otherwise("")).alias("name"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.floor("o_totalprice").cast("bigint").alias("length"), F.col("o_orderdate").cast("timestamp_ntz").alias("modified"))
    return customer.join(orders, "c_custkey").select("name", F.lit(False).alias("is_dir"), "length", "modified", "o_orderkey")


_PACKAGES = """packs as (select c_name || case when c_custkey % 5 = 0 then '.disabled' else '' end as name, floor(o_totalprice)::bigint as length, o_orderdate::timestamp as modified, o_orderkey from customer join orders on o_custkey = c_custkey),
 packages as (select name, suffix(name, '.disabled') as disabled, sum(length)::bigint as bytes, max(modified) as modified_at from packs group by name)"""


def _packages(spark, sf_dir):
    return catalog.list_packages(_package_files(spark, sf_dir))


@query(f"with {_PACKAGES} select * from packages order by name")
def package_list(spark, sf_dir):
    return _packages(spark, sf_dir).orderBy("name")


def _sorted(how: str, order: str) -> None:
    def run(spark, sf_dir):
        return _packages(spark, sf_dir).orderBy(*catalog.sort_keys(how)).select("name", "bytes", "modified_at")

    run.__name__ = f"package_sort_{how.replace('-', '_')}"
    query(f"with {_PACKAGES} select name, bytes, modified_at from packages order by {order}")(run)


_sorted("name-asc", "name")
_sorted("name-desc", "name desc")
_sorted("size-desc", "bytes desc, name")
_sorted("date-desc", "modified_at desc, name")


@query(f"with {_PACKAGES}, f as (select name || '/f' || (o_orderkey % 10) as rel_path, o_orderkey, max(length) as length from packs group by 1, 2), a as (select rel_path, max(length) as length from f where o_orderkey % 3 > 0 group by 1), b as (select rel_path, min(length) as length from f where o_orderkey % 3 = 0 group by 1) select coalesce(b.rel_path, a.rel_path) as rel_path, coalesce(b.length, a.length) as length from a full join b using (rel_path)")
def package_import(spark, sf_dir):
    files = _package_files(spark, sf_dir).withColumn("rel_path", F.concat("name", F.lit("/f"), F.col("o_orderkey") % 10))
    existing = files.where("o_orderkey % 3 > 0").groupBy("rel_path").agg(F.max("length").alias("length"))
    return catalog.import_files(existing, files.where("o_orderkey % 3 = 0").groupBy("rel_path").agg(F.min("length").alias("length")))


@query("select count_if(c_custkey % 4 > 0) as imported, list_sort(list('copy failed: ' || c_name) filter (c_custkey % 4 = 0)) as errors from customer where c_custkey % 7 > 0")
def import_outcome(spark, sf_dir):
    kind = F.when(F.col("c_custkey") % 7 == 0, "other").otherwise("dir")
    return catalog.import_outcome(table(spark, sf_dir, "customer").select(kind.alias("kind"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("copy failed: "), "c_name")).alias("error")))


@query(f"with {_PACKAGES}, n as (select name, case when disabled then regexp_replace(name, '([.]disabled)+$', '') else name || '.disabled' end as new_name from packages) select name, new_name, exists (select 1 from packages p where p.name = n.new_name) as collides from n")
def package_toggle(spark, sf_dir):
    return catalog.toggle(_packages(spark, sf_dir))


def _wanted(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey % 6 = 0").select(F.col("c_name").alias("name"))


@query(f"with {_PACKAGES} select c_name as name, c_name in (select name from packages) as deleted from customer")
def package_delete(spark, sf_dir):
    """Asked for all names, of which some aren't in the catalogue."""
    return catalog.delete(_packages(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")))[1]


@query(f"with {_PACKAGES} select name, bytes from packages where name not in (select c_name from customer where c_custkey % 6 = 0)")
def package_remaining(spark, sf_dir):
    """What stays when some are deleted."""
    return catalog.delete(_packages(spark, sf_dir), _wanted(spark, sf_dir))[0].select("name", "bytes")


def _tenths(n: int) -> str:
    t = f"(2 * bytes * 10 + {n}) // {2 * n}"
    return f"(({t}) // 10) || '.' || (({t}) % 10)"


@query(f"with {_PACKAGES} select name, regexp_replace(name, '[.]disabled$', '') as title, case when bytes < 1024 then bytes || ' B' when bytes < 1048576 then {_tenths(1024)} || ' KB' else {_tenths(1048576)} || ' MB' end as size_text, strftime(modified_at, '%m/%d') as date_text from packages")
def package_display(spark, sf_dir):
    return catalog.display(_packages(spark, sf_dir))


@query(f"with {_LISTING}, u as (select path, ord from listing union all select path, ord + 1000000 from listing where ord % 3 = 0) select path, min(ord) as ord from u group by path")
def selection_union(spark, sf_dir):
    one = listing(spark, sf_dir)
    return sets.selection_union(one, one.where("ord % 3 = 0").withColumn("ord", F.col("ord") + 1000000))


@query(f"with {_LISTING} select path, ord from listing where path not in (select path from listing where ord % 5 = 0)")
def selection_remove(spark, sf_dir):
    one = listing(spark, sf_dir)
    return sets.selection_remove(one, one.where("ord % 5 = 0"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").alias("task_id"), F.col("event_type").alias("tone"), "value")


@query("""with e as (select user_id as task_id, event_type as tone, ts, event_id, lag(ts) over w as pts, lag(event_type) over w as pt from events window w as (partition by user_id order by ts, event_id)),
 r as (select *, sum(case when pts is null or ts - pts > interval 10 minutes or tone is distinct from pt then 1 else 0 end) over (partition by task_id order by ts, event_id) as run from e)
 select task_id, run::bigint as run, tone, min(ts) as first_ts, max(ts) as last_ts, count(*) as repeats from r group by task_id, run, tone""")
def activity_runs(spark, sf_dir):
    return activity.collapse_runs(_events(spark, sf_dir), 600, per=("task_id",), order=("ts", "event_id"))


@query("select event_id, ts, event_type as tone from events order by ts desc, event_id desc limit 40")
def activity_feed(spark, sf_dir):
    return activity.activity_feed(_events(spark, sf_dir)).select("event_id", "ts", "tone")


@query("""with c as (select user_id as task_id, event_id, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) as completed, count(*) over (partition by user_id) as total from events)
 select *, least(100, floor(completed::double / total * 100 + 0.5))::bigint as percent from c""")
def task_progress(spark, sf_dir):
    return activity.progress_view(_events(spark, sf_dir))


@query("select user_id as task_id, count_if(event_type <> 'error' and event_id % 9 > 0) as completed, count(*) as total, list(event_type || ' ' || event_id order by event_id) as logs from events group by user_id")
def task_outcome(spark, sf_dir):
    items = _events(spark, sf_dir).select("task_id", F.col("event_id").alias("ord"), ((F.col("tone") != "error") & (F.col("event_id") % 9 > 0)).alias("ok"), F.concat_ws(" ", "tone", "event_id").alias("message"))
    return activity.task_outcome(items)


@query("""with t as (select user_id as task_id, min(ts) + interval 1 day as start_ts, max(ts) - interval 1 day as end_ts from events group by user_id)
 select e.user_id as task_id, e.event_id, e.ts from events e join t on t.task_id = e.user_id where e.ts between start_ts and end_ts""")
def progress_in_task(spark, sf_dir):
    e = _events(spark, sf_dir)
    tasks = e.groupBy("task_id").agg((F.min("ts") + F.expr("interval 1 day")).alias("start_ts"), (F.max("ts") - F.expr("interval 1 day")).alias("end_ts"))
    return activity.in_task(e, tasks)


@query("""select o_orderkey, case when o_orderkey % 4 = 0 then 'choose an input' when o_custkey % 3 = 0 then 'choose an output folder' when o_totalprice < 50000 then 'no files' end as blocker from orders""")
def job_readiness(spark, sf_dir):
    rules = [(F.col("o_orderkey") % 4 == 0, "choose an input"), (F.col("o_custkey") % 3 == 0, "choose an output folder"), (F.col("o_totalprice") < 50000, "no files")]
    return table(spark, sf_dir, "orders").select("o_orderkey", activity.readiness(rules).alias("blocker"))


@query("""with e as (select event_type as tone, ts, event_id, lag(ts) over w as pts, lag(event_type) over w as pt from events window w as (order by ts, event_id)),
 r as (select *, sum(case when pts is null or ts - pts > interval 10 minutes or tone is distinct from pt then 1 else 0 end) over (order by ts, event_id) as run from e)
 select run::bigint as run, tone, min(ts) as first_ts, max(ts) as last_ts, count(*) as repeats from r group by run, tone""")
def activity_runs_global(spark, sf_dir):
    """The one list over all tasks."""
    return activity.collapse_runs(_events(spark, sf_dir), 600, order=("ts", "event_id"))


@query("""with h as (select event_id, ts, row_number() over (order by ts, event_id) as completed, count(*) over () as total from events)
 select 0::bigint as task_id, event_id, completed, total, least(100, floor(completed::double / total * 100 + 0.5))::bigint as percent from h""")
def hot_task_progress(spark, sf_dir):
    """All events as those of one task."""
    return activity.progress_view(_events(spark, sf_dir).withColumn("task_id", F.lit(0).cast("bigint")))


@query("""with e as (select event_type as tone, ts, event_id, lag(ts) over w as pts, lag(event_type) over w as pt from events window w as (order by ts, event_id)),
 r as (select *, sum(case when pts is null or ts - pts > interval 10 minutes or tone is distinct from pt then 1 else 0 end) over (order by ts, event_id) as run from e)
 select run::bigint as run, tone, min(ts) as first_ts, max(ts) as last_ts, count(*) as repeats from r group by run, tone order by first_ts desc, run desc limit 4""")
def activity_toasts_global(spark, sf_dir):
    """The newest runs of the one list over all tasks."""
    return activity.toasts(_events(spark, sf_dir), 600, order=("ts", "event_id"))


_KEYS = ("click", "view", "purchase")


@query("with p as (select user_id as profile_id, event_type as key, arg_max(value, event_id) as v from events where value is not null group by all) select profile_id, " + ", ".join(f"max(v) filter (key = '{k}') as \"{k}\"" for k in _KEYS) + " from p group by profile_id")
def profile_fold(spark, sf_dir):
    patches = _events(spark, sf_dir).select(F.col("task_id").alias("profile_id"), F.col("event_id").alias("seq"), F.col("tone").alias("key"), F.col("value").cast("string").alias("value"))
    return activity.fold_profiles(patches, _KEYS)

# Files, jobs, and the rules around them.


_PATCH = """case event_id % 11 when 0 then '[1, 2]' when 1 then '{"volume": "loud", "name": "x' || event_id || '"}' when 2 then 'no json' when 3 then '{"dark": true, "other": {"a": 1}}'
   when 4 then '{"volume": null}' when 5 then '{}' else '{"name": "' || event_type || '", "volume": ' || event_id || ', "rate": ' || (event_id % 4) || '.5}' end"""


@query(f"""with p as (select user_id as profile_id, event_id as seq, {_PATCH} as patch, event_id % 11 as k from events),
 v as (select *, k not in (0, 1, 2, 4) as sound, case when k > 5 then patch->>'name' end as name, case when k > 5 then (patch->>'volume')::bigint end as volume, case when k > 5 then (patch->>'rate')::double end as rate, case when k = 3 then true end as dark from p)
 select profile_id, count(*) filter (sound) as applied, count(*) filter (not sound) as rejected, coalesce(arg_max(name, seq) filter (name is not null), 'none') as name, coalesce(arg_max(volume, seq) filter (volume is not null), 50) as volume,
   coalesce(arg_max(rate, seq) filter (rate is not null), 1.0) as rate, coalesce(bool_or(dark), false) as dark from v group by profile_id""")
def profile_patches(spark, sf_dir):
    """JSON patches of several keys; some aren't objects, some have a key of a wrong type, some unknown keys."""
    patches = table(spark, sf_dir, "events").select(F.col("user_id").alias("profile_id"), F.col("event_id").alias("seq"), F.expr(_PATCH).alias("patch"))
    return activity.fold_settings(patches, {"name": ("string", "none"), "volume": ("bigint", 50), "rate": ("double", 1.0), "dark": ("boolean", False)})


@query("""with k as (select p_partkey, [0, 1, 65536, 65537, 4294967295][p_partkey % 5 + 1]::hugeint as w, [0, 1, 70000][p_size % 3 + 1]::hugeint as h, p_size % 2 = 0 as bc3 from part),
 n as (select *, case when bc3 then (w + 3) // 4 * ((h + 3) // 4) * 16 else w * h * 4 end as need, w between 1 and 65536 and h between 1 and 65536 as fits from k)
 select p_partkey as texture_id, case when not fits then 'bad_size' when need > 100 then 'truncated' else 'ok' end as status, case when fits then w end::int as width, case when fits then h end::int as height from n""")
def dds_sizes(spark, sf_dir):
    """Headers with sides of 0 and beyond all bounds."""
    width, height = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in (0, 1, 65536, 65537, 4294967295)]), (F.col("p_partkey") % 5 + 1).cast("int")), F.element_at(F.array(*[F.lit(n).cast("bigint") for n in (0, 1, 70000)]), (F.col("p_size") % 3 + 1).cast("int"))
    data = F.unhex(F.concat(raster.dds_header(width, height, F.lit(1), F.col("p_size") % 2 == 0), F.repeat(F.lit("00"), 100)))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("texture_id"), data.alias("bytes"))
    return raster.dds_info(files).select("texture_id", "status", "width", "height")



def _le_bytes(x: str, n: int) -> str:
    digits = f"lpad(printf('%X', ({x})::bigint), {2 * n}, '0')"
    return " || ".join(f"substr({digits}, {k}, 2)" for k in range(2 * n - 1, 0, -2))


def _dds_sql(width: str, height: str, levels: str, bc3: str) -> str:
    return f"(select {_HEADER} from (select ({width})::bigint as w, ({height})::bigint as h, ({levels})::bigint as n, {bc3} as bc3))"


def _bc3_sql(of: str) -> str:
    """Tables {of}_codes, {of}_pal and {of}_pay of the texels in table {of}."""
    corner = lambda c, side, other: f"(case when t{c} then {other}{c} else {side}{c} end)"
    word = lambda side, other: f"({corner('r', side, other)} * 31 + 127) // 255 * 2048 + ({side}g * 63 + 127) // 255 * 32 + ({corner('b', side, other)} * 31 + 127) // 255"
    wide = lambda c: f"[(({c} // 2048) * 255 + 15) // 31, (({c} // 32 % 64) * 255 + 31) // 63, (({c} % 32) * 255 + 15) // 31]"
    mixed = lambda m, n: "[" + ", ".join(f"({m} * p0[{k}] + {n} * p1[{k}]) // 3" for k in (1, 2, 3)) + "]"
    step = "case when a0 = a1 then 0 else (14 * (a0 - a) + (a0 - a1)) // (2 * (a0 - a1)) end"
    code = "case step when 0 then 0 when 7 then 1 else step + 1 end"
    block = " || ".join(_le_bytes(c, n) for c, n in (("a0", 1), ("a1", 1), ("a_bits", 6), ("c0", 2), ("c1", 2), ("c_bits", 4)))
    return f"""{of}_cells as (select *, y // 4 as yb, x // 4 as xb, y % 4 * 4 + x % 4 as i from {of}),
 {of}_box as (select texture_id, yb, xb, max(a) as a0, min(a) as a1, max(r) as hr, min(r) as lr, max(g) as hg, min(g) as lg, max(b) as hb, min(b) as lb,
   count(*) * sum(r * g) - sum(r) * sum(g) < 0 as tr, count(*) * sum(b * g) - sum(b) * sum(g) < 0 as tb from {of}_cells group by texture_id, yb, xb),
 {of}_ends as (select *, {word('h', 'l')} as c0, {word('l', 'h')} as c1 from {of}_box),
 {of}_wide as (select *, {wide('c0')} as p0, {wide('c1')} as p1 from {of}_ends),
 {of}_pal as (select texture_id, yb, xb, a0, a1, c0, c1, [p0, p1, {mixed(2, 1)}, {mixed(1, 2)}] as p from {of}_wide),
 {of}_far as (select texture_id, yb, xb, i, a, a0, a1, k, (r - p[k + 1][1]) ** 2 + (g - p[k + 1][2]) ** 2 + (b - p[k + 1][3]) ** 2 as d
   from {of}_cells join {of}_pal using (texture_id, yb, xb), (select unnest(range(4)) as k)),
 {of}_steps as (select texture_id, yb, xb, i, arg_min(k, d * 4 + k) as cc, any_value({step}) as step from {of}_far group by texture_id, yb, xb, i),
 {of}_codes as (select *, {code} as ac from {of}_steps),
 {of}_bits as (select texture_id, yb, xb, sum(ac::bigint << (3 * i)::int)::bigint as a_bits, sum(cc::bigint << (2 * i)::int)::bigint as c_bits from {of}_codes group by texture_id, yb, xb),
 {of}_blocks as (select texture_id, yb, xb, {block} as block from {of}_bits join {of}_pal using (texture_id, yb, xb)),
 {of}_pay as (select texture_id, string_agg(block, '' order by yb, xb) as payload from {of}_blocks group by texture_id)"""


def _pictures(spark, sf_dir):
    """Rasters of 7 x 6 texels, whose last blocks are not full."""
    of = lambda f: F.transform(F.slice("v", 1, 7), f)
    return plane_lines(spark, sf_dir).where("y < 6").select("texture_id", "y", of(lambda v: v).alias("r"), of(lambda v: 255 - v).alias("g"), of(lambda v: v * 7 % 256).alias("b"), of(lambda v: v * 3 % 256).alias("a"))


_PICTURES = _PLANES + ", pictures as (select texture_id, y, x, v as r, 255 - v as g, v * 7 % 256 as b, v * 3 % 256 as a from planes where x < 7 and y < 6)"


@query(f"with {_PICTURES}, {_bc3_sql('pictures')} select * from pictures_pay")
def bc3_payload(spark, sf_dir):
    return raster.bc3_payload(_pictures(spark, sf_dir)).select("texture_id", F.hex("payload").alias("payload"))


def _picture_files(spark, sf_dir, fmt):
    shown = _pictures(spark, sf_dir).withColumn("texture_id", F.concat(F.lit("/in/p"), "texture_id", F.lit(".png")))
    sizes = table(spark, sf_dir, "embeddings").select(F.format_string("/in/p%d.png", "vec_id").alias("texture_id"), F.lit(7).alias("width"), F.lit(6).alias("height"))
    return jobs.dds_files(shown, sizes, fmt)


@query(f"with {_PICTURES}, {_bc3_sql('pictures')} select 'p' || texture_id || '.dds' as name, {_dds_sql('7', '6', '1', 'true')} || payload as bytes from pictures_pay")
def dds_dxt5(spark, sf_dir):
    return _picture_files(spark, sf_dir, "DXT5").select("name", F.hex("bytes").alias("bytes"))


@query(f"""with {_PICTURES}, {_bc3_sql('pictures')}
 select 'p' || texture_id || '.dds' as name, 'BC3' as format, (yb * 4 + i // 4)::int as y, (xb * 4 + i % 4)::int as x, p[cc + 1][1]::int as r, p[cc + 1][2]::int as g, p[cc + 1][3]::int as b,
   (case ac when 0 then a0 when 1 then a1 else ((8 - ac) * a0 + (ac - 1) * a1) // 7 end)::int as a from pictures_codes join pictures_pal using (texture_id, yb, xb)
 union all select 'p' || texture_id || '.dds', 'RGBA8', y, x, r, g, b, a from pictures""")
def dds_decode(spark, sf_dir):
    """Files of both formats, read back."""
    found = [raster.dds_texels(_picture_files(spark, sf_dir, fmt).withColumnRenamed("name", "texture_id")).withColumn("format", F.lit(kind)) for fmt, kind in (("DXT5", "BC3"), ("8.8.8.8", "RGBA8"))]
    return found[0].unionByName(found[1]).withColumnRenamed("texture_id", "name")


@query(f"""with {_SAMPLES}, blk as (select vec_id, vec_id % 3 as f, list(v order by p) filter (p < 16) as q from samples group by vec_id),
 at_ as (select *, case when f = 0 then 0 else 8 end as o from blk),
 c as (select *, q[o + 1] + 256 * q[o + 2] as c0, q[o + 3] + 256 * q[o + 4] as c1, q[1] as a0, q[2] as a1 from at_),
 w as (select *, [((c0 // 2048) * 255 + 15) // 31, ((c0 // 32 % 64) * 255 + 31) // 63, ((c0 % 32) * 255 + 15) // 31] as p0,
   [((c1 // 2048) * 255 + 15) // 31, ((c1 // 32 % 64) * 255 + 31) // 63, ((c1 % 32) * 255 + 15) // 31] as p1, f = 0 and c0 <= c1 as three from c),
 e as (select *, (q[o + 5 + i // 4] >> (2 * (i % 4))::int) & 3 as k, ((q[3] + 256 * q[4] + 65536 * q[5] + 16777216 * q[6]::bigint + 4294967296 * q[7]::bigint + 1099511627776 * q[8]::bigint) >> (3 * i)::int) & 7 as ac,
   ((q[1 + i // 2] >> (4 * (i % 2))::int) & 15) * 17 as nibble from w, (select unnest(range(16)) as i)),
 n as (select *, list_transform([1, 2, 3], lambda j: case k when 0 then p0[j] when 1 then p1[j] when 2 then (case when three then (p0[j] + p1[j]) // 2 else (2 * p0[j] + p1[j]) // 3 end)
   else (case when three then 0 else (p0[j] + 2 * p1[j]) // 3 end) end) as rgb from e)
 select vec_id as texture_id, (i // 4)::int as y, (i % 4)::int as x, rgb[1]::int as r, rgb[2]::int as g, rgb[3]::int as b,
   (case f when 0 then (case when three and k = 3 then 0 else 255 end) when 1 then nibble
    else (case when ac = 0 then a0 when ac = 1 then a1 when a0 > a1 then ((8 - ac) * a0 + (ac - 1) * a1) // 7 when ac = 6 then 0 when ac = 7 then 255 else ((6 - ac) * a0 + (ac - 1) * a1) // 5 end) end)::int as a from n""")
def block_decode(spark, sf_dir):
    """The first 16 samples of each vector as the bytes of a block."""
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda c: F.lpad(F.hex(c["v"].cast("bigint")), 2, "0")), "")
    rows = samples(spark, sf_dir).where("p < 16").groupBy("vec_id").agg(F.unhex(digits).alias("block"))
    kind = F.element_at(F.array(F.lit("BC1"), F.lit("BC2"), F.lit("BC3")), (F.col("vec_id") % 3 + 1).cast("int"))
    blocks_ = rows.select(F.col("vec_id").alias("texture_id"), F.lit(0).alias("by"), F.lit(0).alias("bx"), kind.alias("format"), F.when(kind == "BC1", F.substring("block", 1, 8)).otherwise(F.col("block")).alias("block"))
    return blocks.decode_blocks(blocks_)


def _file_status(spark, sf_dir):
    size = F.col("p_size")
    width, height = size % 8 + 1, F.col("p_partkey") % 5 + 1
    good = F.unhex(F.concat(raster.dds_header(width, height, F.lit(1), size % 2 == 0), F.repeat(F.lit("00"), F.when(size % 2 == 0, channels.bc3_size(width, height)).otherwise(width * height * 4).cast("int"))))
    other = F.unhex(F.concat(raster.dds_header(width, height, F.lit(1), F.lit(True)).substr(1, 168), F.lit("44583130"), F.repeat(F.lit("00"), 40)))
    damage = F.col("p_partkey") % 4
    data = F.when(damage == 0, good).when(damage == 1, F.substring(good, 1, 130)).when(damage == 2, other).otherwise(F.substring(good, 5, 200))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("texture_id"), data.alias("bytes"))


@query("""select p_partkey as texture_id, case p_partkey % 4 when 0 then 'ok' when 1 then 'truncated' when 2 then 'unsupported_format' else 'not_dds' end as status,
 case when p_partkey % 4 in (0, 1) then (case when p_size % 2 = 0 then 'BC3' else 'RGBA8' end) end as format from part""")
def dds_status(spark, sf_dir):
    return raster.dds_info(_file_status(spark, sf_dir)).select("texture_id", "status", F.when(F.col("status").isin("ok", "truncated"), F.col("format")).alias("format"))


@query(f"""with {_PLANES}, t as (select vec_id as texture_id, [5, 8, 3][vec_id % 3 + 1] as tw, [16, 8, 2][vec_id % 3 + 1] as th from embeddings),
 w as (select m, o, i, 2 * greatest(8, m) - abs((2 * i + 1) * m - (2 * o + 1) * 8) as w from (select unnest([2, 3, 5, 8, 16]) as m), (select unnest(range(16)) as o), (select unnest(range(8)) as i) where o < m)
 select texture_id, wy.o::int as y, wx.o::int as x, ((2 * sum(wx.w * wy.w * v) + sum(wx.w * wy.w)) // (2 * sum(wx.w * wy.w)))::int as v
 from planes join t using (texture_id) join w wx on wx.m = tw and wx.i = planes.x and wx.w > 0 join w wy on wy.m = th and wy.i = planes.y and wy.w > 0 group by texture_id, wy.o, wx.o""")
def resample_any(spark, sf_dir):
    of = lambda *sizes: F.element_at(F.array(*map(F.lit, sizes)), (F.col("vec_id") % 3 + 1).cast("int"))
    sizes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("texture_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), of(5, 8, 3).alias("target_width"), of(16, 8, 2).alias("target_height"))
    return scanlines.texels(scanlines.resample_to(plane_lines(spark, sf_dir), sizes), ("v",))


def _set_texels(spark, sf_dir):
    """Texels and sizes of the files of the listing: the set's number names its rasters; roughness and metallic are 8 x 2, the others 4 x 4."""
    found = sets.find_sets(listing(spark, sf_dir))
    number = F.regexp_extract("prefix", "([0-9]+)$", 1).cast("bigint")
    kinds = F.array(*[F.struct(F.lit(k).alias("part"), F.col(c).alias("path")) for k, c in enumerate(names.KINDS)])
    files = found.select(number.alias("texture_id"), F.explode(kinds).alias("file")).select("texture_id", "file.part", "file.path")
    p, wide = F.col("y") * 4 + F.col("x"), F.col("part").isin(1, 2)
    y, x = F.when(wide, F.floor(p / 8)).otherwise(F.col("y")), F.when(wide, p % 8).otherwise(F.col("x"))
    cells = texels(spark, sf_dir).join(files, ["texture_id", "part"]).select(F.col("path").alias("texture_id"), "part", y.cast("int").alias("y"), x.cast("int").alias("x"), *"rgba")
    sizes = files.select(F.col("path").alias("texture_id"), F.when(wide, 8).otherwise(4).alias("width"), F.when(wide, 2).otherwise(4).alias("height"))
    return cells.drop("part"), sizes


@query(f"""with {_TEXELS}, {_SETS}, wide as (select texture_id, part, (y * 4 + x) // 8 as y, (y * 4 + x) % 8 as x, r, g, b from texels where part in (1, 2)),
 wx as (select o, i, 16 - abs((2 * i + 1) * 4 - (2 * o + 1) * 8) as w from (select unnest(range(4)) as o), (select unnest(range(8)) as i)),
 wy as (select o, i, 8 - abs((2 * i + 1) * 4 - (2 * o + 1) * 2) as w from (select unnest(range(4)) as o), (select unnest(range(2)) as i)),
 small as (select texture_id, part, wy.o as y, wx.o as x, (2 * sum(wx.w * wy.w * r) + sum(wx.w * wy.w)) // (2 * sum(wx.w * wy.w)) as r, (2 * sum(wx.w * wy.w * g) + sum(wx.w * wy.w)) // (2 * sum(wx.w * wy.w)) as g,
   (2 * sum(wx.w * wy.w * b) + sum(wx.w * wy.w)) // (2 * sum(wx.w * wy.w)) as b from wide join wx on wx.i = wide.x and wx.w > 0 join wy on wy.i = wide.y and wy.w > 0 group by texture_id, part, wy.o, wx.o),
 grey as (select *, (2126 * r + 7152 * g + 722 * b) // 10000 as v from small),
 made as (select texture_id::bigint as texture_id, y, x, r, g, b, 255 as a from texels where part = 0
   union all select texture_id + 1000000000, y, x, (255 - s.v)::int, n.g, m.v::int, n.r from texels n join grey s using (texture_id, y, x) join grey m using (texture_id, y, x) where n.part = 3 and s.part = 1 and m.part = 2), {_bc3_sql('made')}
 select prefix || case when texture_id >= 1000000000 then '_n.dds' else '_c.dds' end as name, {_dds_sql('4', '4', '1', 'true')} || payload as bytes
 from made_pay join sets on texture_id % 1000000000 = regexp_extract(prefix, '([0-9]+)$', 1)::bigint""")
def merge_jobs(spark, sf_dir):
    shown, sizes = _set_texels(spark, sf_dir)
    return jobs.merge_files(shown, sizes, listing(spark, sf_dir), "white").files.select("name", F.hex("bytes").alias("bytes"))


def _dds_inputs(spark, sf_dir):
    """Uncompressed files named by part, the raster of the part's number in each."""
    end = "case p_size % 6 when 0 then '_c' when 1 then '_n' when 2 then '_n_c' when 3 then '_c_n' when 4 then '_C_c' else '' end"
    named = table(spark, sf_dir, "part").select(F.expr(f"concat('/in/', p_partkey % 2, '/t', p_partkey div 2, {end}, '.dds')").alias("path"), F.col("p_partkey").alias("ord"))
    header = raster.dds_header(F.lit(4), F.lit(4), F.lit(1), F.lit(False))
    payloads = raster.rgba8_payload(raster_lines(spark, sf_dir)).select(F.col("texture_id").alias("ord"), F.concat(F.unhex(header), "payload").alias("bytes"))
    return named.join(payloads, "ord")


_DDS_INPUTS = """inputs as (select '/in/' || (p_partkey % 2) || '/t' || (p_partkey // 2) || case p_size % 6 when 0 then '_c' when 1 then '_n' when 2 then '_n_c' when 3 then '_c_n' when 4 then '_C_c' else '' end || '.dds' as path, p_partkey as ord
   from part where p_partkey in (select vec_id from embeddings)),
 stems as (select *, regexp_extract(path, '([^/]*)[.]dds$', 1) as stem from inputs),
 outs as (select path, ord, regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '(_c)+$', ''), '(_C)+$', ''), '(_n)+$', ''), '(_N)+$', '') as prefix,
   unnest(case when lower(stem) like '%\\_c' escape '\\' then ['BaseColor', 'Alpha'] when lower(stem) like '%\\_n' escape '\\' then ['Roughness', 'Metallic', 'Normal'] else [] end) as channel from stems)"""


@query(f"""with {_RASTERS}, {_DDS_INPUTS}, chosen as (select prefix || '_' || channel || '.png' as name, any_value(channel) as channel, max(ord) as ord from outs group by 1)
 select name, 4 as width, 4 as height, case channel when 'BaseColor' then 3 when 'Normal' then 4 else 1 end as channels,
   string_agg(case channel when 'BaseColor' then printf('%02X%02X%02X', r, g, b) when 'Alpha' then printf('%02X', a) when 'Roughness' then printf('%02X', 255 - r) when 'Metallic' then printf('%02X', b) else printf('%02X%02XFFFF', a, g) end, '' order by y, x) as pixels
 from chosen join rasters on texture_id = ord group by name, channel""")
def split_jobs(spark, sf_dir):
    made = jobs.split_files(_dds_inputs(spark, sf_dir)).files
    return made.select("name", "width", "height", "channels", F.hex("pixels").alias("pixels"))


def _mip_levels(spark, sf_dir):
    """Levels of 8, 4, 2 and 1 texels a side; in every seventh texture level 2 has a wrong width."""
    level = F.col("vec_id") % 4
    side = F.greatest(F.lit(1), F.expr("shiftright(8, cast(vec_id % 4 as int))"))
    key = [F.expr("vec_id div 4").alias("texture_id"), level.cast("int").alias("level")]
    vectors = table(spark, sf_dir, "embeddings")
    wrong = (F.expr("vec_id div 4") % 7 == 3) & (level == 2)
    levels = vectors.select(*key, F.when(wrong, 3).otherwise(side).alias("width"), side.alias("height"))
    v = F.col("v")
    cells = samples(spark, sf_dir).withColumn("side", side).where("p < side * side")
    y, x = F.floor(F.col("p") / F.col("side")).cast("int"), (F.col("p") % F.col("side")).cast("int")
    return cells.select(*key, y.alias("y"), x.alias("x"), v.alias("r"), (255 - v).alias("g"), (v * 5 % 256).alias("b"), (v * 11 % 256).alias("a")), levels


_MIPS = _SAMPLES + """, sided as (select *, vec_id % 4 as level, greatest(1, 8 >> (vec_id % 4)::int) as side from samples),
 mips as (select vec_id as texture_id, (p // side)::int as y, (p % side)::int as x, v as r, 255 - v as g, v * 5 % 256 as b, v * 11 % 256 as a from sided where p < side * side)"""


@query(f"""with {_MIPS}, {_bc3_sql('mips')}, whole as (select texture_id // 4 as texture_id, count(*) as many, string_agg(payload, '' order by texture_id) as payload from mips_pay group by 1)
 select texture_id || '/Mipmap.dds' as name, {_dds_sql('8', '8', 'many', 'true')} || payload as bytes from whole where texture_id % 7 <> 3""")
def mip_files(spark, sf_dir):
    return jobs.mip_files(*_mip_levels(spark, sf_dir), on_error="collect").files.select("name", F.hex("bytes").alias("bytes"))


def _manifest(spark, sf_dir):
    path = "concat('/in/', p_partkey % 2, '/', p_partkey div 2, case p_size % 3 when 0 then '.v2' when 1 then '' else '.a.b' end, '.png')"
    status = F.when(F.col("p_size") % 10 == 0, "ValueError: unsupported PNG").otherwise("ok")
    files = table(spark, sf_dir, "part").select(F.expr(path).alias("path"), F.col("p_partkey").alias("ord"), F.lit(4).alias("width"), F.lit(4).alias("height"), status.alias("status"))
    return files.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord")), "ord")


_MANIFEST = """manifest as (select '/in/' || (p_partkey % 2) || '/' || (p_partkey // 2) || e || '.png' as path, p_partkey as ord, p_size % 10 > 0 as ok,
   (p_partkey // 2) || case e when '.a.b' then '.a' else '' end || '.dds' as name
   from (select *, case p_size % 3 when 0 then '.v2' when 1 then '' else '.a.b' end as e from part) where p_partkey in (select vec_id from embeddings))"""


@query(f"""with {_RASTERS}, {_MANIFEST}, {_bc3_sql('rasters')}, chosen as (select name, max(ord) as ord from manifest where ok group by name)
 select name, {_dds_sql('4', '4', '1', 'true')} || payload as bytes from chosen join rasters_pay on texture_id = ord""")
def convert_files(spark, sf_dir):
    files = _manifest(spark, sf_dir)
    shown = raster_lines(spark, sf_dir).withColumnRenamed("texture_id", "ord").join(files.select("ord", F.col("path").alias("texture_id")), "ord").drop("ord")
    return jobs.convert_files(shown, files, on_error="collect").files.select("name", F.hex("bytes").alias("bytes"))


@query(f"""with {_SETS}, {_DDS_INPUTS}, {_MANIFEST}
 select 'merge' as job, prefix as item, true as ok, '完成 ' || prefix as message from sets
 union all select 'split', ord::varchar, true, case when lower(stem) like '%\\_c' escape '\\' then '拆分 ' || stem || ': BaseColor / Alpha' when lower(stem) like '%\\_n' escape '\\' then '拆分 ' || stem || ': Roughness / Metallic / Normal' end from stems
 union all select 'mip', (vec_id // 4) || '/Mipmap.dds', vec_id // 4 % 7 <> 3 or count(*) < 3, case when vec_id // 4 % 7 = 3 and count(*) > 2 then 'p2 尺寸应为 2x2，实际为 3x2。' else '生成 ' || (vec_id // 4) || '/Mipmap.dds' end from embeddings group by vec_id // 4
 union all select 'convert', ord::varchar, ok, case when ok then '转换 ' || regexp_extract(path, '([^/]*)$', 1) || ' -> ' || name else path || ': ValueError: unsupported PNG' end from manifest""")
def job_logs(spark, sf_dir):
    shown, sizes = _set_texels(spark, sf_dir)
    files = _manifest(spark, sf_dir)
    logs = {
        "merge": jobs.merge_files(shown, sizes, listing(spark, sf_dir)).log.withColumnRenamed("name", "item"),
        "split": jobs.split_files(_dds_inputs(spark, sf_dir)).log.withColumn("item", F.col("ord").cast("string")),
        "mip": jobs.mip_files(*_mip_levels(spark, sf_dir), on_error="collect").log.withColumnRenamed("name", "item"),
        "convert": jobs.convert_files(rasters(spark, sf_dir), files, on_error="collect").log.withColumn("item", F.col("ord").cast("string")),
    }
    found = [log.select(F.lit(job).alias("job"), "item", "ok", "message") for job, log in logs.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(f"with {_SETS} select * from sets order by prefix")
def texture_sets_sorted(spark, sf_dir):
    return jobs.find_sets(listing(spark, sf_dir))


@query(f"with {_SETS} select prefix, prefix || '_c.dds' as color, prefix || '_n.dds' as packed from sets")
def merge_names(spark, sf_dir):
    color, packed = names.merge_names(F.col("prefix"))
    return sets.find_sets(listing(spark, sf_dir)).select("prefix", color.alias("color"), packed.alias("packed"))


@query("""with f as (select p_partkey, ['8.8.8.8', 'R8G8B8A8_UNORM', 'DXT5', 'DXT9'][p_size % 4 + 1] as fmt from part)
 select p_partkey, fmt, case when fmt in ('8.8.8.8', 'R8G8B8A8_UNORM') then 'rgba8' when fmt = 'DXT5' then 'bc3' end as kind, case when fmt in ('8.8.8.8', 'R8G8B8A8_UNORM') then 'rgba8' else 'bc3' end as lenient from f""")
def format_rule(spark, sf_dir):
    fmt = F.element_at(F.array(*map(F.lit, ("8.8.8.8", "R8G8B8A8_UNORM", "DXT5", "DXT9"))), (F.col("p_size") % 4 + 1).cast("int"))
    named = table(spark, sf_dir, "part").select("p_partkey", fmt.alias("fmt"))
    return named.withColumns({"kind": names.format_kind(F.col("fmt")), "lenient": names.format_kind(F.col("fmt"), True)})


@query("""with f as (select c_custkey, ['', '/in', '/in/a', '/out'][c_custkey % 4 + 1] as path, [null, false, true][c_custkey % 3 + 1] as is_dir from customer)
 select c_custkey, path, case when path = '' or is_dir is null or not is_dir then '输入目录无效。' end as error, case when path = '' then '未设置' else regexp_extract(path, '([^/]*)$', 1) end as shown from f""")
def folder_errors(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, ("", "/in", "/in/a", "/out"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    is_dir = F.element_at(F.array(F.lit(None).cast("boolean"), F.lit(False), F.lit(True)), (F.col("c_custkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", path.alias("path"), is_dir.alias("is_dir"))
    return rows.select("c_custkey", "path", names.folder_error(F.col("path"), F.col("is_dir"), "输入目录").alias("error"), names.compact_path(F.col("path"), "未设置").alias("shown"))


@query("""with f as (select p_partkey, '/in/' || p_partkey || case p_size % 4 when 0 then '.dds' when 1 then '.DDS' when 2 then '.png' else '.dds.bak' end as path, p_size from part)
 select path from f where p_size % 4 < 2""")
def split_inputs(spark, sf_dir):
    path = "concat('/in/', p_partkey, case p_size % 4 when 0 then '.dds' when 1 then '.DDS' when 2 then '.png' else '.dds.bak' end)"
    return sets.split_inputs(table(spark, sf_dir, "part").select(F.expr(path).alias("path")))


@query(f"with {_LISTING}, u as (select path, -ord as ord from listing union all select path, ord + 1000000 from listing where ord % 3 = 0) select path, min(ord) as ord from u group by path order by ord")
def selection_in_order(spark, sf_dir):
    one = listing(spark, sf_dir)
    return sets.selection_in_order(one.withColumn("ord", -F.col("ord")), one.where("ord % 3 = 0").withColumn("ord", F.col("ord") + 1000000))


@query("""with f as (select '/mips/' || (p_partkey // 2) as dir, p_size % 3 = 0 as ok from part) select dir, '未找到 p0、p1、p2... mipmap 文件。' as error from f group by dir having not bool_or(ok)""")
def sequence_errors(spark, sf_dir):
    path = "concat('/mips/', p_partkey div 2, '/', case when p_size % 3 = 0 then 'p' else 'q' end, p_size % 7, '.png')"
    files = table(spark, sf_dir, "part").select(F.expr(path).alias("path"), F.expr("concat('/mips/', p_partkey div 2)").alias("dir"))
    return sets.sequence_errors(files, sets.numbered_sequence(files))


def _package_tree(spark, sf_dir):
    """Files, some package directories, and plain files beside the packages."""
    name = F.concat(F.lit("/pk/"), "c_name", F.when(F.col("c_custkey") % 5 == 0, ".disabled").otherwise(""))
    customer = table(spark, sf_dir, "customer").select("c_custkey", name.alias("dir"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("c_custkey").cast("int")).cast("timestamp_ntz")
    dirs = customer.where("c_custkey % 3 > 0").select(F.col("dir").alias("path"), F.lit(True).alias("is_dir"), F.lit(4096).cast("bigint").alias("length"), day.alias("modified"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.floor("o_totalprice").cast("bigint").alias("length"), F.col("o_orderdate").cast("timestamp_ntz").alias("modified"))
    files = customer.join(orders, "c_custkey").select(F.concat("dir", F.lit("/sub/f"), "o_orderkey").alias("path"), F.lit(False).alias("is_dir"), "length", "modified")
    plain = customer.select(F.concat("dir", F.lit(".txt")).alias("path"), F.lit(False).alias("is_dir"), F.lit(7).cast("bigint").alias("length"), day.alias("modified"))
    return files.unionByName(dirs).unionByName(plain)


@query("""with c as (select c_custkey, c_name || case when c_custkey % 5 = 0 then '.disabled' else '' end as name from customer),
 o as (select o_custkey as c_custkey, sum(floor(o_totalprice)::bigint)::bigint as bytes, max(o_orderdate::timestamp) as newest from orders group by 1)
 select name, suffix(name, '.disabled') as disabled, coalesce(bytes, 0)::bigint as bytes, case when c_custkey % 3 > 0 then (date '2020-01-01' + c_custkey::int)::timestamp else newest end as modified_at
 from c left join o using (c_custkey) where bytes is not null or c_custkey % 3 > 0""")
def package_tree(spark, sf_dir):
    return catalog.list_packages(catalog.packages_of_paths(_package_tree(spark, sf_dir), "/pk"))


@query(f"with {_PACKAGES} select count(*) as packages from packages")
def package_count(spark, sf_dir):
    return jobs.package_view(_packages(spark, sf_dir))[1]


@query(f"with {_PACKAGES} select name, regexp_replace(name, '[.]disabled$', '') as title, case when bytes < 1024 then bytes || ' B' when bytes < 1048576 then {_tenths(1024)} || ' KB' else {_tenths(1048576)} || ' MB' end as size_text, strftime(modified_at, '%m/%d') as date_text from packages order by bytes desc, name")
def package_view(spark, sf_dir):
    return jobs.package_view(_packages(spark, sf_dir), "size-desc")[0]


def _sources(spark, sf_dir):
    key = F.col("c_custkey")
    kind = F.when(key % 11 == 0, "other").when(key % 7 == 0, "file").otherwise("dir")
    error = F.when((key % 4 == 0) & (kind == "dir") | (key % 91 == 0), F.concat(F.lit("copy failed: "), "c_name"))
    return table(spark, sf_dir, "customer").select(key.alias("ord"), F.col("c_name").alias("source"), kind.alias("kind"), error.alias("error"))


_SOURCES = """sources as (select *, case when k = 'dir' and c_custkey % 4 = 0 or c_custkey % 91 = 0 then 'copy failed: ' || c_name end as error from
   (select c_custkey, c_name, case when c_custkey % 11 = 0 then 'other' when c_custkey % 7 = 0 then 'file' else 'dir' end as k from customer)),
 taken as (select * from sources where k <> 'other' and c_custkey <= coalesce((select min(c_custkey) from sources where k = 'file' and error is not null), 1 << 40))"""


@query(f"with {_SOURCES} select count_if(error is null) as imported, count_if(error is not null and k = 'dir') as failed, max(error) filter (k = 'file') as aborted from taken")
def import_report(spark, sf_dir):
    return catalog.import_report(_sources(spark, sf_dir))


@query(f"with {_SOURCES} select c_custkey as ord, error from taken where k = 'dir' and error is not null")
def import_errors(spark, sf_dir):
    return catalog.import_errors(_sources(spark, sf_dir))


@query(f"""with {_SOURCES}, f as (select c_name as source, c_name || '/f' || (o_orderkey % 10) as rel_path, o_orderkey % 3 as third, max(floor(o_totalprice)::bigint) as length from customer join orders on o_custkey = c_custkey group by 1, 2, 3),
 a as (select rel_path, max(length) as length from f where third > 0 group by 1), b as (select rel_path, length from f where third = 0 and source in (select c_name from taken where error is null))
 select coalesce(b.rel_path, a.rel_path) as rel_path, coalesce(b.length, a.length) as length from a full join b using (rel_path)""")
def import_packages(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("source"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.floor("o_totalprice").cast("bigint").alias("length"))
    files = customer.join(orders, "c_custkey").withColumn("rel_path", F.concat("source", F.lit("/f"), F.col("o_orderkey") % 10))
    existing = files.where("o_orderkey % 3 > 0").groupBy("rel_path").agg(F.max("length").alias("length"))
    incoming = files.where("o_orderkey % 3 = 0").groupBy("source", "rel_path").agg(F.max("length").alias("length"))
    return jobs.import_packages(existing, incoming, _sources(spark, sf_dir))[0]


@query("select count(*) as entries from events")
def activity_count(spark, sf_dir):
    return activity.activity_count(_events(spark, sf_dir))


@query("""with e as (select user_id as task_id, event_type as tone, ts, event_id, lag(ts) over w as pts, lag(event_type) over w as pt from events window w as (partition by user_id order by ts, event_id)),
 r as (select *, sum(case when pts is null or ts - pts > interval 10 minutes or tone is distinct from pt then 1 else 0 end) over (partition by task_id order by ts, event_id) as run from e)
 select task_id, run::bigint as run, tone, min(ts) as first_ts, max(ts) as last_ts, count(*) as repeats from r group by task_id, run, tone order by first_ts desc, task_id desc, run desc limit 4""")
def activity_toasts(spark, sf_dir):
    return activity.toasts(_events(spark, sf_dir), 600, per=("task_id",), order=("ts", "event_id"))


@query("""with t as (select user_id as task_id, min(ts) + interval 1 day as start_ts, max(ts) - interval 1 day as end_ts from events group by user_id),
 e as (select e.user_id as task_id, e.event_id, e.ts from events e join t on t.task_id = e.user_id where e.ts between start_ts and end_ts),
 c as (select task_id, event_id, count(*) over (partition by task_id order by ts, event_id rows unbounded preceding) as completed, count(*) over (partition by task_id) as total from e)
 select *, least(100, floor(completed::double / total * 100 + 0.5))::bigint as percent from c""")
def task_view(spark, sf_dir):
    e = _events(spark, sf_dir)
    tasks = e.groupBy("task_id").agg((F.min("ts") + F.expr("interval 1 day")).alias("start_ts"), (F.max("ts") - F.expr("interval 1 day")).alias("end_ts"))
    return jobs.task_view(e, tasks)


@query("select user_id as task_id, count_if(event_type <> 'error' and event_id % 9 > 0) as completed, count(*) as total from events group by user_id")
def task_counts(spark, sf_dir):
    items = _events(spark, sf_dir).select("task_id", ((F.col("tone") != "error") & (F.col("event_id") % 9 > 0)).alias("ok"))
    return activity.task_counts(items)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
