"""Rules on file and package names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four map kinds, and the image extensions in order of preference.
KINDS = ("basecolor", "roughness", "metallic", "normal")
EXTENSIONS = ("png", "tga", "jpg", "jpeg")
DISABLED = ".disabled"
# Names of the uncompressed format, and of block format BC3.
UNCOMPRESSED = ("8.8.8.8", "R8G8B8A8_UNORM")
BLOCKS = ("DXT5", "BC3", "BC3_UNORM")
# The texts of log lines and errors, with places for format_string.
FOUND, DONE = "找到 %d 组完整 PBR 贴图。", "完成 %s"
SPLIT, LEVEL, MADE, CONVERTED = "拆分 %s: %s", "处理 %s", "生成 %s", "转换 %s -> %s"
BAD_FOLDER, NO_LEVELS = "%s无效。", "未找到 p0、p1、p2... mipmap 文件。"
BAD_LEVEL = "p%d 尺寸应为 %dx%d，实际为 %dx%d。"
SPLIT_PARTS = {"c": "BaseColor / Alpha", "n": "Roughness / Metallic / Normal"}


def basename(path: Column) -> Column:
    """What follows the last slash or backslash; the path itself if that is nothing."""
    last = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.coalesce(F.nullif(last, F.lit("")), path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[.]([^./\\]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"^(.+)[.][^.]*$", "$1")


def is_image(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def is_dds(path: Column) -> Column:
    return extension(path) == "dds"


def compact_path(path: Column, fallback: str) -> Column:
    """The base name, or the fallback where there is no path."""
    return F.when(path.isNull() | (path == ""), F.lit(fallback)).otherwise(basename(path))


def folder_error(path: Column, is_dir: Column, label: str) -> Column:
    """The error of a job whose folder is empty, missing (is_dir null) or not a directory; null if it can be used."""
    usable = (path != "") & F.coalesce(is_dir, F.lit(False))
    return F.when(~F.coalesce(usable, F.lit(False)), F.format_string(BAD_FOLDER, F.lit(label)))


def format_kind(name: Column, lenient: bool = False) -> Column:
    """rgba8 or bc3; unknown names are null, or bc3 if lenient."""
    return F.when(name.isin(*UNCOMPRESSED), "rgba8").when(F.lit(lenient) | name.isin(*BLOCKS), "bc3")


def is_uncompressed(name: str, lenient: bool = False) -> bool:
    """The same rule for a job's option; unknown names are an error unless lenient."""
    if name not in UNCOMPRESSED + BLOCKS and not lenient:
        raise ValueError(f"no format is called {name}")
    return name in UNCOMPRESSED


def merge_names(prefix: Column) -> list[Column]:
    return [F.concat(prefix, F.lit("_c.dds")), F.concat(prefix, F.lit("_n.dds"))]


def split_line(stem_: Column, kind: Column, export_alpha: bool = True) -> Column:
    """The log line of a split file; none for files of neither kind."""
    color = SPLIT_PARTS["c"] if export_alpha else "BaseColor"
    return F.when(kind == "c", F.format_string(SPLIT, stem_, F.lit(color))).when(kind == "n", F.format_string(SPLIT, stem_, F.lit(SPLIT_PARTS["n"])))


def convert_line(path: Column) -> Column:
    return F.format_string(CONVERTED, basename(path), convert_name(path))


def map_kind(stem_: Column) -> Column:
    """One of the four kinds, or empty."""
    return F.regexp_extract(F.lower(stem_), f"({'|'.join(KINDS)})$", 1)


def set_prefix(stem_: Column, kind: Column) -> Column:
    return F.regexp_replace(F.substr(stem_, F.lit(1), F.length(stem_) - F.length(kind)), "[_ -]+$", "")


def split_prefix(stem_: Column) -> Column:
    """The stem without repeated _c, then _C, _n, _N at its end, in this order."""
    for end in ("_c", "_C", "_n", "_N"):
        stem_ = F.regexp_replace(stem_, f"({end})+$", "")
    return stem_


def split_kind(stem_: Column) -> Column:
    low = F.lower(stem_)
    return F.when(low.endswith("_c"), "c").when(low.endswith("_n"), "n")


def convert_name(path: Column) -> Column:
    """The stem with its own last extension replaced by .dds; output.dds without a stem."""
    s = stem(path)
    return F.when(s == "", "output.dds").otherwise(F.concat(F.regexp_replace(s, r"^(.+)[.][^.]*$", "$1"), F.lit(".dds")))


def is_disabled(name: Column) -> Column:
    return name.endswith(DISABLED)


def toggled(name: Column) -> Column:
    """Enabled: every trailing mark goes. Otherwise one is added."""
    return F.when(is_disabled(name), F.regexp_replace(name, r"([.]disabled)+$", "")).otherwise(F.concat(name, F.lit(DISABLED)))


def display_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[.]disabled$", "")


def size_text(size: Column) -> Column:
    def in_units(unit: int, name: str) -> Column:
        tenths = F.floor(size * 10 / unit + 0.5)
        return F.format_string("%s.%s %s", (tenths / 10).cast("bigint"), tenths % 10, F.lit(name))

    small = F.concat(size.cast("string"), F.lit(" B"))
    return F.when(size < 1024, small).when(size < 1048576, in_units(1024, "KB")).otherwise(in_units(1048576, "MB"))


def percent(completed: Column, total: Column) -> Column:
    return F.when(total == 0, 0).otherwise(F.least(F.lit(100), F.floor(completed / total * 100 + 0.5))).cast("bigint")
