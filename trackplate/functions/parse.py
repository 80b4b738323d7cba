"""Column expressions that read meaning out of names and paths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: grammar of condition labels, file tokens, suffixes and stamps
CONDITION = r"^(.+?)\s+(\d+)\s*([Jj]|[uUµ][Mm])$"
DOSE_TOKEN = r"(?i)^(\d+)(J|uM|µM)$"
PLATE_TOKEN = r"(?i)^p(\d+)$"
QUADRANT = r"(?i)_([NS][EW])$"
STAMP = r"(?<!\d)(\d{8}T\d{6})(?!\d)"
UNPARSED = "__unparsed__"
IMAGE_EXTENSIONS = ("tif", "tiff", "png", "jpg", "jpeg")
REFERENCE_STRAINS = ("n2", "wt", "wildtype", "wild-type", "wild_type", "control", "ctrl")
CATEGORIES = {"survivor": ["L3", "L4", "young adult", "adult"], "non_survivor": ["L1", "L2"], "excluded": ["egg"]}
STAGE_INDEX = {"l1": 1.0, "l2": 2.0, "l3": 3.0, "l4": 4.0, "young adult": 4.5, "adult": 5.0}
UNSAFE = '\\/:*?"<>|'


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def parse_condition(label: Column) -> Column:
    """Struct (strain, dose, unit); strain = label and NULL dose when it does not parse."""
    s = F.trim(label)
    ok = s.rlike(CONDITION)
    unit = F.regexp_extract(s, CONDITION, 3)
    canon = F.when(F.lower(unit) == "j", "J/m²").otherwise("µM")
    return F.struct(
        F.when(ok, F.regexp_extract(s, CONDITION, 1)).otherwise(label).alias("strain"),
        ok.alias("parsed"),
        _some(F.regexp_extract(s, CONDITION, 2)).cast("long").alias("dose"),
        F.when(ok, canon).otherwise("").alias("unit"))


def stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def parse_tokens(stem_col: Column) -> Column:
    """Struct (strain, dose, unit, plate); NULL unless a dose and a plate token exist."""
    parts = F.split(stem_col, "_")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    dose = F.get(F.filter(rest, lambda t: t.rlike(DOSE_TOKEN)), F.lit(0))
    plate = F.get(F.filter(rest, lambda t: t.rlike(PLATE_TOKEN)), F.lit(0))
    unit = F.when(F.lower(F.regexp_extract(dose, DOSE_TOKEN, 2)) == "j", "J").otherwise("µM")
    out = F.struct(F.get(parts, F.lit(0)).alias("strain"),
                   _some(F.regexp_extract(dose, DOSE_TOKEN, 1)).cast("long").alias("dose"), unit.alias("unit"),
                   _some(F.regexp_extract(plate, PLATE_TOKEN, 1)).cast("long").alias("plate"))
    return F.when(dose.isNotNull() & plate.isNotNull(), out)


def path_place(path: Column) -> Column:
    """Struct (condition, plate) from a path relative to its root, by depth."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.struct(
        F.when(n <= 2, "default").otherwise(F.get(parts, n - 3)).alias("condition"),
        F.when(n == 1, stem(path)).otherwise(F.get(parts, n - 2)).alias("plate"))


def resolve_place(path: Column, mode: Column) -> Column:
    """(condition, plate) under 'filename' or 'directory' mode."""
    name = F.element_at(F.split(path, "/"), -1)
    tok = parse_tokens(stem(name))
    plate = F.concat(F.lit("p"), F.lpad(tok["plate"].cast("string"), 2, "0"))
    by_name = F.when(tok.isNull(), F.struct(F.lit(UNPARSED).alias("condition"), stem(name).alias("plate"))).otherwise(
        F.struct(F.concat(tok["strain"], F.lit(" "), tok["dose"].cast("string"), tok["unit"]).alias("condition"),
                 F.when(tok["plate"] > 99, F.concat(F.lit("p"), tok["plate"].cast("string"))).otherwise(plate).alias("plate")))
    return F.when(mode == "filename", by_name).otherwise(path_place(path))


def quadrant(stem_col: Column) -> Column:
    q = F.regexp_extract(stem_col, QUADRANT, 1)
    return F.when(q != "", F.upper(q)).otherwise(stem_col)


def capture_time(stem_col: Column) -> Column:
    """Zone-free capture stamp in the name; NULL when absent or not a date.

    The array of one binds the stamp, so that a name is searched once and not for every part.
    """
    def at_time(found: Column) -> Column:
        raw = _some(found)
        year, month, day, hour, minute, second = (
            F.substring(raw, at, n).cast("int") for at, n in ((1, 4), (5, 2), (7, 2), (10, 2), (12, 2), (14, 2)))
        return F.when(second < 60, F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(16,6)")))

    return F.get(F.transform(F.array(F.regexp_extract(stem_col, STAMP, 1)), at_time), F.lit(0))


def is_image(path: Column, depth: int = 3, extensions=IMAGE_EXTENSIONS) -> Column:
    """Image extension, at most `depth` levels, no folder starting with _ or ."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return ext.isin(*extensions) & (F.size(parts) <= depth) & ~F.exists(dirs, lambda d: d.rlike(r"^[_.]"))


def is_data_file(path: Column) -> Column:
    """Not hidden, not a thumbnail, not a hash or acknowledgement sidecar."""
    name = F.element_at(F.split(path, "/"), -1)
    return (~name.startswith(".") & ~F.array_contains(F.split(path, "/"), ".thumbs")
            & ~F.lower(name).endswith(".sha256") & ~F.lower(name).endswith(".acked"))


def _lookup(table: Mapping, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def stage_category(stage: Column, categories: Mapping = CATEGORIES) -> Column:
    table = {s.strip().lower(): cat for cat, names in categories.items() for s in names}
    return F.coalesce(_lookup(table, F.lower(F.trim(stage))), F.lit("unmapped"))


def stage_index(stage: Column) -> Column:
    return _lookup(STAGE_INDEX, F.lower(F.trim(stage)))


def safe_name(text: Column, longest: int = 200) -> Column:
    """Path-safe text: unsafe characters to _, outer dots and blanks cut, never empty."""
    t = F.translate(text, UNSAFE, "_" * len(UNSAFE))
    t = F.substring(F.btrim(t, F.lit(". ")), 1, longest)
    return F.when(t == "", "_").otherwise(t)


SHEET_CHARS = 31              # fixed value: longest name of a sheet


def sheet_name(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"[\[\]:*?/\\]", "_"), 1, SHEET_CHARS)


def strain_key(name: Column) -> Column:
    """Sort key: reference strains, then names without digits, then the rest."""
    low = F.trim(F.lower(name))
    return F.struct(F.when(low.isin(*REFERENCE_STRAINS), 0).when(~name.rlike(r"\d"), 1).otherwise(2).alias("rank"),
                    low.alias("name"))


def day_label(folder: Column) -> Column:
    """'day N' when the name says so, else its leading YYMMDD as YY-MM-DD, else the name."""
    day = F.regexp_extract(folder, r"(?i)(day\s*\d+)", 1)
    date = F.regexp_extract(folder, r"^(\d{6})", 1)
    dashed = F.concat_ws("-", F.substring(date, 1, 2), F.substring(date, 3, 2), F.substring(date, 5, 2))
    return (F.when(day != "", F.lower(F.trim(F.regexp_replace(day, r"\s+", " "))))
            .when(date != "", dashed).otherwise(folder))


def um_per_px(diameter_mm: Column, radius_px: Column, xres: Column, unit: Column, description: Column) -> Column:
    """Well diameter first, then inch, centimetre and calibrated-um tags, else NULL."""
    micron = description.rlike(r"(?i)unit\s*=\s*(um|micron|micrometer|µm)")
    x = F.when(xres > 0, xres)
    return (F.when(diameter_mm > 0, F.try_divide(diameter_mm * 1000.0, F.lit(2.0) * radius_px))
            .when(unit == 2, F.try_divide(F.lit(25400.0), x))
            .when(unit == 3, F.try_divide(F.lit(10000.0), x))
            .when((F.coalesce(unit, F.lit(1)) == 1) & micron, F.try_divide(F.lit(1.0), x)))


def scale_action(source: Column, canonical: float) -> Column:
    s = source / F.lit(canonical)
    return (F.when(source.isNull(), "skip").when(s == 1.0, "passthrough").when(s < 1.0, "downscale").otherwise("refuse"))


def threshold_scale(sensitivity: Column) -> Column:
    """2.5 ^ ((5 - s) / 5) with s clamped to 0..10."""
    s = F.least(F.lit(10.0), F.greatest(F.lit(0.0), sensitivity.cast("double")))
    return F.pow(F.lit(2.5), (F.lit(5.0) - s) / 5.0)


# fixed values: length bins in um, first match wins
LENGTH_BINS = [("L1", 200, 300), ("L2", 300, 430), ("L3", 430, 600), ("L4", 600, 820), ("adult", 820, 1500)]
# fixed values: egg size in um and roundness, longest animal in um, compact debris, share of a bin that is near its edge
EGG_SIZE, EGG_ROUNDNESS, LONGEST = 70, 0.6, 1500
DEBRIS_SOLIDITY, DEBRIS_ROUNDNESS, EDGE_SHARE = 0.85, 0.75, 0.10


def ribbon_length(area: Column, perimeter: Column) -> Column:
    disc = perimeter * perimeter - F.lit(16.0) * area
    return F.when(disc >= 0, (perimeter + F.sqrt(disc)) / 4.0)


def size_class(length: Column, equiv_diameter: Column, circularity: Column, solidity: Column) -> Column:
    """Struct (cls, near_edge): egg, debris, clump rules, then length bins."""
    round_ = circularity >= EGG_ROUNDNESS
    binned = F.struct(F.lit("?").alias("cls"), F.lit(True).alias("near_edge"))
    for name, lo, hi in reversed(LENGTH_BINS):
        edge = EDGE_SHARE * (hi - lo)
        near = (F.abs(length - lo) < edge) | (F.abs(length - hi) < edge)
        binned = F.when((length >= lo) & (length < hi), F.struct(F.lit(name).alias("cls"), near.alias("near_edge"))).otherwise(binned)

    def named(n):
        return F.struct(F.lit(n).alias("cls"), F.lit(False).alias("near_edge"))

    compact = F.coalesce((solidity >= DEBRIS_SOLIDITY) & (circularity >= DEBRIS_ROUNDNESS), F.lit(False))
    return (F.when(length.isNull() & F.coalesce((equiv_diameter <= EGG_SIZE) & round_, F.lit(False)), named("egg"))
            .when(length.isNull(), named("debris"))
            .when((length <= EGG_SIZE) & round_, named("egg"))
            .when((length > LONGEST) | compact, named("debris")).otherwise(binned))
