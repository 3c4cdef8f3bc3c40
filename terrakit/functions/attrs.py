"""Attribute cleaning, naming and text helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no data".
NO_DATA = ["", "k_W", "Keine Angabe"]

# Letters folded for search, in pairs. The sharp s becomes two letters.
FOLD_FROM = "àáâäåãèéêëìíîïòóôöõùúûüçñ"
FOLD_TO = "aaaaaaeeeeiiiiooooouuuucn"

# The tile file name, year and kilometre cell.
TILE_NAME = r"^swissalti3d_([0-9]+)_(-?[0-9]+)-(-?[0-9]+)(?:_.*)?$"
TILE_SUFFIX = "_2_2056_5728.tif"

WMS_ENDPOINT = "https://wms.geo.admin.ch/"


def meaningful(col: Column) -> Column:
    """Null for the sentinel texts."""
    return F.when(~col.isin(NO_DATA), col)


def number_tag(col: Column) -> Column:
    """A real number as tag text: whole numbers without a fraction, non-finite dropped,
    never in exponent form."""
    finite = ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))
    whole = (col == F.floor(col)) & (F.abs(col) < 9.2e18)
    text = col.cast("string")
    plain = F.rtrim(col.try_cast("decimal(38,20)").cast("string"), F.lit("0"))
    return F.when(
        finite, F.when(whole, col.cast("bigint").cast("string")).when(text.contains("E"), plain).otherwise(text)
    )


def names_of(raw: Column) -> Column:
    """The trimmed, non-empty variants of a pipe-separated name."""
    return F.filter(F.transform(F.split(raw, r"[|]"), lambda s: F.trim(s)), lambda s: s != "")


def primary_name(raw: Column) -> Column:
    return F.coalesce(F.try_element_at(names_of(raw), F.lit(1)), raw)


def other_names(raw: Column) -> Column:
    """All but the first variant joined by ``;``, null when there is only one."""
    parts = names_of(raw)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts) - 1), ";"))


def fold(raw: Column) -> Column:
    return F.translate(F.replace(F.lower(F.trim(raw)), F.lit("ß"), F.lit("ss")), FOLD_FROM, FOLD_TO)


ZIP_LABEL = r"^([0-9]+) (.*)$"


def postcode(raw: Column) -> Column:
    """The digits before the first blank, empty where the label starts otherwise."""
    return F.regexp_extract(F.trim(raw), ZIP_LABEL, 1)


def locality(raw: Column) -> Column:
    """What follows the postcode, or the whole label."""
    label = F.trim(raw)
    return F.when(label.rlike(ZIP_LABEL), F.trim(F.regexp_extract(label, ZIP_LABEL, 2))).otherwise(label)


def tags(prefix: str, layer: Column, values: dict[str, Column]) -> Column:
    """MAP of ``prefix:name`` to text, the layer first and null values left out."""
    keys = F.array(F.lit(f"{prefix}:layer"), *[F.lit(f"{prefix}:{k}") for k in values])
    cells = F.array(layer, *values.values())
    return F.map_filter(F.map_from_arrays(keys, cells), lambda k, v: v.isNotNull())


def dataset_key(stem: Column) -> Column:
    return F.lower(F.regexp_replace(stem, "_[0-9]*$", ""))


def tile_year(name: Column) -> Column:
    return F.regexp_extract(name, TILE_NAME, 1).try_cast("int")


def tile_e_km(name: Column) -> Column:
    return F.regexp_extract(name, TILE_NAME, 2).try_cast("int")


def tile_n_km(name: Column) -> Column:
    return F.regexp_extract(name, TILE_NAME, 3).try_cast("int")


def cell_label(e_km: Column, n_km: Column) -> Column:
    return F.format_string("%d-%d", e_km, n_km)


def degree_label(lat: Column, lon: Column) -> Column:
    return F.concat(
        F.when(lat < 0, "S").otherwise("N"), F.lpad(F.abs(lat).cast("string"), 2, "0"),
        F.when(lon < 0, "W").otherwise("E"), F.lpad(F.abs(lon).cast("string"), 3, "0"),
    )


def slug(name: Column) -> Column:
    """Every character outside letters and digits becomes ``-``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]", "-"), "^-+|-+$", "")


def image_file_name(name: Column, exact: Column, several: Column) -> Column:
    plain = F.lit("gmapsupp.img")
    return F.when(exact | ~several, plain).otherwise(
        F.concat(F.lit("gmapsupp-"), slug(name), F.lit(".img"))
    )


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, rounded by its exact value as printf does;
    ``format_string`` rounds the shortest text of the number once more."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def tile_request(layer: str, west, south, east, north, width, height) -> Column:
    """Picture request for one tile; the box is latitude first."""
    head = (
        f"{WMS_ENDPOINT}?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&LAYERS={layer}"
        "&STYLES=&CRS=EPSG:4326&BBOX="
    )
    box = F.concat_ws(",", *[fixed(v, 8) for v in (south, west, north, east)])
    return F.concat(F.lit(head), box, F.format_string("&WIDTH=%d&HEIGHT=%d&FORMAT=image/jpeg", width, height))


def multihash_reason(text: Column) -> Column:
    """Why a checksum text is unusable; null when it is a SHA-256 multihash."""
    hexed = F.lower(F.trim(text))
    size = F.length(hexed)
    declared = F.conv(F.substring(hexed, 3, 2), 16, 10).cast("int")
    return (
        F.when(~hexed.rlike("^[0-9a-f]*$") | (size % 2 == 1), "not hex")
        .when(size < 4, "too short")
        .when(F.substring(hexed, 1, 2) != "12", "unsupported code")
        .when(declared * 2 != size - 4, "wrong length")
    )


def multihash_digest(text: Column) -> Column:
    hexed = F.lower(F.trim(text))
    return F.when(multihash_reason(text).isNull(), F.substring(hexed, 5, 512))


def _bytes(text: Column) -> Column:
    """UTF-8 bytes of a text as BIGINT values."""
    hexed = F.hex(F.encode(text, "utf-8"))
    return F.transform(
        F.filter(F.sequence(F.lit(1), F.length(hexed) + 1, F.lit(2)), lambda i: i < F.length(hexed)),
        lambda i: F.conv(F.substr(hexed, i, F.lit(2)), 16, 10).cast("bigint"),
    )


def fnv32(text: Column) -> Column:
    """FNV-1a, 32 bit, as a BIGINT."""
    return F.aggregate(
        _bytes(text),
        F.lit(2166136261).cast("bigint"),
        lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)),
    )


def fnv64(text: Column) -> Column:
    """FNV-1a, 64 bit, as 16 hex digits.

    The prime is 2^40 + 435, so with the state in two 32-bit halves no product leaves
    the BIGINT range: low*435, and high*435 plus the part of low shifted up by 40 bits.
    """
    mask = F.lit(4294967295)
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))

    def step(h, b):
        low = h["lo"].bitwiseXOR(b)
        product = low * F.lit(435)
        carry = F.shiftright(product, 32)
        up = F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)
        high = (h["hi"] * F.lit(435) + carry + up).bitwiseAND(mask)
        return F.struct(high.alias("hi"), product.bitwiseAND(mask).alias("lo"))

    done = F.aggregate(_bytes(text), start, step)
    return F.lower(
        F.concat(F.lpad(F.hex(done["hi"]), 8, "0"), F.lpad(F.hex(done["lo"]), 8, "0"))
    )


def map_family(key: Column) -> Column:
    return F.lit(6000) + fnv32(key) % 55000


def map_number_base(key: Column) -> Column:
    h = fnv32(key)
    rotated = F.shiftleft(h, 13).bitwiseAND(F.lit(4294967295)).bitwiseOR(F.shiftright(h, 19))
    return F.lit(10_000_000) + (rotated % 8900) * 10_000


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def byte_text(n: Column) -> Column:
    """One decimal and the largest unit up to TB."""
    value = n.cast("double")
    steps = [("B", 1.0), ("KB", 1024.0), ("MB", 1024.0**2), ("GB", 1024.0**3)]
    text = F.format_string("%.1f TB", value / 1024.0**4)
    for unit, size in reversed(steps):
        text = F.when(value < size * 1024.0, F.format_string(f"%.1f {unit}", value / size)).otherwise(text)
    return text


def tinted(r: Column, g: Column, b: Column) -> Column:
    """True for a fill colour: not paper white, ink black or neutral grey."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    grey = (F.abs(r - g) < 4) & (F.abs(g - b) < 4) & (F.abs(r - b) < 4)
    return ~((high > 246) & (low > 240)) & ~(high < 60) & ~grey


def area_fill(r: Column, g: Column, b: Column) -> Column:
    """The stricter fill test used for seasonal medians."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    grey = (F.abs(r - g) < 5) & (F.abs(g - b) < 5) & (F.abs(r - b) < 5)
    return ~((high > 235) & (low > 228)) & ~(high < 90) & ~grey


def ink_fill(r: Column, g: Column, b: Column) -> Column:
    high = F.greatest(r, g, b)
    return (high > 90) & (high < 210)


def first_that(pairs: list[tuple[Column, str]]) -> Column:
    """The label of the first true condition."""
    head, *rest = pairs
    return reduce(lambda acc, p: acc.when(p[0], p[1]), rest, F.when(*head))
