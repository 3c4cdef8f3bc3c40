"""Rule tables: classification, access flags, discard, zoom visibility.

Users edit the tables below (or their own DataFrames of the same shape). A table becomes
one expression per row of features, so classifying costs no join and no shuffle.

A rule's condition is a comma-separated list of ``key op value``: ``=`` equal, ``~`` whole
text matches the pattern, ``=*`` present. Keys are tag names such as ``tlm:objektart``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Condition | type | resolution | road class, road speed | "more" lets later
# rules match too. In order of precedence.
LINE_RULES = """
tlm:wanderwege=Alpinwanderweg | 0x10103 | 22 | | more
tlm:wanderwege=Bergwanderweg | 0x10102 | 21 | | more
tlm:wanderwege=Wanderweg | 0x10101 | 20 | | more
tlm:objektart=Klettersteig | 0x10104 | 22
tlm:objektart=Autobahn | 0x01 | 17 | 4 7
tlm:objektart=Autostrasse | 0x02 | 18 | 4 5
tlm:objektart=10m Strasse | 0x03 | 18 | 3 4
tlm:objektart=8m Strasse | 0x04 | 19 | 2 4
tlm:objektart=6m Strasse | 0x05 | 19 | 2 3
tlm:objektart=4m Strasse | 0x06 | 20 | 1 3
tlm:objektart=3m Strasse | 0x06 | 21 | 1 2
tlm:objektart=2m Weg | 0x0a | 22 | 0 1
tlm:objektart=1m Weg | 0x16 | 23 | 0 0
tlm:objektart=1m Wegfragment | 0x16 | 24 | 0 0
tlm:objektart=2m Wegfragment | 0x16 | 24 | 0 0
tlm:objektart=Markierte Spur | 0x16 | 23 | 0 0
tlm:objektart=Verbindung | 0x07 | 22 | 0 1
tlm:objektart=Zufahrt | 0x07 | 22 | 0 1
tlm:objektart=Dienstzufahrt | 0x07 | 22 | 0 1
tlm:objektart=Einfahrt | 0x08 | 21 | 3 3
tlm:objektart=Ausfahrt | 0x08 | 21 | 3 3
tlm:objektart=Platz | 0x07 | 21 | 0 1
tlm:objektart=Faehre | 0x1a | 18 | 0 1
tlm:layer=tlm_oev_eisenbahn | 0x14 | 18
tlm:objektart=Luftseilbahn | 0x10105 | 19
tlm:objektart=Gondelbahn | 0x10105 | 19
tlm:objektart=Sesselbahn | 0x10105 | 20
tlm:objektart=Skilift | 0x10106 | 21
tlm:objektart=Foerderband | 0x10106 | 22
tlm:objektart=Transportseil | 0x10106 | 22
tlm:objektart=Lift | 0x10106 | 22
tlm:layer=tlm_gewaesser_fliessgewaesser, tlm:objektart=Trockenrinne | 0x18 | 23
tlm:layer=tlm_gewaesser_fliessgewaesser, tlm:name=* | 0x1f | 19
tlm:layer=tlm_gewaesser_fliessgewaesser | 0x18 | 21
tlm:layer=tlm_gewaesser_stehendes_gewaesser | 0x1f | 19
contour=elevation, contour_surface=ice | 0x23 | 20
contour=elevation, contour_ext=elevation_major | 0x22 | 18
contour=elevation, contour_ext=elevation_medium | 0x21 | 20
contour=elevation, contour_ext=elevation_minor | 0x20 | 22
sac:layer~ski_network.*, sac:discipline=ski_tour, sac:access=2 | 0x10109 | 20
sac:layer~ski_network.*, sac:discipline=ski_tour, sac:access=1 | 0x10108 | 20
sac:layer~ski_network.*, sac:discipline=ski_tour | 0x10107 | 19
sac:layer~ski_network.*, sac:discipline=ski_snowshoe_tour | 0x1010a | 20
sac:layer~ski_routes.* | 0x10107 | 19
swm:layer=Schneeschuhwanderwege | 0x1010a | 20
swm:layer=Winterwanderwege | 0x1010b | 20
astra:layer=MTBWeg, astra:IsSTrail=1 | 0x1010e | 21
astra:layer=MTBWeg | 0x1010d | 20
astra:layer=VeloWeg | 0x1010c | 20
astra:layer=mountainbikeland_Route, astra:NrR=* | 0x1010d | 19
astra:layer=veloland_Route, astra:NrR=* | 0x1010c | 19
astra:layer=wanderland_Route, astra:NrR=* | 0x10101 | 19
"""
POINT_RULES = """
tlm:layer=tlm_namen_siedlungsname_zentrum, tlm:einwohnerkategorie=* | 0x0400 | 16
tlm:layer=tlm_namen_siedlungsname_zentrum | 0x0600 | 18
tlm:layer=tlm_namen_flurname | 0x6400 | 22
tlm:layer=tlm_eo_einzelobjekt | 0x6400 | 22
sac:layer~accomodation_winter.* | 0x2f08 | 21
tlm:nutzung=Schutzhuette | 0x2f08 | 22
tlm:nutzung~Gasthof abgelegen.* | 0x2a01 | 22
tlm:layer=tlm_oev_haltestelle, tlm:objektart=Haltestelle Bahn | 0x2f17 | 21
tlm:layer=tlm_oev_haltestelle, tlm:objektart=Haltestelle Schiff | 0x2f16 | 21
tlm:layer=tlm_oev_haltestelle, tlm:objektart=Uebrige Bahnen | 0x2f17 | 21
tlm:layer=tlm_oev_haltestelle | 0x2f15 | 22
"""
POLYGON_RULES = """
tlm:objektart=Fels | 0x10201 | 18
tlm:objektart=Fels locker | 0x10201 | 19
tlm:objektart=Felsbloecke | 0x10201 | 20
tlm:objektart=Felsbloecke locker | 0x10201 | 20
tlm:objektart=Lockergestein | 0x10202 | 19
tlm:objektart=Lockergestein locker | 0x10202 | 19
tlm:objektart=Gletscher | 0x10203 | 17
tlm:objektart=Schneefeld Toteis | 0x10204 | 19
tlm:objektart=Wald | 0x10205 | 18
tlm:objektart=Wald offen | 0x10208 | 19
tlm:objektart=Gehoelzflaeche | 0x10206 | 19
tlm:objektart=Gebueschwald | 0x10207 | 20
tlm:objektart=Feuchtgebiet | 0x10209 | 20
tlm:objektart=Reben | 0x1020a | 20
tlm:objektart=Obstanlage | 0x1020b | 21
tlm:objektart=Baumschule | 0x1020b | 21
tlm:layer=tlm_areale_verkehrsareal | 0x1020d | 21
tlm:layer=tlm_areale_freizeitareal | 0x1020e | 20
tlm:layer=tlm_areale_nutzungsareal | 0x1020c | 20
tlm:objektart=Stehende Gewaesser | 0x1020f | 17
tlm:objektart=Fliessgewaesser | 0x10210 | 19
tlm:layer=tlm_bauten_gebaeude_footprint | 0x10211 | 22
slope=30 | 0x10212 | 19
slope=35 | 0x10213 | 19
slope=40 | 0x10214 | 19
slope=45 | 0x10215 | 19
slope=50 | 0x10216 | 19
"""
# Features dropped before classification.
DISCARD_RULES = """
tlm:layer=tlm_gewaesser_fliessgewaesser, tlm:objektart=Seeachse
tlm:layer=tlm_gewaesser_fliessgewaesser, tlm:objektart=Druckstollen
tlm:layer=tlm_gewaesser_fliessgewaesser, tlm:objektart~Druckleitung.*
tlm:layer=tlm_gewaesser_fliessgewaesser, tlm:verlauf~Unterirdisch.*
"""
# Condition | actions. "+" adds where absent, "!" replaces. In order.
ACCESS_RULES = """
tlm:richtungsgetrennt=Wahr | +oneway=yes
tlm:verkehrsbeschraenkung=Allgemeine Verkehrsbeschraenkung | +motor_vehicle=private
tlm:verkehrsbeschraenkung=Allgemeines Fahrverbot | +motor_vehicle=no
tlm:verkehrsbeschraenkung=Zeitlich geregelt | +motor_vehicle=private
tlm:verkehrsbeschraenkung=Gesperrt | +access=no
tlm:verkehrsbeschraenkung=Militaerstrasse | +access=no +foot=yes
tlm:verkehrsbeschraenkung=Panzerpiste | +access=no +foot=yes
tlm:verkehrsbeschraenkung=Teststrecke | +access=no
tlm:verkehrsbeschraenkung=Rennstrecke | +access=no
tlm:verkehrsbeschraenkung=Gesicherte Kletterpartie | +access=no
tlm:befahrbarkeit=Falsch | +motor_vehicle=no
tlm:kunstbaute~Bruecke.* | +bridge=yes
tlm:kunstbaute=Gedeckte Bruecke | +bridge=yes
tlm:kunstbaute=Steg | +bridge=yes +motor_vehicle=no
tlm:kunstbaute=Tunnel | +tunnel=yes
tlm:kunstbaute=Galerie | +tunnel=yes
tlm:kunstbaute~Unterfuehrung.* | +tunnel=yes
tlm:kunstbaute~.*Treppe.* | +foot=yes +motor_vehicle=no +bicycle=no
tlm:kunstbaute=Furt | +foot=yes +motor_vehicle=no
tlm:belagsart=Natur | +mkgmap:unpaved=1
tlm:stufe=* | +layer=${tlm:stufe}
tlm:objektart=Faehre | +mkgmap:ferry=1 +motor_vehicle=yes
access=no | +mkgmap:foot=no +mkgmap:bicycle=no +mkgmap:car=no +mkgmap:truck=no +mkgmap:bus=no +mkgmap:taxi=no +mkgmap:delivery=no +mkgmap:emergency=no
motor_vehicle=no | +mkgmap:car=no +mkgmap:truck=no +mkgmap:bus=no +mkgmap:taxi=no +mkgmap:delivery=no
motor_vehicle=private | +mkgmap:throughroute=no
bicycle=no | +mkgmap:bicycle=no
foot=yes | !mkgmap:foot=yes
oneway=yes, access=no | +mkgmap:dead-end-check=false
"""
# Resolution of each zoom level, and the reduced profile.
LEVELS = [24, 22, 21, 19, 17]
LEVELS_REDUCED = [24, 22, 20, 18]
DROP_TYPES = ["0x10211", "0x1020d", "0x1020b"]
DROP_LAYERS = ["tlm_namen_flurname", "tlm_eo_einzelobjekt", "tlm_areale_verkehrsareal"]
BUMP = {"lines": 1, "polygons": 1, "points": 2}
CONTOUR_BUMP, MAX_RESOLUTION = 2, 24


@dataclass(frozen=True)
class Rule:
    number: int
    condition: str
    type: str
    resolution: int
    road_class: int | None = None
    road_speed: int | None = None
    more: bool = False


def parse_rules(text: str) -> list[Rule]:
    rules = []
    for line in text.strip().splitlines():
        cells = [c.strip() for c in line.split("|")] + ["", ""]
        road = [int(v) for v in cells[3].split()] or [None, None]
        rules.append(Rule(len(rules), cells[0], cells[1], int(cells[2]), road[0], road[1], cells[4] == "more"))
    return rules


RULES = {"lines": LINE_RULES, "points": POINT_RULES, "polygons": POLYGON_RULES}


def rule_set(kind: str) -> list[Rule]:
    return parse_rules(RULES[kind])


def rules_from_table(table: DataFrame) -> list[Rule]:
    """Rules from a user's table with the fields of :class:`Rule`; it is a small, fixed
    configuration, read on the driver to build the expression."""
    rows = table.orderBy("number").collect()
    return [Rule(**{f: row[f] for f in Rule.__dataclass_fields__}) for row in rows]


def reduced(rules: list[Rule], kind: str) -> list[Rule]:
    """The profile for small screens: three types and three layers dropped, the rest
    shown only when zoomed in further."""
    kept = []
    for rule in rules:
        if rule.type in DROP_TYPES or any(layer in rule.condition for layer in DROP_LAYERS):
            continue
        bump = CONTOUR_BUMP if "contour" in rule.condition else BUMP[kind]
        kept.append(replace(rule, resolution=min(rule.resolution + bump, MAX_RESOLUTION)))
    return kept


def _parts(text: str) -> list[tuple[str, str, str]]:
    """(key, operator, value) of each part of a condition."""
    return [
        (key, op, value.strip())
        for key, op, value in (re.match(r"\s*([\w:.-]+?)(=|~)(.*)$", part).groups() for part in text.split(","))
    ]


def _matches(col: Column, pattern: str) -> Column:
    """Whole-text pattern match; plain prefixes and infixes need no pattern engine."""
    plain = re.fullmatch(r"(\.\*)?([\w ]+)(\.\*)?", pattern)
    if plain and plain.group(3):
        return col.contains(plain.group(2)) if plain.group(1) else col.startswith(plain.group(2))
    return col.rlike(f"^({pattern})$")


def condition(text: str, tag) -> Column:
    """The boolean for a condition text; ``tag`` maps a tag name to its column."""
    out = None
    for key, op, value in _parts(text):
        col = tag(key)
        if op == "~":
            test = _matches(col, value)
        elif value == "*":
            test = col.isNotNull()
        else:
            test = col == value
        test = F.coalesce(test, F.lit(False))
        out = test if out is None else out & test
    return out


def map_tag(tags: str = "tags"):
    """Look tags up in a MAP column."""
    return lambda key: F.try_element_at(F.col(tags), F.lit(key))


def first_rule(rules: list[Rule], tag) -> Column:
    """Number of the first ordinary rule that applies, null where none does.

    Rules on one key and one value, the bulk of a table, share one lookup per key; only
    the others are tested one by one.
    """
    lookups: dict[str, dict[str, int]] = {}
    found = []
    for rule in (r for r in rules if not r.more):
        parts = _parts(rule.condition)
        if len(parts) == 1 and parts[0][1] == "=" and parts[0][2] != "*":
            lookups.setdefault(parts[0][0], {}).setdefault(parts[0][2], rule.number)
        else:
            found.append(F.when(condition(rule.condition, tag), F.lit(rule.number)))
    for key, table in lookups.items():
        pairs = [F.lit(x) for pair in table.items() for x in pair]
        found.append(F.try_element_at(F.create_map(*pairs), tag(key)))
    return F.least(*found, F.lit(None).cast("int"), F.lit(None).cast("int"))


def classify(features: DataFrame, rules: list[Rule], tag) -> DataFrame:
    """One row per (feature, applying rule): every "more" rule that matches before the
    first ordinary one, then that one."""
    out = features.withColumn("first", first_rule(rules, tag))
    more = [
        F.when(condition(r.condition, tag) & (F.col("first").isNull() | (F.col("first") > r.number)), F.lit(r.number))
        for r in rules if r.more
    ]
    hits = F.array_compact(F.array(*more, F.col("first")))
    table = F.array(*[
        F.struct(
            F.lit(r.type).alias("type"), F.lit(r.resolution).alias("resolution"),
            F.lit(r.road_class).cast("int").alias("road_class"), F.lit(r.road_speed).cast("int").alias("road_speed"),
        )
        for r in rules
    ])
    place = F.array_position(F.array(*[F.lit(r.number) for r in rules]), F.col("rule")).cast("int")
    rows = out.withColumn("rule", F.explode(hits)).withColumn("hit", F.element_at(table, place))
    return rows.select(*features.columns, "rule", "hit.type", "hit.resolution", "hit.road_class", "hit.road_speed")


def discard(features: DataFrame, tag, text: str = DISCARD_RULES) -> DataFrame:
    drop = F.lit(False)
    for line in text.strip().splitlines():
        drop = drop | condition(line, tag)
    return features.filter(~drop)


def access_columns(features: DataFrame, tag, text: str = ACCESS_RULES) -> tuple[DataFrame, dict[str, str]]:
    """Add one column per travel-mode tag; the second result maps tag names to columns.

    Rules apply in order: "add" keeps what is there, "set" replaces it. A rule that reads
    a tag written earlier starts a new projection, so no expression repeats another
    rule's work.
    """
    columns: dict[str, str] = {}
    pending: dict[str, Column] = {}
    out = features

    def now(key):
        return F.col(columns[key]) if key in columns else tag(key)

    def flush():
        nonlocal out
        names = {key: "tag_" + re.sub(r"\W", "_", key) for key in pending}
        out = out.withColumns({names[key]: value for key, value in pending.items()})
        columns.update(names)
        pending.clear()

    for line in text.strip().splitlines():
        cond, actions = [c.strip() for c in line.split("|")]
        if any(key in pending for key, _, _ in _parts(cond)):
            flush()
        applies = condition(cond, now)
        for sign, key, value in re.findall(r"([+!])([\w:-]+)=(\S+)", actions):
            ref = re.fullmatch(r"\$\{(.+)\}", value)
            put = F.when(applies, now(ref.group(1)) if ref else F.lit(value))
            before = pending[key] if key in pending else now(key)
            pending[key] = F.coalesce(put, before) if sign == "!" else F.coalesce(before, put)
    flush()
    return out, columns


def derive_access(features: DataFrame, tags: str = "tags", text: str = ACCESS_RULES) -> DataFrame:
    """The same on a MAP column of tags. Tags the rules read leave the map once."""
    read = dict.fromkeys(key for line in text.strip().splitlines() for key, _, _ in _parts(line.split("|")[0]))
    written = re.findall(r"[+!]([\w:-]+)=", text)
    names = {key: f"__tag_{i}" for i, key in enumerate(dict.fromkeys([*read, *written]))}
    work = features.withColumns({name: map_tag(tags)(key) for key, name in names.items()})
    out, columns = access_columns(work, lambda key: F.col(names[key]), text)
    made = F.map_from_arrays(
        F.array(*[F.lit(k) for k in columns]), F.array(*[F.col(c) for c in columns.values()])
    )
    old = F.map_filter(F.col(tags), lambda k, v: ~k.isin(list(columns)))
    merged = F.map_concat(old, F.map_filter(made, lambda k, v: v.isNotNull()))
    return out.withColumn(tags, merged).drop(*columns.values(), *names.values())


def visible(classified: DataFrame, levels: list[int] = LEVELS) -> DataFrame:
    """One row per zoom level at which a feature is drawn."""
    table = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(r).alias("level_res")) for i, r in enumerate(levels)])
    shown = F.filter(table, lambda x: F.col("resolution") <= x["level_res"])
    return classified.select("*", F.inline(shown))
