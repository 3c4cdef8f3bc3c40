"""Rule classification, access flags and zoom visibility.

The driver tables carry no map vocabulary, so each query reads parts or line items as
features: their keys pick values from the vocabulary. The SQL twins write the rules out
by hand for the values that occur.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terrakit.plans import rules
from terrakit.registry import query

KINDS = ["Autobahn", "8m Strasse", "2m Weg", "Klettersteig", "Seeachse", "Skilift", "Faehre"]
TRAILS = ["Wanderweg", "Bergwanderweg", "Alpinwanderweg", None, None]
LIMITS = ["Allgemeine Verkehrsbeschraenkung", "Allgemeines Fahrverbot", "Militaerstrasse", None]
BUILT = ["Steg", "Steinbruecke Treppe", "Tunnel", "Unterfuehrung lang", None]


def pick(values, number):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def pick_sql(values, number):
    cases = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values) if v)
    return f"case {number}%{len(values)} {cases} end"


ROADS = f"""
    select l_orderkey*10+l_linenumber id, {pick_sql(KINDS, 'l_partkey')} kind,
      {pick_sql(TRAILS, 'l_suppkey')} trail, {pick_sql(LIMITS, 'l_orderkey')} lim,
      {pick_sql(BUILT, '(l_partkey+l_suppkey)')} built,
      case when l_partkey%3=0 then 'tlm_gewaesser_fliessgewaesser' else 'tlm_strassen_strasse' end layer
    from lineitem"""


def roads(t):
    part, supp, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    return t.lineitem.select(
        (order * 10 + F.col("l_linenumber")).alias("id"), pick(KINDS, part).alias("kind"),
        pick(TRAILS, supp).alias("trail"), pick(LIMITS, order).alias("lim"),
        pick(BUILT, part + supp).alias("built"),
        F.when(part % 3 == 0, "tlm_gewaesser_fliessgewaesser").otherwise("tlm_strassen_strasse").alias("layer"),
    )


NAMES = {"tlm:objektart": "kind", "tlm:wanderwege": "trail", "tlm:layer": "layer",
         "tlm:verkehrsbeschraenkung": "lim", "tlm:kunstbaute": "built"}


def column_tag(key):
    return F.col(NAMES[key]) if key in NAMES else F.lit(None).cast("string")


HITS = f"""
    with f as ({ROADS}), kept as (
      select * from f where not (layer='tlm_gewaesser_fliessgewaesser' and kind='Seeachse')),
    single as (select *, case kind when 'Klettersteig' then 3 when 'Autobahn' then 4 when '8m Strasse' then 7
        when '2m Weg' then 11 when 'Faehre' then 22 when 'Skilift' then 27
        else case when layer='tlm_gewaesser_fliessgewaesser' then 33 end end r from kept),
    hit as (
      select id, case trail when 'Alpinwanderweg' then 0 when 'Bergwanderweg' then 1 else 2 end r
      from single where trail is not null
      union all select id, r from single where r is not null),
    lut(r, type, resolution, road_class, road_speed) as (values (0,'0x10103',22,null,null),
      (1,'0x10102',21,null,null),(2,'0x10101',20,null,null),(3,'0x10104',22,null,null),(4,'0x01',17,4,7),
      (7,'0x04',19,2,4),(11,'0x0a',22,0,1),(22,'0x1a',18,0,1),(27,'0x10106',21,null,null),(33,'0x18',21,null,null))
"""


def _classified(t, rule_list):
    return rules.classify(rules.discard(roads(t), column_tag), rule_list, column_tag)


@query("b17_rule_classes", "B17 B19", sql=HITS + """
    select id, lut.type, lut.resolution, lut.road_class, lut.road_speed from hit join lut on hit.r=lut.r""")
def _(t):
    return _classified(t, rules.rule_set("lines")).select("id", "type", "resolution", "road_class", "road_speed")


@query("b18_access_flags", "B18", sql=f"""
    with f as ({ROADS}), d as (select id,
      case when lim='Allgemeine Verkehrsbeschraenkung' then 'private' when lim='Allgemeines Fahrverbot' then 'no'
           when built='Steg' or built like '%Treppe%' then 'no' when kind='Faehre' then 'yes' end mv,
      case when lim='Militaerstrasse' then 'no' end access,
      case when lim='Militaerstrasse' or built like '%Treppe%' then 'yes' end foot,
      case when built like '%Treppe%' then 'no' end bicycle,
      case when built='Steg' then 'yes' end bridge,
      case when built='Tunnel' or built like 'Unterfuehrung%' then 'yes' end tunnel,
      case when kind='Faehre' then '1' end ferry from f)
    select id, mv motor_vehicle, access, bridge, tunnel, ferry,
      case when foot='yes' then 'yes' when access='no' then 'no' end mode_foot,
      case when access='no' or bicycle='no' then 'no' end mode_bicycle,
      case when access='no' or mv='no' then 'no' end mode_car,
      case when access='no' then 'no' end mode_emergency,
      case when mv='private' then 'no' end through from d""")
def _(t):
    made, columns = rules.access_columns(roads(t), column_tag)
    picked = {"motor_vehicle": "motor_vehicle", "access": "access", "bridge": "bridge", "tunnel": "tunnel",
              "mkgmap:ferry": "ferry", "mkgmap:foot": "mode_foot", "mkgmap:bicycle": "mode_bicycle", "mkgmap:car": "mode_car",
              "mkgmap:emergency": "mode_emergency", "mkgmap:throughroute": "through"}
    return made.select("id", *[F.col(columns[k]).alias(name) for k, name in picked.items()])


@query("b19_discarded_features", "B19", sql=f"""
    with f as ({ROADS}) select layer, kind, count(*) n from f
    where not (layer='tlm_gewaesser_fliessgewaesser' and kind='Seeachse') group by 1,2""")
def _(t):
    return rules.discard(roads(t), column_tag).groupBy("layer", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("b20_zoom_levels", "B20", sql=HITS + """
    , lev(level, level_res) as (values (0,24),(1,22),(2,21),(3,19),(4,17))
    select level, lut.type, count(*) n from hit join lut on hit.r=lut.r join lev on lut.resolution<=level_res
    group by 1,2""")
def _(t):
    # Counted per rule class before the levels are laid out: 60 rows, not all features.
    classes = _classified(t, rules.rule_set("lines")).groupBy("type", "resolution").agg(F.count(F.lit(1)).alias("c"))
    return rules.visible(classes).groupBy("level", "type").agg(F.sum("c").alias("n"))


@query("b21_reduced_profile", "B21", sql="""
    with f as (select p_partkey id, case p_partkey%5 when 0 then 'Fels' when 1 then 'Obstanlage'
        when 2 then 'Wald' else 'x' end kind, case p_partkey%5 when 3 then 'tlm_bauten_gebaeude_footprint'
        when 4 then 'tlm_areale_nutzungsareal' else 'tlm_bb_bodenbedeckung' end layer from part)
    select id, case when kind='Fels' then '0x10201' when kind='Wald' then '0x10205' else '0x1020c' end type,
      case when kind='Fels' then 19 when kind='Wald' then 19 else 21 end resolution
    from f where kind in ('Fels','Wald') or layer='tlm_areale_nutzungsareal'""")
def _(t):
    k = F.col("p_partkey") % 5
    kind = F.when(k == 0, "Fels").when(k == 1, "Obstanlage").when(k == 2, "Wald").otherwise("x")
    layer = (F.when(k == 3, "tlm_bauten_gebaeude_footprint").when(k == 4, "tlm_areale_nutzungsareal")
             .otherwise("tlm_bb_bodenbedeckung"))
    f = t.part.select(F.col("p_partkey").alias("id"), kind.alias("kind"), layer.alias("layer"))
    small = rules.reduced(rules.rule_set("polygons"), "polygons")
    return rules.classify(f, small, column_tag).select("id", "type", "resolution")
