"""Layer tables: which layers are read, with which attributes, for which group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Layer | attributes | simplify metres | prefix | group, by set, in order.
DEFAULT = """
tlm_strassen_strasse | objektart wanderwege belagsart kunstbaute stufe verkehrsbedeutung verkehrsbeschraenkung befahrbarkeit richtungsgetrennt strassenname | 1 | tlm | transport
tlm_bb_bodenbedeckung | objektart | 2 | tlm | landCover
tlm_gewaesser_fliessgewaesser | objektart name verlauf | 1 | tlm | water
tlm_gewaesser_stehendes_gewaesser | objektart name | 2 | tlm | water
tlm_bauten_gebaeude_footprint | objektart nutzung | 0.5 | tlm | built
tlm_oev_eisenbahn | objektart name | 1 | tlm | transport
tlm_oev_uebrige_bahn | objektart name | 1 | tlm | transport
tlm_areale_nutzungsareal | objektart name | 2 | tlm | landCover
tlm_areale_freizeitareal | objektart name | 2 | tlm | landCover
tlm_areale_verkehrsareal | objektart name | 2 | tlm | transport
tlm_namen_flurname | uuid objektart name | 0 | tlm | names
tlm_namen_siedlungsname_zentrum | uuid objektart name einwohnerkategorie | 0 | tlm | names
tlm_oev_haltestelle | objektart name | 0 | tlm | transport
tlm_eo_einzelobjekt | uuid objektart name | 0 | tlm | built
"""
HUTS = """
accomodation_winter | name | 0 | sac | built
"""
WINTER = """
ski_network | discipline access direction route_info | 2 | sac | winter
ski_routes | discipline name difficulty ascent_altitude ascent_time_label target_name target_altitude route_nr | 2 | sac | winter
Schneeschuhwanderwege | NameR NrR TechnikR KonditionR Routenart | 2 | swm | winter
Winterwanderwege | NameR NrR KonditionR Routenart | 2 | swm | winter
"""
CYCLE = """
VeloWeg | ObjektArt BelagTLM VerkehrM | 2 | astra | cycling
MTBWeg | IsSTrail Technik InfraMtb BelagTLM | 2 | astra | cycling
Route | NameR NrR Routenart TechnikR KonditionR | 2 | astra | cycling
"""
# Groups in panel order, and what each preset needs beyond the base.
GROUPS = ["landCover", "water", "transport", "built", "names", "winter", "cycling"]
PRESETS = {
    "hiking": {"base"}, "cycling": {"base", "cycle"}, "skimo": {"base", "winter"},
    "full": {"base", "cycle", "winter"},
}

SCHEMA = "pos int, needs string, layer string, attributes array<string>, simplify_m double, prefix string, grp string"


def spec_rows() -> list[tuple]:
    rows = []
    for needs, text in (("base", DEFAULT), ("base", HUTS), ("winter", WINTER), ("cycle", CYCLE)):
        for line in text.strip().splitlines():
            layer, attributes, simplify, prefix, group = [p.strip() for p in line.split("|")]
            rows.append((len(rows), needs, layer, attributes.split(), float(simplify), prefix, group))
    return rows


def layer_specs(spark: SparkSession) -> DataFrame:
    """The 22 layers as a table; users edit a copy of it."""
    return spark.createDataFrame(spec_rows(), SCHEMA)


def select_available(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist; the rest are ignored."""
    return df.select(*[c for c in wanted if c in df.columns])


def resolve_layers(specs: DataFrame, have: DataFrame) -> DataFrame:
    """Each ``spec`` to a layer name: the exact one, else the first that starts with it.

    Both sides are catalogue-sized. Names are joined on their first character, so the
    prefix test runs inside an equi-join.
    """
    left = specs.withColumn("__c", F.substring("spec", 1, 1))
    right = have.withColumn("__d", F.substring("layer", 1, 1))
    exact_first = F.struct(F.col("layer") != F.col("spec"), F.col("layer"))
    return (
        left.join(right, (F.col("__c") == F.col("__d")) & F.col("layer").startswith(F.col("spec")), "left")
        .groupBy("spec")
        .agg(F.min_by("layer", exact_first).alias("layer"))
    )


def missing_layers(specs: DataFrame, have: DataFrame) -> DataFrame:
    """Specs that resolve to nothing."""
    return resolve_layers(specs, have).filter("layer is null").select("spec")


def gate(rows: DataFrame, excluded: DataFrame, presets: list[str]) -> DataFrame:
    """Rows (layer, needs, ...) repeated for every preset that reads their source."""
    allowed = {need: [p for p in presets if need in PRESETS[p]] for need in ("base", "winter", "cycle")}
    chosen = F.array().cast("array<string>")
    for need, names in allowed.items():
        chosen = F.when(
            F.col("needs") == need, F.array(*[F.lit(n) for n in names]).cast("array<string>")
        ).otherwise(chosen)
    return rows.join(excluded, "layer", "left_anti").withColumn("preset", F.explode(chosen))


def needed_layers(spark: SparkSession, presets: list[str]) -> DataFrame:
    """Distinct layers a set of presets reads, in group order."""
    needs = set().union(*[PRESETS[p] for p in presets])
    group_pos = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), F.col("grp"))
    return (
        layer_specs(spark).filter(F.col("needs").isin(sorted(needs)))
        .select("layer", "grp", group_pos.alias("group_pos"), "pos").distinct()
        .orderBy("group_pos", "pos")
    )


def groups_of(layers: DataFrame, specs: DataFrame) -> DataFrame:
    """Group of each ``layer`` by the first spec that equals it or is a prefix of it, or
    that it is a prefix of."""
    right = specs.select(F.col("layer").alias("__spec"), F.col("grp").alias("__grp"), F.col("pos").alias("__pos"))
    hit = F.col("layer").startswith(F.col("__spec")) | F.col("__spec").startswith(F.col("layer"))
    same_start = F.substring("layer", 1, 1) == F.substring("__spec", 1, 1)
    return (
        layers.join(right, same_start & hit, "left")
        .groupBy("layer")
        .agg(F.min_by("__grp", "__pos").alias("grp"))
    )


def counts_by_group(
    counts: DataFrame, specs: DataFrame, excluded: DataFrame, presets: list[str]
) -> DataFrame:
    """(preset, grp, n) from (layer, n): exclusions and preset gating; absent groups are 0."""
    rows = gate(specs.join(counts, "layer", "left"), excluded, presets)
    return rows.groupBy("preset", "grp").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
