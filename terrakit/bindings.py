"""Geographic readings of the driver tables.

Each binding is one SQL text that both engines run, so a query and its SQL twin see the
same rows. Two have their own Spark form: ``b_tracks`` computes its position column with
:func:`terrakit.operators.ordered.ranked`, which never puts a whole user into one task, and
``b_polys`` explodes its corners in place of a cross join.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

BINDINGS: dict[str, str] = {
    "b_points": """
        select c_custkey id, cast(2480000+(c_custkey*7919)%360000 as double) e,
               cast(1070000+(c_custkey*104729)%230000 as double) n
        from {customer}""",
    "b_segments": """
        select s_suppkey sid, cast(2500000+(s_suppkey*9973)%300000 as double) ax,
               cast(1090000+(s_suppkey*7561)%180000 as double) ay,
               cast(2500000+(s_suppkey*9973)%300000+(s_suppkey*311)%9000-4500 as double) bx,
               cast(1090000+(s_suppkey*7561)%180000+(s_suppkey*577)%9000-4500 as double) b_y
        from {supplier}""",
    "b_tracks": """
        select user_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) i,
               cast(2600000+(event_id*7919)%20000 as double) e,
               cast(1200000+(event_id*104729)%20000 as double) n,
               case when event_id%11=0 then null else cast(400+(event_id*37)%2600 as double) end ele
        from {events}""",
    "b_polys": """
        select n_nationkey poly, 0 ring, v.i i,
               cast(2490000+(n_nationkey%5)*65000+v.dx*40000 as double) e,
               cast(1080000+floor(n_nationkey/5)*42000+v.dy*30000 as double) n
        from {nation} cross join (values (0,0,0),(1,1,0),(2,1,1),(3,0,1),(4,0,0)) v(i,dx,dy)""",
    "b_grid": """
        select c, r, case when k%97=0 then -9999e0
               else 1500e0-(4*(c-20)*(c-20)+2*(r%50-25)*(r%50-25))/10e0+((k*37)%5)/2e0 end z
        from (select p_partkey k, cast((p_partkey-1)%40 as int) c,
                     cast(floor((p_partkey-1)/40) as int) r from {part}) q""",
    "b_features": """
        select l_orderkey*10+l_linenumber id,
               case l_returnflag when 'A' then 'roads' when 'N' then 'cover' else 'names' end layer,
               case when p_size%7=0 then 'k_W' when p_size%7=1 then '' else p_type end objektart,
               p_brand || ' | ' || p_name name, l_quantity width, (l_linenumber%3) access
        from {lineitem} join {part} on l_partkey=p_partkey""",
    "b_assets": """
        select o_custkey cell, 2015+o_orderkey%9 yr, o_orderkey item,
               'swissalti3d_' || cast(2015+o_orderkey%9 as varchar(4)) || '_'
               || cast(2500+o_custkey%300 as varchar(4)) || '-'
               || cast(1100+o_custkey%150 as varchar(4)) || '_2_2056_5728.tif' name
        from {orders}""",
    "b_names": """
        select doc_id uuid,
               case lang when 'de' then 'Hochdeutsch inkl. Lokalsprachen' when 'fr' then 'Franzoesisch'
                    when 'es' then 'Italienisch' else 'Rumantsch' end code,
               translate(coalesce(text,''), chr(10)||chr(13)||';', '   ') name
        from {documents}""",
    "b_addresses": """
        select c_custkey id, case when c_custkey%13=0 then 'planned' else 'real' end adr_status,
               case when c_custkey%4=0 then 'false' else 'true' end adr_official,
               case when c_custkey%17=0 then 'n/a'
                    else cast(2480000+(c_custkey*7919)%360000 as varchar(12)) end adr_easting,
               cast(1070000+(c_custkey*104729)%230000 as varchar(12)) adr_northing,
               c_mktsegment stn_label,
               case when c_custkey%19=0 then '' else cast(c_custkey%200 as varchar(6)) end adr_number,
               case when c_custkey%23=0 then c_name
                    else cast(1000+c_custkey%9000 as varchar(6)) || ' ' || c_name end zip_label
        from {customer}""",
    "b_updates": """
        select user_id run, event_type stage, ts, event_id from {events}""",
    "b_samples": """
        select o_custkey id, count(*) transport, cast(sum(o_orderkey%50) as bigint) built,
               cast(max(o_orderkey%400) as double) area_km2,
               cast(sum(floor(o_totalprice)) as bigint) actual_bytes
        from {orders} group by o_custkey""",
    "b_pixels": """
        select l_suppkey spot, l_orderkey*10+l_linenumber px, (l_partkey*37)%256 cr,
               (l_partkey*91)%256 cg, (l_partkey*53)%256 cb
        from {lineitem}""",
}


def with_bindings(names: list[str], body: str) -> str:
    """The SQL twin's text with the bindings it uses as leading CTEs."""
    plain = {t: t for t in TABLES}
    ctes = [f"{name} as ({BINDINGS[name].format(**plain)})" for name in names]
    body = body.strip()
    nested = re.match(r"(?is)with\s+(?!recursive)", body)
    if nested:
        ctes.append(body[nested.end():])
        return "with " + ",\n".join(ctes)
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body


class Tables:
    """Lazy access to the driver tables and their bindings: ``t.orders``, ``t.b_points``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        # Every SQL twin assumes UTC timestamps.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "b_tracks":
            return self._tracks()
        if name == "b_polys":
            return self._polys()
        if name in BINDINGS:
            return self.sql(BINDINGS[name])
        raise AttributeError(name)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        wanted = set(re.findall(r"\{(\w+)\}", text))
        args = {n: frames[n] if n in frames else getattr(self, n) for n in wanted}
        return self.spark.sql(text, **args)

    def values(self, text: str) -> DataFrame:
        """A small fixed table from a VALUES text, the same text the SQL twin holds."""
        return self.spark.sql(f"select * from ({text})")

    def _polys(self) -> DataFrame:
        key = F.col("n_nationkey")
        corners = F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
            for i, dx, dy in [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)]
        ])
        return self.nation.select(key, F.inline(corners)).select(
            key.alias("poly"), F.lit(0).alias("ring"), "i",
            (2490000 + (key % 5) * 65000 + F.col("dx") * 40000).cast("double").alias("e"),
            (1080000 + F.floor(key / 5) * 42000 + F.col("dy") * 30000).cast("double").alias("n"),
        )

    def _tracks(self) -> DataFrame:
        from terrakit.operators.ordered import ranked

        events = self.events.select("user_id", "ts", "event_id")
        numbered = ranked(
            events, ["user_id"], F.to_date("ts"), ["ts", "event_id"], "i", fine=F.date_trunc("second", "ts")
        )
        key = F.col("event_id")
        return numbered.select(
            "user_id",
            F.col("i").cast("int").alias("i"),
            (2600000 + (key * 7919) % 20000).cast("double").alias("e"),
            (1200000 + (key * 104729) % 20000).cast("double").alias("n"),
            F.when(key % 11 != 0, (400 + (key * 37) % 2600).cast("double")).alias("ele"),
        )
