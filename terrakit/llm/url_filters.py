"""URL filters: a temporal join of captures with dated domain lists.

Dated entries (a list adds or removes a domain) become validity intervals. A capture is
judged by the entries that were active when it was fetched, on its host or any parent
domain. Verdicts depend on host and day only, so they are found once for each such pair
and then joined back; intervals are dealt out by month, so a domain with a long history
does not meet all captures of its hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrakit.llm.common import BLANKS

MONTH = 31


def host_of(url: Column) -> Column:
    """The lower-case host of an http(s) address, without port and final dots, an IPv6
    address without its brackets; null where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/@?#]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1)
    return domain_of(F.btrim(found, F.lit("[]")))


def domain_of(name: Column) -> Column:
    """A host or list entry as it is compared: lower case, without white space around it
    and final dots; null where nothing is left."""
    plain = F.rtrim(F.btrim(F.lower(name), F.lit(BLANKS)), F.lit("."))
    return F.when(plain != "", plain)


def intervals(entries: DataFrame) -> DataFrame:
    """``domain, list, since, until`` from ``domain, list, day, action`` rows.

    An ``add`` holds until the next entry of that list and domain, whatever it is; the
    last is open (null ``until``). Of several entries on one day a ``remove`` wins.
    Entries without domain, list or day are left out, as is what holds for no day. A
    domain may be written in any case and with a final dot; it stands for itself and all
    hosts below it. No patterns, ports or paths.
    """
    entries = entries.withColumn("domain", domain_of(F.col("domain")))
    known = entries.filter(F.col("domain").isNotNull() & F.col("list").isNotNull() & F.col("day").isNotNull())
    daily = known.groupBy("domain", "list", "day").agg(F.max(F.col("action") == "remove").alias("off"))
    later = F.lead("day").over(Window.partitionBy("domain", "list").orderBy("day"))
    return daily.withColumn("until", later).filter(~F.col("off")).select(
        "domain", "list", F.col("day").alias("since"), "until"
    )


def judged_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` with ``host``, ``verdict``, ``matched``.

    ``captures`` has ``url`` and ``day`` (a day number). The longest active domain decides;
    on a tie of lists ``allow`` wins over ``block``. ``verdict`` is ``allow``, ``block`` or
    ``none``, ``matched`` the deciding domain.

    - Null or unreadable address, or null day: ``none``.
    - Repeated captures are judged alike, each on its own.
    - Other columns stay; ``host``, ``verdict`` and ``matched`` are replaced.
    - No entries: all ``none``. No captures: empty result.
    """
    rows = captures.withColumn("host", host_of(F.col("url"))).drop("verdict", "matched")
    pairs = rows.select(F.col("host").alias("__h"), F.col("day").alias("__d")).filter("__h is not null and __d is not null").distinct()
    labels = F.split("__h", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    asked = pairs.withColumn("domain", F.explode(suffixes)).withColumn("__m", F.floor(F.col("__d") / MONTH))
    last = pairs.agg(F.max("__d")).first()[0]
    last = F.lit(-1 if last is None else last).cast("long")
    dated = intervals(entries).filter(F.col("since") <= last)
    months = F.sequence(
        F.floor(F.col("since") / MONTH), F.floor(F.greatest("since", F.least(F.col("until") - 1, last)) / MONTH)
    )
    dated = dated.withColumn("__m", F.explode(months))
    active = asked.join(dated, ["domain", "__m"]).filter(
        (F.col("__d") >= F.col("since")) & (F.col("until").isNull() | (F.col("__d") < F.col("until")))
    )
    verdicts = active.groupBy("__h", "__d").agg(
        F.max(F.struct(F.char_length("domain").alias("n"), (F.col("list") == "allow").alias("a"), "domain", "list")).alias("best")
    ).select("__h", "__d", F.col("best.list").alias("verdict"), F.col("best.domain").alias("matched"))
    joined = rows.join(verdicts, (F.col("host") == F.col("__h")) & (F.col("day") == F.col("__d")), "left")
    return joined.drop("__h", "__d").withColumn("verdict", F.coalesce("verdict", F.lit("none")))
