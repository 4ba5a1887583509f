"""IP geography: longest-prefix lookup in a CIDR table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions import net
from emberwatch.operators import kernels
from emberwatch.operators.staging import staged
from emberwatch.packaging import ship

#: Tables with more networks are flattened by Spark.
ON_DRIVER = 10_000
PLACE = ["city", "country", "cc", "lat", "lon", "org"]
GEO_SCHEMA = (
    "cidr string, city string, country string, cc string, lat double, lon double, org string"
)

# Cidr, city, country, country code, latitude, longitude, organisation.
SHIPPED_GEO = [
    ("10.0.0.0/8", "Frankfurt DC", "Germany", "DE", 50.11, 8.68, "Internal (corp)"),
    ("172.16.0.0/12", "Frankfurt DC", "Germany", "DE", 50.11, 8.68, "Internal (corp)"),
    ("192.168.0.0/16", "Office LAN", "Germany", "DE", 50.11, 8.68, "Internal (corp)"),
    ("203.0.113.0/24", "Bucharest", "Romania", "RO", 44.43, 26.11, "AS9009 M247"),
    ("198.51.100.0/24", "Sao Paulo", "Brazil", "BR", -23.55, -46.63, "AS263073 Hostwind"),
    ("192.0.2.0/24", "Ashburn", "United States", "US", 39.04, -77.49, "AS14061 DigitalOcean"),
    ("82.102.20.0/22", "London", "United Kingdom", "GB", 51.51, -0.13, "AS9009 M247"),
    ("103.21.244.0/22", "Singapore", "Singapore", "SG", 1.35, 103.82, "AS13335 Cloudflare"),
    ("185.220.101.0/24", "Nuremberg", "Germany", "DE", 49.45, 11.08,
     "AS205100 F3 Netze (Tor exit)"),
    ("45.83.220.0/22", "Amsterdam", "Netherlands", "NL", 52.37, 4.9, "AS60117 Host Sailor"),
    ("91.219.236.0/22", "Moscow", "Russia", "RU", 55.75, 37.62, "AS49505 Selectel"),
    ("41.220.108.0/22", "Lagos", "Nigeria", "NG", 6.52, 3.38, "AS37282 MainOne"),
    ("159.223.0.0/16", "Bangalore", "India", "IN", 12.97, 77.59, "AS14061 DigitalOcean"),
    ("77.83.36.0/22", "Sofia", "Bulgaria", "BG", 42.7, 23.32, "AS204957 Neterra"),
]


def shipped_geo(spark: SparkSession) -> DataFrame:
    """The bundled CIDR table; any table of GEO_SCHEMA can take its place.

    From Arrow it becomes a local relation, whose small size Spark then knows.
    """
    columns = [c.split()[0] for c in GEO_SCHEMA.split(", ")]
    table = pa.table(dict(zip(columns, map(list, zip(*SHIPPED_GEO)))))
    return spark.createDataFrame(table)


def _flattened(networks: Iterable[tuple]) -> Iterator[tuple]:
    """(first, last, place) of disjoint ranges, from (first, length, last, place) in that order.

    Networks hold each other or are apart; where one lies in another, the inner one's place counts.
    """
    holders: list[tuple] = []  # (last, place) of the networks around, outermost first
    at = 0

    def left_before(first: int) -> Iterator[tuple]:
        nonlocal at
        while holders and holders[-1][0] < first:
            last, place = holders.pop()
            if at <= last:
                yield at, last, place
                at = last + 1

    for first, _, last, place in networks:
        yield from left_before(first)
        if holders and at < first:
            yield at, first - 1, holders[-1][1]
        at = first
        holders.append((last, place))
    yield from left_before(1 << 33)


def _networks(geo: DataFrame) -> DataFrame:
    """(first, length, last, place) of each network; of one that is listed twice, the smaller place."""
    bits = F.split_part(F.col("cidr"), F.lit("/"), F.lit(2)).cast("int")
    base = net.network_base(net.ipv4_number(F.split_part(F.col("cidr"), F.lit("/"), F.lit(1))), bits)
    size = F.call_function("shiftright", F.lit(1 << 32).cast("bigint"), bits)
    return (
        geo.select(base.alias("first"), bits.alias("length"), (base + size - 1).alias("last"), F.struct(*PLACE).alias("place"))
        .where("first IS NOT NULL")
    )


def ranges(geo: DataFrame) -> DataFrame:
    """The table as disjoint ranges of addresses (block, first, last, place) that end at borders of /16.

    Tables of up to ON_DRIVER networks become a local relation, whose size Spark knows. Larger ones
    are flattened by Spark, one /16 at a time, and staged.
    """
    networks = _networks(geo)
    kind = networks.schema["place"].dataType.simpleString()
    ddl = f"block bigint, first bigint, last bigint, place {kind}"
    few = networks.limit(ON_DRIVER + 1).collect()
    if len(few) <= ON_DRIVER:
        ordered = sorted(few, key=lambda r: (r.first, r.length, r.last, [(x is not None, x) for x in r.place]))
        seen: dict[tuple, tuple] = {}
        for r in ordered:
            seen.setdefault((r.first, r.length, r.last), r.place)
        rows = [
            (block, max(first, block << 16), min(last, (block << 16) + 0xFFFF), place)
            for first, last, place in _flattened((*k, place) for k, place in seen.items())
            for block in range(first >> 16, (last >> 16) + 1)
        ]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        fields = [pa.field(f.name, pa.float64() if f.dataType.simpleString() == "double" else pa.string()) for f in networks.schema["place"].dataType]
        places = pa.array([dict(zip(PLACE, p, strict=True)) for p in columns[3]], pa.struct(fields))
        whole = [pa.array(c, pa.int64()) for c in columns[:3]]
        return geo.sparkSession.createDataFrame(pa.table([*whole, places], names=["block", "first", "last", "place"]))
    ship(geo.sparkSession)
    block = F.explode(F.sequence(F.shiftright("first", 16), F.shiftright("last", 16)))
    start = F.shiftleft("block", 16)
    cut = networks.withColumn("block", block).select(
        "block", F.greatest("first", start).alias("first"), "length", F.least(F.col("last"), start + 0xFFFF).alias("last"), "place"
    )
    once = cut.groupBy("block", "first", "length", "last").agg(F.min("place").alias("place"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in kernels.whole_groups(batches, ["block"]):
            edges = [*np.flatnonzero(kernels.group_starts(table, ["block"])).tolist(), len(table)]
            columns = [table.column(c).to_pylist() for c in ("first", "length", "last")]
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                out += _flattened(zip(*(c[a:b] for c in columns), range(a, b), strict=True))
            first, last, of = zip(*out, strict=True)
            at = pa.array(of, pa.int64())
            made = pa.table(
                [table.column("block").take(at), pa.array(first, pa.int64()), pa.array(last, pa.int64()), table.column("place").take(at)],
                names=["block", "first", "last", "place"],
            )
            yield from made.combine_chunks().to_batches()

    ordered = once.repartition("block").sortWithinPartitions("block", "first", "length", "last")
    return staged(ordered.mapInArrow(task, ddl))


def with_place(rows: DataFrame, geo: DataFrame, ip: str, prefix: str = "") -> DataFrame:
    """Rows with the place of an address column; unknown addresses get NULLs.

    One join on the address's /16 with a range test; at most one range holds an address. A table
    that Spark can send to the tasks leaves the rows where they are; with a larger one, rows without
    an address are dealt out evenly and a hot address is left to adaptive execution.
    """
    found = ranges(geo).select(
        F.col("block").alias("_block"), F.col("first").alias("_first"), F.col("last").alias("_last"),
        *(F.col(f"place.{c}").alias(prefix + c) for c in PLACE),
    )
    apart = -1 - F.spark_partition_id().cast("bigint")
    asked = rows.withColumn("_n", net.ipv4_number(F.col(ip))).withColumn(
        "_16", F.coalesce(F.shiftright("_n", 16), apart)
    )
    inside = (F.col("_16") == F.col("_block")) & (F.col("_n") >= F.col("_first")) & (F.col("_n") <= F.col("_last"))
    return asked.join(found, inside, "left").drop("_n", "_16", "_block", "_first", "_last")


def locate(ips: DataFrame, geo: DataFrame, ip: str = "ip") -> DataFrame:
    """Distinct addresses with the place of their longest matching prefix; unknown ones are left out."""
    found = ranges(geo)
    number = net.ipv4_number(F.col("ip"))
    inside = (F.shiftright("_n", 16) == F.col("block")) & (F.col("_n") >= F.col("first")) & (F.col("_n") <= F.col("last"))
    asked = ips.select(F.col(ip).alias("ip")).distinct().withColumn("_n", number)
    return asked.join(found, inside).select("ip", "place.*")


def place_label(city: Column, cc: Column, org: Column) -> Column:
    """'City, CC <middle dot> organisation', or a note that the place is unknown."""
    return F.coalesce(
        F.concat(city, F.lit(", "), cc, F.lit(" · "), org), F.lit("not in geo table")
    )
