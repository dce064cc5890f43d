"""From grid coordinates and district names to a coordinate for every corridor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calzada.functions.projection import from_grid
from calzada.functions.text import match_key
from calzada.sources.workspace import materialise

# City box, city centre and the point used for each district name; the first name
# found in a district's text counts.
LAT_BOX = (6.0, 6.5)
LON_BOX = (-75.8, -75.3)
CITY_CENTRE = (6.245, -75.581)
DISTRICT_POINTS = (
    ("El Poblado", 6.210, -75.565),
    ("La Candelaria", 6.245, -75.570),
    ("Laureles - Estadio", 6.250, -75.590),
    ("Belen", 6.230, -75.600),
    ("Americas", 6.235, -75.595),
    ("Robledo", 6.270, -75.580),
    ("Aranjuez", 6.270, -75.555),
    ("Castilla", 6.280, -75.565),
    ("Doce de Octubre", 6.290, -75.560),
    ("Buenos Aires", 6.235, -75.545),
    ("La America", 6.255, -75.600),
    ("San Javier", 6.260, -75.615),
    ("Villa Hermosa", 6.220, -75.540),
    ("San Cristobal", 6.270, -75.630),
    ("Popular", 6.300, -75.550),
    ("Santa Cruz", 6.290, -75.545),
    ("Manrique", 6.260, -75.540),
    ("Guayabal", 6.210, -75.580),
    ("Corregimientos", 6.300, -75.620),
    ("Poblado", 6.210, -75.565),
    ("Candelaria", 6.245, -75.570),
    ("Laureles", 6.250, -75.590),
)


def first_coordinates(df: DataFrame) -> DataFrame:
    """One row per (corredor, comuna) with its smallest located coordinates.

    A minimum over a struct combines map-side; ranking the rows of a busy corridor would not.
    """
    point = F.struct(F.col("latitud").isNull().alias("a"), F.col("latitud").alias("latitud"),
                     F.col("longitud").isNull().alias("b"), F.col("longitud").alias("longitud"))
    return (
        df.groupBy("corredor", "comuna").agg(F.min(point).alias("p"))
        .select("corredor", "comuna", "p.latitud", "p.longitud")
    )


def to_wgs84(northing: Column, easting: Column) -> Column:
    """Struct (latitud, longitud) in degrees; NULL if missing, 0 or outside the city's box."""
    lat, lon = from_grid(northing, easting)
    usable = northing.isNotNull() & easting.isNotNull() & (northing != 0) & (easting != 0)
    inside = lat.between(*LAT_BOX) & lon.between(*LON_BOX)
    return F.when(usable & inside, F.struct(F.round(lat, 6).alias("latitud"), F.round(lon, 6).alias("longitud")))


def district_point(district: Column) -> Column:
    """Struct of the first listed name the text contains; NULL for none."""
    text = F.lower(district)
    usable = ~F.coalesce(district, F.lit("")).isin("", "None")
    return F.coalesce(*[
        F.when(usable & text.contains(name.lower()),
               F.struct(F.lit(lat).alias("latitud"), F.lit(lon).alias("longitud")))
        for name, lat, lon in DISTRICT_POINTS
    ])


def convert(df: DataFrame) -> DataFrame:
    """Grid coordinates of each pair as degrees, NULL where they are no use."""
    return df.withColumn("p", to_wgs84(F.col("latitud"), F.col("longitud"))).select(
        "corredor", "comuna", "p.latitud", "p.longitud")


def fill_from_district(df: DataFrame) -> DataFrame:
    point = F.coalesce(
        F.when(F.col("latitud").isNotNull(), F.struct("latitud", "longitud")), district_point(F.col("comuna")))
    return df.withColumn("p", point).select("corredor", "comuna", "p.latitud", "p.longitud")


def fill_from_corridor(df: DataFrame) -> DataFrame:
    """Mean of the corridor's known points where a pair has none."""
    means = df.where(F.col("latitud").isNotNull()).groupBy("corredor").agg(
        F.avg("latitud").alias("m_lat"), F.avg("longitud").alias("m_lon"))
    return df.join(means, "corredor", "left").select(
        "corredor", "comuna", F.coalesce("latitud", "m_lat").alias("latitud"),
        F.coalesce("longitud", "m_lon").alias("longitud"))


def fill_from_city(df: DataFrame) -> DataFrame:
    lat, lon = CITY_CENTRE
    return df.na.fill({"latitud": lat, "longitud": lon})


def corridor_coordinates(traffic: DataFrame) -> DataFrame:
    """(corredor, comuna, latitud, longitud) in degrees for every pair in the table.

    The pairs are read twice further on, so they are written down first; the readings are not.
    """
    pairs = first_coordinates(traffic.select("corredor", "comuna", "latitud", "longitud"))
    known = materialise(pairs.transform(convert).transform(fill_from_district), "pairs")
    return known.transform(fill_from_corridor).transform(fill_from_city)


def one_point_per_corridor(coordinates: DataFrame) -> DataFrame:
    """(clave, corredor, latitud, longitud): the point of the corridor's first district by name."""
    pick = F.min(F.struct(F.col("comuna").isNull().alias("n"), F.col("comuna").alias("comuna"),
                          F.col("latitud").alias("latitud"), F.col("longitud").alias("longitud")))
    return (
        coordinates.where(F.col("corredor").isNotNull()).groupBy("corredor").agg(pick.alias("p"))
        .select(match_key(F.col("corredor")).alias("clave"), "corredor", "p.latitud", "p.longitud")
    )
