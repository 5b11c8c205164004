"""Labels and texts shown to riders and operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weather code descriptions.
WEATHER_TEXT = {
    0: "Clear Sky", 1: "Mainly Clear", 2: "Partly Cloudy", 3: "Overcast",
    45: "Foggy", 48: "Rime Fog", 51: "Light Drizzle", 53: "Drizzle", 55: "Heavy Drizzle",
    61: "Light Rain", 63: "Rain", 65: "Heavy Rain",
    71: "Light Snow", 73: "Snow", 75: "Heavy Snow",
    80: "Rain Showers", 81: "Heavy Showers", 95: "Thunderstorm",
}

ARRIVING_BELOW = 30


def weather_text(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in WEATHER_TEXT.items() for x in pair])
    return F.coalesce(F.element_at(names, code), F.lit("Partly Cloudy"))


def eta_text(eta: Column) -> Column:
    """`arriving`, `45s` or `4m 15s`."""
    minutes = F.floor(eta / 60).cast("long")
    seconds = F.pmod(eta, F.lit(60)).cast("long")
    return (
        F.when(eta < ARRIVING_BELOW, "arriving")
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "),
                                    F.lpad(seconds.cast("string"), 2, "0"), F.lit("s")))
        .otherwise(F.concat(seconds.cast("string"), F.lit("s")))
    )


def direction_label(code: Column) -> Column:
    # Labels of the direction codes.
    return (
        F.when(code == "N", "Uptown").when(code == "S", "Downtown")
        .when(code == "0", "→").when(code == "1", "←")
        .otherwise(F.coalesce(F.nullif(code, F.lit("")), F.lit("--")))
    )
