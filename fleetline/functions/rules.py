"""Threshold rules as column expressions. Every threshold is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headway bounds in seconds.
BUNCH_BELOW = 150
GAP_ABOVE = 900
HIGH_BELOW = 75
HIGH_ABOVE = 1500
HOLD_BELOW = 90
FILL_ABOVE = 1200

# Vehicle stop status codes.
STOP_STATUS = {0: "INCOMING_AT", 1: "STOPPED_AT", 2: "IN_TRANSIT_TO"}


def status_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in STOP_STATUS.items() for x in pair])
    return F.coalesce(F.element_at(names, code), F.lit(STOP_STATUS[2]))


def outside(headway: Column, low: int, high: int) -> Column:
    return (headway < low) | (headway > high)


def alert_type(headway: Column, bunch: int = BUNCH_BELOW, gap: int = GAP_ABOVE) -> Column:
    return F.when(headway < bunch, "BUNCHING").when(headway > gap, "GAP").otherwise("NORMAL")


def alert_severity(headway: Column, bunch: int = BUNCH_BELOW, gap: int = GAP_ABOVE,
                   high_bunch: int = HIGH_BELOW, high_gap: int = HIGH_ABOVE) -> Column:
    return (
        F.when(outside(headway, high_bunch, high_gap), "HIGH")
        .when(outside(headway, bunch, gap), "MEDIUM")
        .otherwise("LOW")
    )


def forecast_type(predicted: Column, current: Column,
                  bunch: int = BUNCH_BELOW, gap: int = GAP_ABOVE) -> Column:
    """A forecast counts only while the current headway is still inside the bound."""
    return (
        F.when((predicted < bunch) & (current >= bunch), "PREDICTED_BUNCHING")
        .when((predicted > gap) & (current <= gap), "PREDICTED_GAP")
        .otherwise("STABLE")
    )


def dispatcher_action(kind: Column, headway: Column,
                      hold: int = HOLD_BELOW, fill: int = FILL_ABOVE) -> Column:
    return (
        F.when((kind == "BUNCHING") & (headway < hold), "HOLD TRAIN")
        .when((kind == "GAP") & (headway > fill), "GAP FILL")
        .otherwise("MONITOR")
    )


def normal_text(column: Column) -> Column:
    """Upper case without surrounding spaces; null becomes empty."""
    return F.trim(F.upper(F.coalesce(column, F.lit(""))))


def expected_action(kind: Column, headway: Column,
                    hold: int = HOLD_BELOW, fill: int = FILL_ABOVE) -> Column:
    return dispatcher_action(normal_text(kind), headway, hold, fill)


def congestion_level(trips: Column, stopped: Column) -> Column:
    share = stopped.cast("double") / F.nullif(trips, F.lit(0))
    return (
        F.when((trips >= 10) & (share > 0.4), "HEAVY")
        .when((trips >= 5) & (share > 0.25), "MODERATE")
        .otherwise("LIGHT")
    )


def weather_condition(code: Column) -> Column:
    return (
        F.when(code >= 80, "RAIN_SHOWERS").when(code >= 51, "DRIZZLE")
        .when(code >= 1, "OVERCAST").otherwise("CLEAR")
    )


def weather_risk(precipitation: Column, wind: Column) -> Column:
    """Missing wind counts as calm here, although the reported wind column defaults to 5."""
    rain, breeze = F.coalesce(precipitation, F.lit(0.0)), F.coalesce(wind, F.lit(0.0))
    return (
        F.when((rain > 1.0) | (breeze > 30.0), "HIGH_WEATHER_DISRUPTION")
        .when((rain > 0.0) | (breeze > 15.0), "MODERATE_WEATHER_RISK")
        .otherwise("NORMAL_TRACK_CONDITIONS")
    )


def bottleneck_severity(crowd: Column, kind: Column, severity: Column) -> Column:
    # Severities and their conditions.
    return (
        F.when((crowd == "SURGE") & (kind == "GAP"), "CRITICAL")
        .when(crowd.isin("HIGH", "SURGE") | (severity == "HIGH"), "ELEVATED")
        .otherwise("WATCH")
    )


def bottleneck_recommendation(crowd: Column, kind: Column) -> Column:
    # Recommendation texts and their conditions.
    return (
        F.when((crowd == "SURGE") & (kind == "GAP"), "DEPLOY GAP FILL & PLATFORM CROWD CONTROL")
        .when((crowd == "SURGE") & (kind == "BUNCHING"), "HOLD LEADING TRAIN TO ABSORB PASSENGERS")
        .otherwise("MONITOR PASSENGER SURGE CONGESTION")
    )
