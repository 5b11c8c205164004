"""A short arrival board that spreads over time and routes.

The board is filled in three passes: one arrival per time bracket from routes not shown yet, then further
unseen routes, then whatever comes next. The passes only ever look at the first rows per key and bracket,
so windows reduce every board to about a hundred rows, and the passes are folds over one short sorted array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetline.functions.ids import blank_to
from fleetline.operators.dedup import top_per_group

# Upper bounds of the time brackets in seconds; the first one means "arriving".
BRACKET_ENDS = (30, 120, 240, 420, 660, 960, 1300, 1800)
ARRIVING = BRACKET_ENDS[0]
MAX_ROWS = 8


def _candidates(df: DataFrame, board: Sequence[str], order: list[str], n: int) -> DataFrame:
    """Rows the passes can reach; with n places, n seen keys can at most hide n others.

    The first rows of each key and bracket are limited before their shuffle. What is left meets once per board, where
    all further ranks are windows over the same shuffle.
    """
    near = top_per_group(df, [*board, "_key", "_bracket"], order, 2 * n, rank="_place")
    lead = (F.col("_place") == 1) & (F.col("_key") != "")
    later = F.col("_bracket") > 0
    nameless = later & (F.col("_key") == "")

    def rank(*groups) -> Column:
        return F.row_number().over(Window.partitionBy(*board, *groups).orderBy(*order))

    ranked = near.withColumns({"_lead": lead, "_later_lead": lead & later, "_nameless": nameless}).withColumns({
        "_any": rank(), "_of_bracket": rank("_bracket", "_lead"), "_of_key": rank("_key", "_later_lead"),
        "_of_nameless": rank("_nameless")})
    ranked = ranked.withColumn("_first_later", F.col("_later_lead") & (F.col("_of_key") == 1)).withColumn(
        "_of_first", rank("_first_later"))
    reached = (
        (F.col("_any") <= 2 * n)
        | (F.col("_lead") & (F.col("_bracket") < len(BRACKET_ENDS)) & (F.col("_of_bracket") <= n))
        | (F.col("_first_later") & (F.col("_of_first") <= 2 * n))
        | (F.col("_nameless") & (F.col("_of_nameless") <= n)))
    return ranked.filter(reached)


def _filled(rows: Column, n: int) -> Column:
    """Indexes into `rows`, an array of (key, bracket, eta) in order, that the three passes choose.

    Brackets rise with the eta, so one walk in order meets the first fitting row of each bracket.
    """
    places = F.transform(rows, lambda r, i: F.struct(i.alias("i"), r["_key"].alias("key"), r["_bracket"].alias("bracket"),
                                                     r["eta_seconds"].alias("eta")))
    none = F.struct(F.array().cast("array<int>").alias("chosen"), F.array().cast("array<string>").alias("seen"),
                    F.lit(-1).alias("last"))

    def walk(state: Column, wanted) -> Column:
        def step(acc: Column, r: Column) -> Column:
            fits = (F.size(acc["chosen"]) < n) & ~F.array_contains(acc["chosen"], r["i"]) & wanted(acc, r)
            named = F.when(r["key"] != "", F.array(r["key"])).otherwise(F.array().cast("array<string>"))
            return F.when(fits, F.struct(
                F.concat(acc["chosen"], F.array(r["i"])).alias("chosen"), F.concat(acc["seen"], named).alias("seen"),
                r["bracket"].alias("last"))).otherwise(acc)

        return F.aggregate(places, state, step)

    def unseen(acc: Column, r: Column) -> Column:
        return ~F.array_contains(acc["seen"], r["key"])

    first = walk(none, lambda acc, r: (r["key"] != "") & (r["bracket"] < len(BRACKET_ENDS)) & (r["bracket"] != acc["last"]) & unseen(acc, r))
    second = walk(first, lambda acc, r: (r["eta"] >= ARRIVING) & unseen(acc, r))
    third = walk(second, lambda acc, r: F.lit(True))
    return F.sort_array(third["chosen"])


def diverse_board(arrivals: DataFrame, board: Sequence[str] = (), max_rows: int = MAX_ROWS,
                  route: str | None = None) -> DataFrame:
    """Up to `max_rows` arrivals per board (a station, a line, or one global board).

    With `route` only that route is shown and stops take the part of routes.
    """
    shown = arrivals.filter(F.col("eta_seconds") >= 0)
    if route:
        shown = shown.filter(F.upper("route_id") == route.upper())
        key = blank_to(F.col("stop_name"), F.coalesce(F.col("stop_id"), F.lit("")))
    else:
        key = F.upper(F.coalesce(F.col("route_id"), F.lit("")))
    bracket = F.lit(len(BRACKET_ENDS))
    for i in reversed(range(len(BRACKET_ENDS))):
        bracket = F.when(F.col("eta_seconds") < BRACKET_ENDS[i], i).otherwise(bracket)
    order = ["eta_seconds", *[c for c in ("route_id", "stop_id", "trip_id") if c in arrivals.columns]]
    reach = _candidates(shown.withColumn("_key", key).withColumn("_bracket", bracket), board, order, max_rows)
    row = F.struct(*order, *[c for c in arrivals.columns if c not in order], "_key", "_bracket")
    boards = reach.groupBy(*board).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    chosen = F.transform(_filled(F.col("_rows"), max_rows), lambda i: F.element_at("_rows", i + 1))
    shown = boards.select(F.posexplode(chosen).alias("_at", "_row"))
    return shown.select(*[F.col(f"_row.{c}") for c in arrivals.columns], (F.col("_at") + 1).cast("long").alias("position"))
