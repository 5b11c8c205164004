"""Dispatcher decisions with a pluggable text model, and batch copilots.

A responder is a function from a batch of prompts (pandas Series) to a batch of answers. One with a parameter `spec`
is also told what the prompts are for: instructions, provider and limits. Without a responder the package answers from
a fixed template, computed as a column expression.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetline.functions.ids import blank_to
from fleetline.functions.rules import dispatcher_action
from fleetline.operators.dedup import dedup_alerts
from fleetline.operators.proposals import parse_route_proposals, proposal_geojson

Responder = Callable[[pd.Series], pd.Series]


@dataclass(frozen=True)
class AgentSpec:
    """What a responder needs to know about its model."""

    name: str
    instructions: str
    provider: str = "template"
    max_tokens: int = 1024
    max_iterations: int = 3


# Labels of the answer lines and the patterns that read them.
ANSWER_PATTERNS = {
    "llm_action": r"\*{0,2}Action:\*{0,2}\s*([^\n]+)",
    "dispatcher_note": r"\*{0,2}Dispatcher Note:\*{0,2}\s*([^\n]+)",
    "rider_message": r"\*{0,2}Rider Message:\*{0,2}\s*([^\n]+)",
    "reasoning": r"\*{0,2}Reasoning:\*{0,2}\s*([\s\S]+?)$",
}

DISPATCHER = AgentSpec(
    name="dispatcher_agent",
    instructions=(
        "Choose one control action for the service alert and write a short rider message. Answer with "
        "four lines labelled Action, Dispatcher Note, Rider Message and Reasoning. Allowed actions: "
        "HOLD TRAIN, GAP FILL, SKIP-STOP, MONITOR. Use only facts from the alert."
    ),
)


def dispatcher_prompt(alerts: DataFrame, name: str = "prompt") -> DataFrame:
    """Adds the alert as text."""
    def lit(text: str) -> Column:
        return F.lit(text)

    heading = F.when(F.col("direction") == "N", "uptown/Bronx-bound").otherwise("downtown/Brooklyn-bound")
    # Wording of the prompt.
    text = F.concat(
        lit("SERVICE ALERT\nLine: "), "route_id", lit("  Direction: "), "direction", lit(" ("), heading,
        lit(")\nStation: "), blank_to(F.col("stop_name"), F.col("stop_id")),
        lit("\nAlert Type: "), "alert_type", lit("\nSeverity: "), "severity",
        lit("\nObserved Headway: "), F.col("headway_seconds").cast("string"),
        lit(" seconds (normal is roughly 150-600s)\nTrailing Train: "), "curr_trip",
        lit("   Leading Train: "), "prev_trip")
    return alerts.withColumn(name, text)


def template_answer(alerts: DataFrame, name: str = "response") -> DataFrame:
    """Offline answer in the four-line format, from the alert's own columns."""
    action = dispatcher_action(F.col("alert_type"), F.col("headway_seconds"))
    place = blank_to(F.col("stop_name"), F.col("stop_id"))
    note = (
        F.when(action == "HOLD TRAIN", F.concat(F.lit("Hold "), "curr_trip", F.lit(" at "), place, F.lit(" to restore spacing.")))
        .when(action == "GAP FILL", F.concat(F.lit("Add service behind "), "prev_trip", F.lit(" at "), place, F.lit(".")))
        .otherwise(F.concat(F.lit("Watch line "), "route_id", F.lit(" at "), place, F.lit(".")))
    )
    rider = (
        F.when(F.col("alert_type") == "GAP", F.concat(F.lit("Longer wait than usual at "), place, F.lit(".")))
        .otherwise(F.concat(F.lit("Two vehicles are close together at "), place, F.lit(".")))
    )
    reason = F.concat(F.lit("Headway of "), F.col("headway_seconds").cast("string"), F.lit(" seconds is a "),
                      "alert_type", F.lit(" alert."))
    return alerts.withColumn(name, F.concat(
        F.lit("Action: "), action, F.lit("\nDispatcher Note: "), note, F.lit("\nRider Message: "), rider,
        F.lit("\nReasoning: "), reason))


def _told(responder: Responder, spec: AgentSpec | None) -> Responder:
    """The responder with its spec, if it wants one."""
    wants = spec is not None and "spec" in inspect.signature(responder).parameters
    return partial(responder, spec=spec) if wants else responder


def run_agent(df: DataFrame, prompt: str, responder: Responder, name: str = "response", max_iterations: int | None = None,
              partitions: int | None = None, spec: AgentSpec | Mapping[str, AgentSpec] | None = None,
              kind: str | None = None) -> DataFrame:
    """Adds the responder's answer. Blank answers are asked again, `max_iterations` times in all (the spec's, or 3).

    With a mapping of specs, the column `kind` says which one a row's prompt is for; prompts of one kind are asked
    together, and rows of an unknown kind are not asked.
    `partitions` sets how many tasks ask at once; without it the upstream partitions are used, which
    Spark sizes by bytes and not by the time a model takes. Write the result before using it twice: a
    model may answer differently when Spark recomputes the plan.
    """
    if partitions:
        df = df.repartition(partitions, prompt)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])
    specs = dict(spec) if isinstance(spec, Mapping) else {None: spec}
    asking = {k: (_told(responder, s), max_iterations or (s.max_iterations if s else 3)) for k, s in specs.items()}

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            for key, (ask, times) in asking.items():
                open_rows = batch[prompt].notna() & (True if key is None else batch[kind] == key)
                for _ in range(times):
                    if not open_rows.any():
                        break
                    replies.loc[open_rows] = list(ask(batch.loc[open_rows, prompt]))
                    blank = replies.isna() | (replies.astype("string").str.strip().fillna("") == "")
                    open_rows = open_rows & blank
            yield batch.assign(**{name: replies})

    return df.mapInPandas(answer, schema)


def register_agent_function(spark: SparkSession, responder: Responder, name: str = "run_agent",
                            spec: AgentSpec | None = None) -> None:
    """Makes the responder a SQL function of a prompt, as in `FROM alerts, LATERAL (SELECT run_agent(prompt) AS response)`.

    It gets whole Arrow batches of prompts, never single rows.
    """
    ask = _told(responder, spec)

    def answer(prompts: pd.Series) -> pd.Series:
        return ask(prompts)

    spark.udf.register(name, F.pandas_udf(answer, "string"))


def parse_response(df: DataFrame, response: str = "response") -> DataFrame:
    """Adds the four labelled parts of an answer; a missing label gives null."""
    out = df
    for column, pattern in ANSWER_PATTERNS.items():
        found = F.nullif(F.regexp_extract(response, pattern, 1), F.lit(""))
        out = out.withColumn(column, F.trim(found))
    return out


def dispatcher_decisions(alerts: DataFrame, responder: Responder | None = None,
                         max_iterations: int | None = None, partitions: int | None = None,
                         spec: AgentSpec = DISPATCHER) -> DataFrame:
    """One decision per distinct alert. The action comes from the rules, never from the answer."""
    asked = dispatcher_prompt(dedup_alerts(alerts))
    answered = (template_answer(asked) if responder is None
                else run_agent(asked, "prompt", responder, max_iterations=max_iterations, partitions=partitions, spec=spec))
    return parse_response(answered).select(
        "route_id", "direction", "stop_id", "curr_trip", "prev_trip", "stop_name", "stop_lat", "stop_lon",
        "alert_type", "severity", "headway_seconds", "arrival_time",
        dispatcher_action(F.col("alert_type"), F.col("headway_seconds")).alias("action"),
        "llm_action", "dispatcher_note", "rider_message", "reasoning",
        F.col("response").alias("raw_response"))


# Request kinds, with what a responder is told for each. A request is asked once.
COPILOTS = {
    "rider": AgentSpec("rider_advisor", "Advise a rider from the live state only; be short and calm.", max_iterations=1),
    "operator": AgentSpec("operator_insight", "Tell operators current risks, what comes next and what to do.",
                          max_tokens=2200, max_iterations=1),
    "route": AgentSpec("route_designer", "Propose one bus route as a JSON object with name, waypoints, stops, rationale and "
                       "connections.", max_tokens=4096, max_iterations=1),
}


def copilot_prompt(requests: DataFrame, context: DataFrame, name: str = "prompt") -> DataFrame:
    """Adds the prompt of each request; `context` has one row with a `text` column."""
    def given(column: str) -> Column:
        return F.trim(F.coalesce(F.col(column), F.lit("")))

    origin, destination, question = given("origin"), given("destination"), given("question")
    start, end = blank_to(origin, F.lit("?")), blank_to(destination, F.lit("?"))
    # Wording of the prompts.
    trip = F.when((origin != "") | (destination != ""),
                  F.concat(F.lit("Trip: from '"), start, F.lit("' to '"), end, F.lit("'.")))
    ask = F.when(question != "", F.concat(F.lit("Rider asks: "), question))
    state = F.col("_state")
    rider = F.concat_ws("\n", trip, ask, F.concat(F.lit("\nLIVE SYSTEM STATE:\n"), state))
    task = blank_to(question, F.lit(
        "How is service now, what is about to get worse, and what should operators do first?"))
    operator = F.concat(F.lit("Operator asks: "), task, F.lit("\n\nLIVE SYSTEM STATE:\n"), state)
    goals = F.when(given("constraints") != "", F.concat(F.lit("Constraints/goals: "), given("constraints")))
    route = F.concat_ws(
        "\n", F.concat(F.lit("Design a bus route from '"), start, F.lit("' to '"), end, F.lit("'.")), goals,
        F.concat(F.lit("\nLIVE SYSTEM STATE (for demand/gap signals):\n"), state))
    # The text is computed once, into a column; the prompts of all kinds read it there.
    stated = requests.withColumn("_state", context.select(F.max("text")).scalar())
    return stated.withColumn(name, F.when(F.col("kind") == "rider", rider).when(F.col("kind") == "operator", operator)
                             .when(F.col("kind") == "route", route)).drop("_state")


def answer_requests(requests: DataFrame, context: DataFrame, responder: Responder,
                    specs: Mapping[str, AgentSpec] = COPILOTS) -> DataFrame:
    """One row per request: ok, answer or proposal, or an error."""
    asked = copilot_prompt(requests, context)
    answered = parse_route_proposals(run_agent(asked, "prompt", responder, "answer", spec=specs, kind="kind"), "answer")
    answered = proposal_geojson(answered)
    got = blank_to(F.trim("answer"), F.lit(None)).isNotNull()
    is_route = F.col("kind") == "route"
    ok = got & (~is_route | F.col("waypoints").isNotNull())
    error = (F.when(~F.col("kind").isin(*COPILOTS), "unknown request kind").when(~got, "no answer")
             .when(~ok, "Could not parse a route proposal."))
    return answered.select("request_id", "kind", ok.alias("ok"), "answer",
                           F.when(is_route, F.col("geojson")).alias("geojson"), error.alias("error"))
