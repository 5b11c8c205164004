import json

import pandas as pd
from pyspark.sql import functions as F

from fleetline.operators import agent, scoring
from fleetline.operators.proposals import parse_route_proposals, proposal_geojson
from helpers import ALERTS, alert, rows, value


def parsed(spark, text):
    return agent.parse_response(spark.createDataFrame([(text,)], "response string")).first()


def test_parse_response(spark):
    r = parsed(spark, "**Action:** HOLD TRAIN \nDispatcher Note: hold it\nRider Message: wait\nReasoning: two\nlines")
    assert (r.llm_action, r.dispatcher_note, r.rider_message, r.reasoning) == ("HOLD TRAIN", "hold it", "wait", "two\nlines")
    r = parsed(spark, "nothing labelled")
    assert r.llm_action is None and r.reasoning is None


def test_blank_action_takes_the_next_line(spark):
    assert parsed(spark, "Action:\nDispatcher Note: x").llm_action == "Dispatcher Note: x"


def test_prompt(spark):
    df = spark.createDataFrame([alert(0, name="", direction="X")], ALERTS)
    text = agent.dispatcher_prompt(df).first().prompt
    assert text.split("\n")[:3] == ["SERVICE ALERT", "Line: 1  Direction: X (downtown/Brooklyn-bound)", "Station: 101N"]
    assert text.endswith("Trailing Train: c   Leading Train: p")


def test_action_ignores_the_answer(spark):
    df = spark.createDataFrame([alert(0, "BUNCHING", 60), alert(1, "BUNCHING", 60), alert(2, "GAP", 1300, curr="d")], ALERTS)
    got = agent.dispatcher_decisions(df, lambda p: pd.Series(["Action: SKIP-STOP"] * len(p)))
    assert rows(got, "curr_trip", "action", "llm_action", "dispatcher_note") == [
        ("c", "HOLD TRAIN", "SKIP-STOP", None), ("d", "GAP FILL", "SKIP-STOP", None)]
    offline = agent.dispatcher_decisions(df, partitions=2)
    assert rows(offline.filter("action = llm_action"), "curr_trip") == [("c",), ("d",)]
    assert scoring.score_decisions(offline).first().action_accuracy == 1.0


def test_blank_answers_are_asked_again(spark):
    calls = spark.sparkContext.accumulator(0)

    def moody(prompts):
        calls.add(len(prompts))
        return prompts.where(prompts != "b", "")

    df = spark.createDataFrame([("a",), ("b",), (None,)], "prompt string").coalesce(1)
    got = agent.run_agent(df, "prompt", moody, max_iterations=3, partitions=1)
    assert sorted(map(str, (r.response for r in got.collect()))) == ["", "None", "a"]
    assert calls.value == 4


def test_instructions_and_limits_reach_the_responder(spark):
    def model(prompts, spec):
        return prompts + f" | {spec.name} {spec.max_tokens}"

    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id int, kind string, prompt string")
    specs = {"a": agent.AgentSpec("first", "be short", max_tokens=7), "b": agent.AgentSpec("second", "be long")}
    got = {r.id: r.response for r in agent.run_agent(df, "prompt", model, spec=specs, kind="kind").collect()}
    assert got == {1: "x | first 7", 2: "y | second 1024", 3: None}
    agent.register_agent_function(spark, model, "told", agent.DISPATCHER)
    df.createOrReplaceTempView("asked_in_test")
    assert spark.sql("SELECT told(prompt) AS r FROM asked_in_test WHERE id = 1").first().r == "x | dispatcher_agent 1024"


def test_blank_answers_are_asked_as_often_as_the_spec_says(spark):
    calls = spark.sparkContext.accumulator(0)

    def silent(prompts, spec):
        calls.add(len(prompts))
        return pd.Series([""] * len(prompts))

    df = spark.createDataFrame([("a",)], "prompt string").coalesce(1)
    agent.run_agent(df, "prompt", silent, spec=agent.AgentSpec("s", "", max_iterations=5)).collect()
    assert calls.value == 5


def test_lateral_function(spark):
    agent.register_agent_function(spark, lambda p: p.str.upper(), "shout")
    spark.createDataFrame([("hi",)], "prompt string").createOrReplaceTempView("prompts_in_test")
    df = spark.sql("SELECT response FROM prompts_in_test, LATERAL (SELECT shout(prompt) AS response)")
    assert df.first().response == "HI"
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()


DECISIONS = "route_id string, stop_id string, alert_type string, headway_seconds long, action string, llm_action string"


def test_scoring(spark):
    data = [("1", "a", "BUNCHING", 55, "HOLD TRAIN", "HOLD TRAIN"), ("1", "b", "BUNCHING", 130, "MONITOR", "MONITOR"),
            ("2", "c", "GAP", 1600, "GAP FILL", "GAP FILL"), ("2", "d", "GAP", 1100, "MONITOR", "GAP FILL"),
            ("3", "e", "BUNCHING", 85, " hold train ", "HOLD TRAIN"), ("3", "f", None, 5, "x", "x"), ("3", "g", "GAP", None, "x", "x")]
    r = scoring.score_decisions(spark.createDataFrame(data, DECISIONS)).first()
    assert (r.total, r.action_wrong, r.llm_present, r.llm_agreement, r.action_accuracy, r.llm_agreement_rate) == (5, 0, 5, 4, 1.0, 0.8)
    wrong = spark.createDataFrame([("1", "a", "bunching", 60, "MONITOR", ""), ("1", "b", "GAP", 950, None, None)], DECISIONS)
    assert rows(scoring.decision_mismatches(wrong), "stop_id", "expected", "actual") == [
        ("a", "HOLD TRAIN", "MONITOR"), ("b", "MONITOR", "(empty)")]
    r = scoring.score_decisions(spark.createDataFrame([], DECISIONS)).first()
    assert r.action_accuracy == 1.0 and r.llm_agreement_rate is None


def proposal(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return proposal_geojson(parse_route_proposals(df)).first()


def test_proposals(spark):
    good = proposal(spark, 'Sure: {"name": "X", "waypoints": [[40.7, -74.0], ["40.8", "-73.9"], [50, 0], "bad", [40.9]], "stops": ["a"]} ok')
    assert good.waypoints == [[40.7, -74.0], [40.8, -73.9]] and good.stops == ["a"]
    line = json.loads(good.geojson)
    assert line["geometry"] == {"type": "LineString", "coordinates": [[-74.0, 40.7], [-73.9, 40.8]]}
    assert line["properties"] == {"name": "X", "kind": "proposed_route"}
    unnamed = proposal(spark, '{"waypoints": [[40.3, -74.3], [41.1, -73.6]]}')
    assert json.loads(unnamed.geojson)["properties"]["name"] == "Proposed route"
    for bad in (None, "", "none", "}{", '{"waypoints": [[40.7, -74.0]]}', '{"waypoints": 5}', '{"waypoints": [[40.7, -74.0], [40.8, -73.9]]} }',
                '{"waypoints": [[40.7, -74.4], [40.8, -73.9]]}'):
        r = proposal(spark, bad)
        assert r.waypoints is None and r.geojson is None and r.name is None


def test_copilots(spark):
    asked = spark.createDataFrame(
        [(1, "rider", " Home ", "", "late?", None), (2, "operator", None, None, "", None), (3, "route", "A", "B", None, "fast"),
         (4, "route", "A", "C", None, None), (5, "dance", None, None, None, None), (6, "rider", None, None, None, None)],
        "request_id long, kind string, origin string, destination string, question string, constraints string")
    state = spark.createDataFrame([("STATE",)], "text string")
    prompts = {r.request_id: r.prompt for r in agent.copilot_prompt(asked, state).collect()}
    assert prompts[1] == "Trip: from 'Home' to '?'.\nRider asks: late?\n\nLIVE SYSTEM STATE:\nSTATE"
    assert prompts[2].startswith("Operator asks: How is service now") and prompts[2].endswith("\n\nLIVE SYSTEM STATE:\nSTATE")
    assert prompts[3] == "Design a bus route from 'A' to 'B'.\nConstraints/goals: fast\n\nLIVE SYSTEM STATE (for demand/gap signals):\nSTATE"
    assert prompts[5] is None and prompts[6] == "\nLIVE SYSTEM STATE:\nSTATE"

    def model(p):
        return p.map(lambda x: "" if x.startswith("Operator") else '{"waypoints": [[40.7, -74.0], [40.8, -73.9]]}' if "'B'" in x else "text")

    got = {r.request_id: (r.ok, r.error, r.geojson is not None) for r in agent.answer_requests(asked, state, model).collect()}
    assert got == {1: (True, None, False), 2: (False, "no answer", False), 3: (True, None, True),
                   4: (False, "Could not parse a route proposal.", False), 5: (False, "unknown request kind", False), 6: (True, None, False)}


def test_template_names_the_place(spark):
    df = spark.createDataFrame([alert(0, "GAP", 1300)], ALERTS)
    assert "Main St" in agent.template_answer(df).first().response
    assert value(spark, F.lit(agent.DISPATCHER.max_iterations)) == 3
