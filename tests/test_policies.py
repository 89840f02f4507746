"""Walks under a policy, renames that reach policies and pins, and saves that leave no gap."""

from pyspark.sql import functions as F

from sparkveil.plans import routing
from sparkveil.sources import sinks

SCHEMA = "request string, pos int, target string, nth int, status int, error string, mode string, retries int, stop_on_timeout boolean, size int, max_input int, presence string, cooling boolean"


def walked(spark, rows, mode="failover", retries=0, stop=False, size=10):
    """rows: (pos, target, nth, status, error[, max_input[, presence[, cooling]]])."""
    state = (None, None, False)
    data = [("r", *r[:5], mode, retries, stop, size, *r[5:], *state[len(r) - 5 :]) for r in rows]
    return tuple(routing.policy_walk(spark.createDataFrame(data, SCHEMA)).first())[1:]


def test_policy_walks(spark):
    a503 = [(0, "a", 0, 503, None), (0, "a", 1, 200, None), (1, "b", 0, 200, None)]
    assert walked(spark, a503) == ("b", 2, True, "status 503", None)
    assert walked(spark, a503, retries=1) == ("a", 2, False, None, None)
    assert walked(spark, a503, mode="strict") == (None, 1, False, "status 503", "gateway_strict")
    slow = [(0, "a", 0, None, "timeout"), (1, "b", 0, 200, None)]
    assert walked(spark, slow) == ("b", 2, True, "timeout", None)
    assert walked(spark, slow, stop=True) == (None, 1, False, "timeout", "gateway_timeout")
    assert walked(spark, [(0, "a", 0, 200, None, 5), (1, "b", 0, 200, None, None, "n1 busy"), (2, "c", 0, 200, None)]) == ("c", 3, True, "input-too-large", None)
    assert walked(spark, [(0, "a", 0, 200, None, None, None, True), (1, "b", 0, 200, None)]) == ("b", 1, True, "cooldown", None)
    assert walked(spark, [(0, "a", 0, 200, None, None, None, True), (1, "b", 0, 503, None)]) == ("a", 2, False, None, None)
    assert walked(spark, [(0, "a", 0, 503, None), (1, "b", 0, 404, None)])[4] == "gateway_exhausted"


def test_retry_after_is_capped(spark):
    rows = spark.createDataFrame([("t", 1, True, 1, 9000), ("t", 2, True, 2, None), ("t", 3, True, 3, 20)], "target string, ts int, failed boolean, id int, retry_after int")
    assert [r["seconds"] for r in routing.failure_runs(rows).orderBy("id").collect()] == [300, 60, 20]


def test_rename_reaches_policies_and_pins(spark):
    chains = spark.createDataFrame([("a", 0, "x"), ("b", 0, "a")], "name string, pos int, entry string")
    policies = spark.createDataFrame([("a", "strict"), ("n", "sticky"), ("c", "failover")], "name string, mode string")
    pins = spark.createDataFrame([("a", "s", "m1"), ("n", "s", "m2"), ("n", "t", "m3")], "group string, session string, model string")
    out = [sorted(tuple(r) for r in df.collect()) for df in routing.rename_everywhere(chains, policies, pins, "a", "n")]
    assert out == [[("b", 0, "n"), ("n", 0, "x")], [("c", "failover"), ("n", "strict")], [("n", "s", "m1"), ("n", "t", "m3")]]
    assert sorted(r["name"] for r in routing.policies_of_groups(policies, chains).collect()) == ["a"]


def test_save_replaces_in_one_step(spark, tmp_path):
    path = str(tmp_path / "c.json")
    for n in range(2):
        sinks.save_text(spark, path, f"{n}", str(tmp_path / "h"), f"s{n}")
    assert (tmp_path / "c.json").read_text() == "1" and (tmp_path / "h" / "s1.json").read_text() == "0" and not (tmp_path / "c.json.tmp").exists()
    sinks.save_text(spark, str(tmp_path / "d.json"), "x")
    assert spark.read.text(str(tmp_path / "d.json")).select(F.col("value")).first()["value"] == "x"
