"""Placeholders over calls: the same turns in one batch and in shuffled micro-batches with a restart, and how long state lives."""

import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkveil.operators import mask
from sparkveil.streaming import numbering

SCHEMA = "conv_id long, turn long, ts timestamp, spans array<struct<start:int,end:int,kind:string,value:string>>"
START = datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, numbering.ROCKS)
    yield spark
    spark.conf.set(name, before)


def run(spark, root, batches, delay="1000 hours", **options):
    """Each list of rows is a micro-batch; returns the rows of the sink, by (conv, turn, start)."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in/part={n}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in/part={n}") if False else spark.readStream.schema(SCHEMA + ", part int").parquet(f"{root}/in").drop("part")
        out = numbering.numbered(stream.withWatermark("ts", delay), **options)
        # a new query for each batch, so every one starts from the checkpoint
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
    got = spark.read.schema("conv_id long, turn long, start int, kind string, value string, tag string, blocked boolean").parquet(f"{root}/out")
    return sorted((r["conv_id"], r["turn"], r["start"], r["kind"], r["value"], r["tag"], r["blocked"]) for r in got.collect())


def turns(rng, convs=5, most=14):
    rows = []
    for c in range(convs):
        for t in range(most if c == 0 else rng.randrange(1, most)):
            spans = [(10 * k, 10 * k + 5, kind, rng.choice((f"v{rng.randrange(9)}@x.com", f"V{rng.randrange(9)}@X.com", "a \"quoted\" \\ é\n")) if kind == "EMAIL" else f"{rng.randrange(6)}") for k, kind in enumerate(rng.choice(("EMAIL", "IP")) for _ in range(rng.randrange(0, 4)))]
            rows.append((c, t, START + timedelta(minutes=t), spans))
    return rows


def test_shuffled_batches_with_restarts_equal_one_batch(rocks, tmp_path):
    rng = random.Random(3)
    rows = turns(rng)
    found = rocks.createDataFrame(rows, SCHEMA).select("conv_id", "turn", F.explode("spans").alias("s")).select("conv_id", "turn", "s.start", "s.kind", "s.value")
    tags = mask.assign_tags(found).select("conv_id", "kind", "norm", "tag")
    keyed = found.withColumn("norm", numbering.scalars.normalize(F.col("kind"), F.col("value"))).join(tags, ["conv_id", "kind", "norm"])
    want = sorted((r["conv_id"], r["turn"], r["start"], r["kind"], r["value"], r["tag"], False) for r in keyed.collect())
    dealt = [[] for _ in range(4)]
    for row in rows:
        dealt[rng.randrange(4)].append(row)
    dealt[3] += rng.sample(rows, 5)  # some come twice
    for batch in dealt:
        rng.shuffle(batch)
    assert run(rocks, tmp_path, dealt) == want and len(want) > 30


def test_rest_gap_and_full_map(rocks, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    span = lambda v: [(0, 3, "EMAIL", v)]
    batches = [
        [(1, 0, at(0), span("a@x.y")), (1, 1, at(1), span("b@x.y")), (2, 0, at(0), span("p@x.y")), (3, 1, at(0), span("late@x.y")), (4, 0, at(0), [(k, k + 1, "IP", str(k)) for k in range(4)]), (4, 1, at(1), span("a@x.y"))],
        [(1, 2, at(8), span("b@x.y")), (2, 1, at(5.9), span("q@x.y")), (2, 2, at(11), span("p@x.y")), (None, 0, at(8), span("n@x.y")), (5, None, at(8), span("n@x.y"))],
        [(9, 0, at(40), span("z@x.y"))],  # the watermark moves past all rests
        [(9, 1, at(41), []), (1, 3, at(42), span("c@x.y")), (1, 3, at(42), span("other@x.y"))],
    ]
    got = run(rocks, tmp_path, batches, delay="1 hours", most=3)
    assert [(c, t, v[:1] if k == "EMAIL" else v, tag, blocked) for c, t, _, k, v, tag, blocked in got] == [
        (1, 0, "a", "<EMAIL_A>", False), (1, 1, "b", "<EMAIL_B>", False), (1, 2, "b", "<EMAIL_A>", False), (1, 3, "c", "<EMAIL_A>", False),  # anew after seven hours, and after the state was freed
        (2, 0, "p", "<EMAIL_A>", False), (2, 1, "q", "<EMAIL_B>", False), (2, 2, "p", "<EMAIL_A>", False),
        (3, 1, "l", "<EMAIL_A>", False),  # turn 0 never came
        (4, 0, "0", "<IP_A>", True), (4, 0, "1", "<IP_B>", True), (4, 0, "2", "<IP_C>", True), (4, 0, "3", None, True), (4, 1, "a", None, True),
        (9, 0, "z", "<EMAIL_A>", False),
    ]


def test_needs_rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError):
        numbering.numbered(spark.createDataFrame([], SCHEMA))
    spark.conf.set(name, before)


def test_letters():
    assert [numbering.letters(n) for n in (0, 25, 26, 27, 701, 702)] == ["A", "Z", "AA", "AB", "ZZ", "AAA"]


class Kept(dict):
    """A map or value state in memory, which counts its calls."""

    calls = 0

    def _count(self, done):
        Kept.calls += 1
        return done

    def getValue(self, key):
        return self._count(dict.get(self, key))

    def updateValue(self, key, value):
        self._count(self.__setitem__(key, value))

    def removeKey(self, key):
        self._count(dict.pop(self, key, None))

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def clear(self):
        self.removeKey(())


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Kept())

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.add(at)

    @property
    def handle(self):
        return self


class Expiry:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def in_memory(batches, most=5_000):
    """Rows of one bucket (page, conv, turn, ms, values), batch by batch, each by a new processor; then every timer, until none is left."""
    handle, out, calls = Handle(), [], []

    def step():
        made = numbering.Numbering(6 * numbering.HOUR, numbering.HOUR, most)
        made.init(handle)
        return made

    for batch in batches:
        Kept.calls = 0
        rows = [(p, c, t, ms, json.dumps([[n, "IP", v, v] for n, v in enumerate(values)])) for p, c, t, ms, values in batch]
        for pdf in step().handleInputRows((0,), iter([pd.DataFrame(rows, columns=["page", "conv", "turn", "ms", "spans"])]), None):
            out += pdf.itertuples(index=False, name=None)
        calls.append(Kept.calls)
    held = sum(map(len, handle.states.values()))
    while handle.timers:
        handle.timers.remove(at := min(handle.timers))
        for pdf in step().handleExpiredTimer((0,), None, Expiry(at)):
            out += pdf.itertuples(index=False, name=None)
    assert held and not any(handle.states.values())  # all state is freed in the end
    return out, calls


def test_calls_to_the_state_do_not_grow_with_conversations():
    rng = random.Random(1)
    rows = [(c % 4, str(c), t, t * 60_000, [f"{c}.{t % 3}"]) for c in range(2_000) for t in range(6)]
    rng.shuffle(rows)
    out, calls = in_memory([rows[k::4] for k in range(4)])
    assert {(c, t): (v, tag) for c, t, _, _, v, tag, _ in out} == {(c, t): (v[0], f"<IP_{'ABC'[t % 3]}>") for _, c, t, _, v in rows} and len(out) == len(rows)
    assert max(calls) <= 2 * 4 + 2  # 2,000 and more a batch, when each conversation was a key


@pytest.mark.parametrize("most", [5_000, 150])
def test_large_conversations_lie_in_pages_of_their_own(most):
    rng = random.Random(2)
    rows = [(c % 2, f"c{c}", t, t * 1_000, [str(rng.randrange(700)) for _ in range(rng.randrange(4))]) for c in range(3) for t in range(500) if (c, t) != (2, 0)]
    want = []
    for of in range(3):
        tags = {}
        for _, c, t, _, values in (r for r in rows if r[1] == f"c{of}"):
            for v in values:
                if v not in tags and len(tags) < most:
                    tags[v] = f"<IP_{numbering.letters(len(tags))}>"
            full = any(v not in tags for v in values)
            want += [(c, t, n, "IP", v, tags.get(v), full) for n, v in enumerate(values)]
    dealt = rng.sample(rows, len(rows))
    late = [r for r in dealt if r[2] < 5]
    batches = [[r for r in dealt if r[2] >= 5][k::3] for k in range(3)] + [late, late]
    assert sorted(in_memory(batches, most)[0]) == sorted(want)
