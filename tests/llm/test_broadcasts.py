"""What an explode makes of a small table must not be broadcast for the size it had before."""

import random

from pyspark import cloudpickle

from weftline import session
from weftline.llm import near_copies, simhash


def exploded_broadcasts(plan, broadcast=False):
    """How many nodes that explode rows stand below a broadcast."""
    name = plan.getClass().getSimpleName()
    broadcast = broadcast or name.startswith("BroadcastExchange")
    inner = [plan.children().apply(i) for i in range(plan.children().length())]
    if name == "AdaptiveSparkPlanExec":
        inner = [plan.initialPlan()]
    return (broadcast and name == "GenerateExec") + sum(exploded_broadcasts(p, broadcast) for p in inner)


def watched(monkeypatch):
    """Counts, written table by written table, of exploded rows that are broadcast."""
    seen = []

    def cut(df, module):
        seen.append(exploded_broadcasts(df._jdf.queryExecution().executedPlan()))
        return plain[module](df)

    plain = {module: module.cut for module in (simhash, near_copies)}
    for module in plain:
        monkeypatch.setattr(module, "cut", lambda df, module=module: cut(df, module))
    return seen


def test_probes_of_fingerprints_are_not_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    values = [rng.getrandbits(63) for _ in range(300)]
    values += [v ^ 1 << rng.randrange(63) for v in values]
    fingerprints = session.cut(spark.createDataFrame([(v,) for v in values], "fp long"))
    seen = watched(monkeypatch)
    pairs = {(r["a"], r["b"]) for r in simhash.links(fingerprints).collect()}
    assert {tuple(sorted(p)) for p in zip(values[:300], values[300:])} <= pairs
    assert seen and not any(seen)


def test_band_keys_of_nodes_are_not_broadcast(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in base)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketches = near_copies.sketched(docs)
    seen = watched(monkeypatch)
    near_copies.links(docs, sketches).count()
    assert seen and not any(seen)


def test_near_copies_after_fingerprints(spark):
    """A session that has run op10 still sends the sketches of the pipeline to its workers."""
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 2
    assert cloudpickle.dumps(near_copies._sketches.func)
    assert near_copies.sketched(docs).count() == 2
