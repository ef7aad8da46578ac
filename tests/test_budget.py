import datetime as dt
import random

import pandas as pd


from inkmill.streaming import budget

SCHEMA = "key string, seq long, ts timestamp, action string, request string, amount long"
START = dt.datetime(2024, 1, 1)


def rows(n=160):
    rng, out = random.Random(3), []
    for k in range(n):
        ts = START + dt.timedelta(minutes=7 * k, seconds=rng.randint(0, 59))
        out.append((rng.choice("ab"), k, ts, rng.choice(["reserve", "reserve", "settle", "release"]), f"r{rng.randrange(6)}", rng.randint(1, 400)))
    return out


def decided(rows, limit, timeout, mark):
    """The ledger in plain Python; mark: how far the watermark comes."""
    spent, held, out = {}, {}, []

    def expire(key, at):
        for request, (amount, end) in sorted(held[key].items(), key=lambda x: (x[1][1], x[0])):
            if end <= at:
                del held[key][request]
                spent[key] += amount
                out.append((key, None, request, "expired", amount, spent[key]))

    for key, seq, ts, action, request, amount in sorted(rows, key=lambda r: (r[2], r[1])):
        spent.setdefault(key, 0)
        mine = held.setdefault(key, {})
        expire(key, ts)
        if action == "reserve":
            fits = spent[key] + sum(a for a, _ in mine.values()) + amount <= limit
            what = "repeated" if request in mine else "granted" if fits else "refused"
            if what == "granted":
                mine[request] = (amount, ts + dt.timedelta(seconds=timeout))
        elif request not in mine:
            what = "unknown"
        else:
            del mine[request]
            what = "settled" if action == "settle" else "released"
            spent[key] += amount if action == "settle" else 0
        out.append((key, seq, request, what, amount, spent[key]))
    for key in held:
        expire(key, mark)
    return sorted(out, key=repr)


def put(spark, some, folder, name):
    spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_one_run_and_runs_that_go_on(spark, tmp_path):
    """Files one by one, in order; a second run goes on from the first's checkpoint; timers charge what nobody settles."""
    given, source, one = rows(), str(tmp_path / "in"), str(tmp_path / "one")
    parts = [given[:50], given[50:110], given[110:]]
    want = decided(given, 3000, 3600, max(r[2] for r in given) - dt.timedelta(minutes=10))

    def run(path):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{source}/*")
        budget.run(stream, path, 3000, 3600, "10 minutes")
        return sorted((tuple(r) for r in spark.read.parquet(f"{path}/decisions").drop("reserved").collect()), key=repr)

    put(spark, parts[0], source, "0")
    first = run(one)
    assert len(first) >= 50 and first != want
    put(spark, parts[1], source, "1")
    put(spark, parts[2], source, "2")
    assert run(one) == want
    assert run(one) == want  # nothing new, nothing again
    assert {x[3] for x in want} == {"granted", "refused", "repeated", "settled", "released", "unknown", "expired"}
    got = {r.key: r for r in budget.balances(spark.read.parquet(f"{one}/decisions")).collect()}
    assert all(got[k].spent == max(x[5] for x in want if x[0] == k) <= 3000 + 400 for k in "ab")




def test_timers_of_open_reservations_only():
    """What is settled in the same batch needs no timer."""
    ledger, timers = budget.Ledger(1000, 10_000_000), []

    class Value:
        def exists(self):
            return False

        def update(self, x):
            pass

        updateValue = lambda self, k, v: None

    ledger.handle = type("Handle", (), {"registerTimer": lambda self, at: timers.append(at)})()
    ledger.spent = ledger.open = Value()
    rows = [(k, k * 1000, a, r, 5) for k, (a, r) in enumerate([("reserve", "a"), ("settle", "a"), ("reserve", "b"), ("release", "b"), ("reserve", "c")])]
    out = list(ledger.handleInputRows(("u",), iter([pd.DataFrame(rows, columns=["seq", "at", "action", "request", "amount"])]), None))
    assert out[0].decision.tolist() == ["granted", "settled", "granted", "released", "granted"] and timers == [10_004]
