"""Turn reassembly against a plain replay of all batches."""

import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from tarnwell.llm import reassembly
from tarnwell.sources.scratch import shared_folder

DATA = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def replay(arrivals, n_batches, idle):
    """Events of (conv_id, turn, batch, role, payload), batch by batch."""
    at = {}
    for conv, turn, batch, role, payload in arrivals:
        if turn is not None and batch is not None:
            mine = ((payload or "").encode(), role or "")
            of_batch = at.setdefault(conv, {}).setdefault(batch, {})
            of_batch[turn] = min(mine, of_batch.get(turn, mine))
    out = []
    for conv, batches in at.items():
        following = first = min(t for b in batches.values() for t in b)
        kept, last, closed = {}, None, False
        for batch in range(n_batches + 1):
            came = batches.get(batch, {})
            if closed:
                out += [("reject", conv, t, batch, sha(p), None, None) for t, (p, _) in came.items()]
            elif came:
                last = batch
                for t, x in came.items():
                    kept.setdefault(t, x)
                while following in kept:
                    out.append(("release", conv, following, batch, sha(kept[following][0]), None, None))
                    following += 1
            elif last is not None and (batch - last == idle or batch == n_batches):
                closed = True
                left = ",".join(str(t) for t in sorted(kept) if t >= following)
                breaks = sum(t - 1 in kept and kept[t][1] == kept[t - 1][1] for t in kept)
                out.append(("close", conv, -1, batch, sha(left.encode()), max(kept) - first + 1 - len(kept), breaks))
    return sorted(out, key=str)


def digests(events):
    return sorted((tuple(r) for r in events.select("event", "conv_id", "turn", "batch", F.sha2("payload", 256), "n_missing", "n_breaks").collect()), key=str)


def test_odd_arrivals(spark):
    rows = [
        (1, 0, 0, "user", "user|b"), (1, 0, 0, "user", "user|a"), (1, 0, 1, "user", "user|0"),  # smallest of the earliest batch
        (1, 2, 1, "user", "user|z"), (1, 1, 2, "assistant", "assistant|é"), (1, 1, 2, "assistant", "assistant|\U0001f600"),
        (2, 5, 0, None, None), (2, 7, 1, "", ""), (2, 6, 4, "user", "late"), (2, 5, 4, "user", "late too"), (2, 5, 4, "user", "late too"),  # closed in between
        (3, -1, 2, "user", "x"), (3, 200, 2, "user", "y"), (3, 64, 3, "user", "w"), (3, 63, 3, "user", "v"), (3, 0, 4, "user", "u"),  # pages, negative turns
        (4, 1, 3, "b", "p"), (4, 1, 3, "a", "p"), (4, 2, 3, "a", "p"),  # one payload, two roles
        (5, None, 1, "user", "no turn"), (5, 1, None, "user", "no batch"), (6, 3, 0, "user", "long " * 50_000),
        (None, 1, 1, "user", "no conversation"), (None, 2, 1, "user", "no conversation"), (None, 2, 1, "user", "no conversation"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, batch long, role string, payload string")
    df = df.withColumns({n: F.lit("clash") for n in ("first", "ts", "id", "kept", "part", "event")})
    got = digests(reassembly.reassemble(df, 5, 2))
    assert got == replay(rows, 5, 2)
    assert {r[0] for r in got} == {"release", "reject", "close"}


def test_no_arrivals(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, batch long, role string, payload string")
    assert reassembly.reassemble(df, 2, 1).collect() == []


def test_query_equals_replay(spark):
    arrivals = []
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        h = int(sha(f"{r.conv_id}:{r.turn}".encode())[:8], 16)
        for batch, role in [(h % 12, r.role or ""), ((h + 3) % 12, "user")][: 1 + (h % 7 < 2)]:
            arrivals.append((r.conv_id, r.turn, batch, role, f"{role}|{r.text or ''}"))
    got = reassembly.op13_turn_reassembly(spark, DATA)
    assert sorted((tuple(r) for r in got.collect()), key=str) == replay(arrivals, 12, 3)


def test_pages_are_put_aside(spark, monkeypatch):
    """More pages in one batch than are held; copies, and repeats of kept and of released turns."""
    monkeypatch.setattr(reassembly, "HELD", 2)
    rows = [(1, (turn * 77) % 600, batch, role, f"{role}|{turn}") for turn in range(600) for batch, role in [(turn % 3, "user"), (turn % 3, "assistant"), (3, "user")][: 3 if turn % 5 else 0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, batch long, role string, payload string")
    assert digests(reassembly.reassemble(df, 5, 2)) == replay(rows, 5, 2)


def test_one_state_store_a_partition_and_start(spark, monkeypatch):
    """Two operators opened and closed twice as many stores, each a task: 5,486 of them on 211 partitions."""
    folders = []
    monkeypatch.setattr(reassembly, "shared_folder", lambda *a: folders.append(shared_folder(*a)) or folders[-1])
    df = spark.createDataFrame([(1, 0, 0, "user", "a"), (1, 0, 0, "user", "b")], "conv_id long, turn long, batch long, role string, payload string")
    reassembly.reassemble(df, 2, 1).collect()
    assert sorted(p.name for p in Path(folders[0].removeprefix("file:")).glob("checkpoint/state/*") if p.name.isdigit()) == ["0"]
