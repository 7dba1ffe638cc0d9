"""The tree of shared beginnings against nested dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from annospark.llm import queries, session_tree as st
from annospark.schemas import EVENT_TYPES

EVENTS = "session_id long, ts_ms long, event_type string, payload string"


def plain(sequences):
    """``{(smallest member, depth): (parent, members, children, leaves, saved)}`` and the ids that end at each node."""
    members, ends = defaultdict(list), defaultdict(list)
    for s, steps in sequences.items():
        for d in range(len(steps) + 1):
            members[tuple(steps[:d])].append(s)
        ends[tuple(steps)].append(s)
    children = defaultdict(list)
    for beginning in members:
        if beginning:
            children[beginning[:-1]].append(beginning)
    out, digests = {}, {}

    def walk(beginning):
        below = [walk(c) for c in children[beginning]]
        saved = (len(members[beginning]) - 1) * (len(beginning[-1][1].encode()) if beginning else 0)
        leaves, saved = sum(b[0] for b in below) or int(not below), saved + sum(b[1] for b in below)
        parent = min(members[beginning[:-1]]) if beginning else None
        out[min(members[beginning]), len(beginning)] = (parent, len(members[beginning]), len(below), leaves, saved)
        digests[min(members[beginning]), len(beginning)] = ends[beginning]
        return leaves, saved

    if sequences:
        walk(())
    return out, {k: sorted(v) for k, v in digests.items() if v}


def sequences_of(rows):
    by = defaultdict(list)
    for s, ts, kind, payload in rows:
        if s is not None:
            by[s].append((ts is not None, ts or 0, kind or "", payload or ""))
    return {s: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for s, v in by.items()}


NODE = ("session_id", "depth")
VALUES = ("parent_session_id", "n_sessions", "n_children", "n_leaves", "saved_bytes")


def checked(spark, rows, idle=()):
    events = spark.createDataFrame(rows, EVENTS).withColumns({c: F.lit("clash") for c in ("depth", "digest", "key", "place", "bytes", "__part", "turn")})
    tree = st.session_tree(events, spark.createDataFrame([(i,) for i in idle], "session_id long") if idle else None)
    nodes, ends = plain({**{i: [] for i in idle}, **sequences_of(rows)})
    assert {tuple(r[c] for c in NODE): tuple(r[c] for c in VALUES) for r in tree.nodes.collect()} == nodes
    assert tree.nodes.count() == len(nodes)
    found = {tuple(r[c] for c in NODE): r["ends_sha256"] for r in st.end_digests(tree.ends).collect()}
    assert found == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in ends.items()}


def sessions(seed, n, kinds=3):
    r = random.Random(seed)
    return [(s, t, EVENT_TYPES[r.randrange(kinds)], f"b{r.randrange(2)}é") for s in r.sample(range(-5, 9 * n), n) for t in range(r.randrange(1, 7))]


def test_annotation_sessions(spark):
    checked(spark, sessions(1, 150), idle=(-99, 7, 9999))


@pytest.mark.parametrize("held,last", [(7, 5), (2, 2)])
def test_tours_cut_into_many_pieces(spark, monkeypatch, held, last):
    """Pieces of a few arcs need several rounds, rounds by joins among them."""
    monkeypatch.setattr(st, "HELD", held)
    monkeypatch.setattr(st, "LAST", last)
    monkeypatch.setattr(st, "CHUNK", 2)
    called = []
    mated = st._mated
    monkeypatch.setattr(st, "_mated", lambda *a: called.append(1) or mated(*a))
    checked(spark, sessions(2, 25))
    assert called or held > 2


def test_awkward_events(spark):
    long = "x" * 100_000
    rows = [(1, None, "hover", "b"), (1, 5, None, None), (2, 5, "", ""), (2, None, "hover", "b"), (3, 1, "hover", long), (3, 2, "undo", "é"), (None, 1, "hover", "b")]
    checked(spark, rows + [(4, 1, "undo", "same"), (4, 1, "undo", "same"), (5, 1, "undo", "same")])
    assert st.session_tree(spark.createDataFrame([], EVENTS)).nodes.count() == 0
    checked(spark, [], idle=(4, 3))


def test_one_session_with_many_events_and_many_equal_sessions(spark, monkeypatch):
    monkeypatch.setattr(st, "HELD", 2_000)
    monkeypatch.setattr(st, "LAST", 500)
    r = random.Random(3)
    checked(spark, [(1, t, "hover", str(r.randrange(3))) for t in range(800)] + [(s, t, "hover", "0") for s in range(2, 300) for t in range(2)])


def test_named_sessions_and_payload_maps(spark):
    rows = [("b", 1, "hover", {"y": "1", "x": "2"}), ("a", 1, "hover", {"x": "2", "y": "1"}), ("a", 2, "undo", None), ("c", 1, "undo", {})]
    tree = st.session_tree(spark.createDataFrame(rows, "session_id string, ts_ms long, event_type string, payload map<string,string>"))
    got = {(r["session_id"], r["depth"]): (r["parent_session_id"], r["n_sessions"], r["n_children"], r["n_leaves"], r["saved_bytes"]) for r in tree.nodes.collect()}
    size = len('{"x":"2","y":"1"}')
    assert got == {("a", 0): (None, 3, 2, 2, size), ("a", 1): ("a", 2, 1, 1, size), ("a", 2): ("a", 1, 0, 1, 0), ("c", 1): ("a", 1, 0, 1, 0)}


def test_query_rebuilds_conversations(spark):
    sf = "/root/testdata/sf0.001"
    original = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        original[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    original = {c: [x[2:] for x in sorted(v)] for c, v in original.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = original.get(c - c % 5, [])[:h] + own[h:]
    nodes, ends = plain(rebuilt)
    got = queries.op12_shared_beginnings(spark, sf).collect()
    assert {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in got} == nodes
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert all(r["ends_sha256"] == digest(ends.get((r["conv_id"], r["depth"]), [])) for r in got) and len(got) == len(nodes)
