"""The tree of shared beginnings of annotation sessions, with subtree sums from an Euler tour."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from annospark.llm.groups import hand_back
from annospark.llm.tables import in_order, partitions_of, text_of
from annospark.operators.order_stats import running
from annospark.session import cut_lineage

LANES = ("s1", "s2", "s3", "s4")
HELD = 50_000  # arcs of a list that a task contracts at once
LAST = 10_000  # arcs that one task may put in order
SALTS = 64
CHUNK = 1_000  # session ids in one row on their way to a digest
ENTER, EXIT = 0, 1
ARC, NEXT, HEAD = (tuple(f"{p}_{c}" for c in ("id", "depth", "kind")) for p in ("a", "n", "h"))


@dataclass(frozen=True)
class SessionTree:
    """``nodes``: one row for each distinct beginning. ``ends``: ``session_id, depth, end_id`` of the sessions that are
    over at the node ``(session_id, depth)``."""

    nodes: DataFrame
    ends: DataFrame


def session_tree(events: DataFrame, sessions: DataFrame | None = None) -> SessionTree:
    """All distinct beginnings of annotation sessions as a tree.

    ``events`` has ``session_id, ts_ms, event_type, payload`` (text, or a map, which is written as JSON by key). A session is
    its events by ``ts_ms``, nulls first, ties by type and payload. A node of depth d stands for a distinct sequence of d
    first ``(event_type, payload)``; its members are the sessions that begin with it, and ``session_id`` is the smallest,
    so ``(session_id, depth)`` names a node. ``nodes`` has ``session_id, depth, parent_session_id, n_sessions, n_children,
    n_leaves`` (nodes without children in its subtree, itself included) and ``saved_bytes`` (over its subtree, the UTF-8
    bytes of each node's last payload times the members after the first). The root, of depth 0, has all sessions;
    its parent is null.

    Sessions may hold any number of events and nodes any number of sessions. Beginnings are told apart by running sums of
    128 bits of SHA-256 of place and event. Arcs into and out of every node form the Euler tour; tasks contract the
    pieces of it they hold until one task can hold the rest, ranks go back the same way, and subtree values are differences of
    prefix sums at the arcs' places. Every round ends in a written table.

    ``sessions(session_id)`` names further sessions, which may have no event. Null types and payloads are empty texts; events without
    a ``session_id`` belong to no session; repeated rows are steps of their own; a table without sessions gives no node.
    Other columns are not read.
    """
    steps = _steps(events)
    known = steps.select("session_id") if sessions is None else steps.select("session_id").unionByName(sessions.select("session_id"))
    known = cut_lineage(known.where("session_id IS NOT NULL").distinct())
    nodes = _nodes(steps, known)
    return SessionTree(_with_sums(nodes), _ends(steps, nodes, known))


def _steps(events: DataFrame) -> DataFrame:
    """``session_id, depth, bytes`` and the running sums over the session's events up to that depth, before and after the step."""
    payload = F.col("payload")
    if dict(events.dtypes)["payload"].startswith("map"):
        payload = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("payload"))))
    text, kind = F.coalesce(payload.cast("string"), F.lit("")), text_of("event_type")
    rows = events.where("session_id IS NOT NULL").select(
        "session_id",
        "ts_ms",
        F.sha2(F.concat_ws(":", F.octet_length(kind), kind, text), 256).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    placed = running(rows, ["ts_ms", "digest"], {"depth": F.lit(1).cast("long")}, ["session_id"])
    mark = F.sha2(F.concat_ws(":", "depth", "digest"), 256)
    lanes = {f"l_{c}": F.conv(F.substring(mark, 8 * i + 1, 8), 16, 10).cast("long") for i, c in enumerate(LANES)}
    placed = placed.select("session_id", "depth", "bytes", mark.alias("mark")).withColumns(
        {c: F.conv(F.substring("mark", 8 * i + 1, 8), 16, 10).cast("long") for i, c in enumerate(lanes)}
    )
    summed = running(placed.drop("mark"), ["depth"], {c: F.col(f"l_{c}") for c in LANES}, ["session_id"])
    key = F.struct("depth", *LANES)
    above = F.struct((F.col("depth") - 1).alias("depth"), *[(F.col(c) - F.col(f"l_{c}")).alias(c) for c in LANES])
    return cut_lineage(summed.select("session_id", "depth", "bytes", key.alias("key"), above.alias("above")))


def _nodes(steps: DataFrame, known: DataFrame) -> DataFrame:
    """``session_id, depth, parent_session_id, n_sessions, bytes, key`` of every node."""
    found = steps.groupBy("key", "above").agg(F.min("session_id").alias("session_id"), F.count("*").alias("n_sessions"), F.min("bytes").alias("bytes"))
    found = cut_lineage(found.withColumn("depth", F.col("key.depth")))
    least, n = known.agg(F.min("session_id"), F.count("*")).first()
    id_type = dict(known.dtypes)["session_id"]
    nobody, least = F.lit(None).cast(id_type), F.lit(least).cast(id_type)
    none = F.lit(0).cast("long")
    top = known.sparkSession.range(1 if n else 0).select(
        least.alias("session_id"), none.alias("depth"), nobody.alias("parent_session_id"), F.lit(n).cast("long").alias("n_sessions"), none.alias("bytes"), F.lit(None).cast(found.schema["key"].dataType).alias("key")
    )
    first = found.where("depth = 1").withColumn("parent_session_id", least)
    parents = found.select(F.col("key").alias("above"), F.col("session_id").alias("parent_session_id"))
    deeper = hand_back(found.where("depth > 1"), parents, "above", F.pmod(F.xxhash64("session_id"), F.lit(SALTS)))
    return cut_lineage(top.unionByName(first.select(top.columns)).unionByName(deeper.select(top.columns)))


def _with_sums(nodes: DataFrame) -> DataFrame:
    """The nodes with ``n_children``, ``n_leaves`` and ``saved_bytes``."""
    up = F.col("depth") - 1
    of_parent = nodes.where("depth > 0").groupBy(F.col("parent_session_id").alias("session_id"), up.alias("depth")).agg(
        F.count("*").alias("n_children"), F.min("session_id").alias("first_child")
    )
    full = _with_siblings(nodes).join(of_parent, ["session_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    full = cut_lineage(full)
    places = _ranked(_tour(full))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_sessions") - 1) * F.col("bytes")
    own = full.select(*[F.col(c).alias(a) for c, a in zip(("session_id", "depth"), ARC)], "parent_session_id", "n_sessions", "n_children", leaf.alias("leaf"), saved.alias("saved"))
    at = in_order(places.join(own, list(ARC[:2])), "place")
    enters = F.col("a_kind") == ENTER
    value = {c: F.when(enters, F.col(c)).otherwise(0) for c in ("leaf", "saved")}
    inside = Window.partitionBy("__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    held = at.groupBy("__part").agg(*[F.sum(v).alias(f"p_{c}") for c, v in value.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = held.select("__part", *[F.coalesce(F.sum(f"p_{c}").over(earlier), F.lit(0)).alias(f"b_{c}") for c in value])
    sums = at.withColumns({f"t_{c}": F.sum(v).over(inside) for c, v in value.items()}).join(F.broadcast(before), "__part")
    # up to and including the exit, less what came before the entry
    part = lambda c: F.sum(F.when(enters, F.col(c) - F.col(f"t_{c}") - F.col(f"b_{c}")).otherwise(F.col(f"t_{c}") + F.col(f"b_{c}")))
    names = ("parent_session_id", "n_sessions", "n_children")
    return sums.groupBy(F.col("a_id").alias("session_id"), F.col("a_depth").alias("depth")).agg(
        *[F.max(c).alias(c) for c in names], part("leaf").alias("n_leaves"), part("saved").alias("saved_bytes")
    )


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """The nodes with ``sibling``, the next larger ``session_id`` below the same parent."""
    family = ["depth", "parent_session_id", "session_id"]
    placed = in_order(nodes.select(*family, "n_sessions", "bytes"), *family)
    after = Window.partitionBy("__part").orderBy("__pos")
    last = F.struct(*family)
    begin = placed.where("__pos = 0").select("__part", last.alias("first"))
    begin = begin.select(F.lag("__part").over(Window.orderBy("__part")).alias("__part"), "first")  # one row per partition
    follower = F.coalesce(F.lead(last).over(after), F.when(F.lead("__pos").over(after).isNull(), F.col("first")))
    same = (F.col("then.depth") == F.col("depth")) & F.col("then.parent_session_id").eqNullSafe(F.col("parent_session_id"))
    led = placed.join(F.broadcast(begin), "__part", "left").withColumn("then", follower)
    return led.withColumn("sibling", F.when(same, F.col("then.session_id"))).drop("then", "first", "__part", "__pos")


def _tour(nodes: DataFrame) -> DataFrame:
    """Every arc with the next one and the distance to it (1)."""
    arc = lambda names, id_, depth, kind: F.struct(id_.alias(names[0]), depth.cast("long").alias(names[1]), F.lit(kind).alias(names[2]))
    me, depth = F.col("session_id"), F.col("depth")
    child, next_, up = F.col("first_child"), F.col("sibling"), F.col("parent_session_id")
    enter = F.struct(
        arc(ARC, me, depth, ENTER).alias("a"),
        F.when(child.isNotNull(), arc(NEXT, child, depth + 1, ENTER)).otherwise(arc(NEXT, me, depth, EXIT)).alias("n"),
    )
    leave = F.struct(
        arc(ARC, me, depth, EXIT).alias("a"),
        F.when(next_.isNotNull(), arc(NEXT, next_, depth, ENTER)).when(up.isNotNull(), arc(NEXT, up, depth - 1, EXIT)).alias("n"),
    )
    return nodes.select(F.explode(F.array(enter, leave)).alias("s")).select("s.a.*", "s.n.*", F.lit(1).cast("long").alias("steps"))


def _ranked(arcs: DataFrame) -> DataFrame:
    """The arcs with ``place``, their number of steps from the first arc of the list.

    A round gives every arc a head, an arc from which it is ``offset`` steps away, and goes on with the heads alone. Heads
    are found in tasks, among neighbours by id and depth, which a tour mostly visits together. A round that leaves more than half
    is followed by one that joins: of two arcs in a row the second is taken out if a fair draw says stay and go.
    """
    spark, levels, joins = arcs.sparkSession, [], 0
    live, n, by_join = arcs, None, False
    while True:
        if by_join:
            joins += 1
            level = _mated(live, joins)
        else:
            parts = partitions_of(spark) if n is None else min(partitions_of(spark), 1 + n // LAST)
            near = live.coalesce(1) if n is not None and n <= LAST else live.repartitionByRange(parts, *ARC[:2])
            level = cut_lineage(near.sortWithinPartitions(*ARC).mapInArrow(_contracted, _level_schema(live)))
        levels.append(level)
        before, live = n, level.where("offset = 0").select(*ARC, *NEXT, "steps")
        n = live.count()
        if n <= 1:
            break
        by_join = n > LAST and not by_join and before is not None and 2 * n > before
    places = levels.pop().select(*ARC, F.col("offset").alias("place"))
    while levels:
        heads = places.select(*[F.col(a).alias(h) for a, h in zip(ARC, HEAD)], F.col("place").alias("from"))
        places = cut_lineage(levels.pop().join(heads, list(HEAD)).select(*ARC, (F.col("from") + F.col("offset")).alias("place")))
    return places


def _level_schema(arcs: DataFrame) -> str:
    kind = dict(arcs.dtypes)[ARC[0]]
    three = lambda names: f"{names[0]} {kind}, {names[1]} long, {names[2]} int"
    return f"{three(ARC)}, {three(HEAD)}, offset long, {three(NEXT)}, steps long"


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads of the pieces of the list within each ``HELD`` rows; heads get what follows their piece."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield _pieces(pa.Table.from_batches(waiting))
            waiting, n = [], 0
    if n:
        yield _pieces(pa.Table.from_batches(waiting))


def _pieces(table: pa.Table) -> pa.RecordBatch:
    table = table.combine_chunks()
    rows = lambda names: list(zip(*[table.column(c).to_pylist() for c in names]))
    at = {a: i for i, a in enumerate(rows(ARC))}
    follows = [at.get(n, -1) for n in rows(NEXT)]
    steps = table.column("steps").to_pylist()
    led = set(follows)
    head, offset, end, total = [0] * len(follows), [0] * len(follows), list(range(len(follows))), list(steps)
    for start in range(len(follows)):
        if start not in led:
            i, far = start, 0
            while True:
                head[i], offset[i] = start, far
                far += steps[i]
                if follows[i] < 0:
                    break
                i = follows[i]
            end[start], total[start] = i, far
    take = lambda names, places: [table.column(c).take(pa.array(places, pa.int64())).combine_chunks() for c in names]
    arrays = [*take(ARC, range(len(head))), *take(ARC, head), pa.array(offset, pa.int64()), *take(NEXT, end), pa.array(total, pa.int64())]
    arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
    return pa.RecordBatch.from_arrays(arrays, names=[*ARC, *HEAD, "offset", *NEXT, "steps"])


def _mated(arcs: DataFrame, turn: int) -> DataFrame:
    """One round by joins: an arc that draws "go" after one that draws "stay" is taken out, a quarter of all on average."""
    goes = F.pmod(F.xxhash64(F.lit(turn), *ARC), F.lit(2)) == 1
    renamed = lambda df, prefix: df.select(*[F.col(c).alias(prefix + c) for c in df.columns])
    same = F.lit(True)
    for a, n in zip(ARC, NEXT):
        same = same & (F.col("p_" + n) == F.col("x_" + a))
    pairs = cut_lineage(renamed(arcs.where(~goes), "p_").join(renamed(arcs.where(goes), "x_"), same))
    out = pairs.select(*[F.col("x_" + a).alias(a) for a in ARC], *[F.col("p_" + a).alias(h) for a, h in zip(ARC, HEAD)], F.col("p_steps").alias("off"))
    longer = pairs.select(*[F.col("p_" + a).alias(a) for a in ARC], *[F.col("x_" + c).alias("new_" + c) for c in NEXT], (F.col("p_steps") + F.col("x_steps")).alias("new_steps"))
    both = arcs.join(out, list(ARC), "left").join(longer, list(ARC), "left")
    grown = F.col("new_steps").isNotNull()
    return cut_lineage(
        both.select(
            *ARC,
            *[F.coalesce(h, a).alias(h) for a, h in zip(ARC, HEAD)],
            F.coalesce("off", F.lit(0).cast("long")).alias("offset"),
            *[F.when(grown, F.col("new_" + c)).otherwise(F.col(c)).alias(c) for c in NEXT],
            F.coalesce("new_steps", "steps").alias("steps"),
        )
    )


def _ends(steps: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    last = steps.groupBy("session_id").agg(F.max_by("key", "depth").alias("key")).withColumnRenamed("session_id", "end_id")
    at = nodes.where("depth > 0").select("key", "session_id", "depth")
    full = hand_back(last, at, "key", F.pmod(F.xxhash64("end_id"), F.lit(SALTS))).select("session_id", "depth", "end_id")
    idle = known.join(last, F.col("session_id") == F.col("end_id"), "left_anti").select(F.col("session_id").alias("end_id"))
    root = F.lit(known.agg(F.min("session_id")).first()[0]).cast(dict(known.dtypes)["session_id"])
    return full.unionByName(idle.select(root.alias("session_id"), F.lit(0).cast("long").alias("depth"), "end_id"))


def end_digests(ends: DataFrame) -> DataFrame:
    """``session_id, depth, ends_sha256``: the digest of the ids that end at a node, ascending, joined by commas.

    Ids are sorted across tasks and written in rows of up to ``CHUNK``; a task then reads the rows of a node in turn and
    holds one at a time, however many sessions end there.
    """
    node = ("session_id", "depth")
    placed = in_order(ends, *node, "end_id").withColumn("chunk", F.expr(f"__pos div {CHUNK}"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("__pos", "end_id"))), lambda x: x["end_id"].cast("string"))
    chunks = placed.groupBy(*node, "__part", "chunk").agg(F.array_join(ids, ",").alias("text"))
    dealt = chunks.repartition(partitions_of(ends.sparkSession), *node).sortWithinPartitions(*node, "__part", "chunk")
    kind = dict(ends.dtypes)["session_id"]
    return dealt.select(*node, "text").mapInArrow(_digested, f"session_id {kind}, depth long, ends_sha256 string")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest, kinds, done = None, None, None, []

    def rows():
        columns = list(zip(*done)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*kinds, pa.string()))], names=["session_id", "depth", "ends_sha256"])

    for batch in batches:
        kinds = [batch.column("session_id").type, pa.int64()]
        for *here, text in zip(*[batch.column(c).to_pylist() for c in ("session_id", "depth", "text")]):
            if here == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = here, hashlib.sha256()
            digest.update(text.encode())
        if done:
            yield rows()
            done = []
    if node is not None:
        done.append((*node, digest.hexdigest()))
        yield rows()
