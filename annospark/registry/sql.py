"""Building blocks of the check queries, in the dialect of the checking engine."""

from __future__ import annotations

# The derived tables; see annospark.fixtures.
TABLES = {
    "images": "SELECT o_orderkey AS image_id, 640 AS width, 480 AS height FROM orders",
    "cand_keys": "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem",
    "cand_ranked": """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) - 1 AS ord
        FROM cand_keys""",
    "cand_sized": """SELECT l_orderkey AS image_id, ord AS box_ord,
        CAST((l_orderkey*37 + (ord % 3)*211) % 400 + (l_partkey % 40) AS DOUBLE) AS x1,
        CAST((l_orderkey*53 + (ord % 3)*131) % 300 + (l_suppkey % 40) AS DOUBLE) AS y1,
        CAST(40 + l_partkey % 120 AS DOUBLE) AS w, CAST(40 + (l_partkey + l_suppkey) % 120 AS DOUBLE) AS h,
        CAST((l_partkey + l_suppkey) % 4 AS INT) AS label,
        ((l_partkey*7919 + l_suppkey*104729 + l_orderkey*31) % 10000)::DOUBLE / 10000.0::DOUBLE AS p_good,
        ((l_partkey*6271 + l_suppkey*3571 + l_orderkey*17) % 10000)::DOUBLE / 10000.0::DOUBLE AS det_conf
        FROM cand_ranked""",
    "candidates": """SELECT image_id, box_ord, x1, y1, x1+w AS x2, y1+h AS y2, label, p_good, det_conf FROM cand_sized""",
    "gold": """SELECT image_id, box_ord, x1+(image_id%9) AS x1, y1+(box_ord%7)*2 AS y1, x2+(image_id%9) AS x2,
        y2+(box_ord%7)*2 AS y2, CAST((label + (CASE WHEN image_id%11=0 THEN 1 ELSE 0 END)) % 4 AS INT) AS label
        FROM candidates WHERE (image_id+box_ord) % 3 <> 0""",
    "human": "SELECT * FROM gold WHERE image_id % 20 = 0",
    "owned": "SELECT image_id FROM images WHERE image_id % 20 = 0",
    "targets": "SELECT image_id FROM images WHERE image_id % 20 <> 0",
    "pool": "SELECT * FROM candidates WHERE image_id % 20 <> 0",
    "cand_norm": """SELECT image_id, box_ord, label AS cls, (x1+x2)/2/640.0::DOUBLE AS cx, (y1+y2)/2/480.0::DOUBLE AS cy,
        (x2-x1)/640.0::DOUBLE AS w, (y2-y1)/480.0::DOUBLE AS h FROM candidates""",
    "gold_norm": """SELECT image_id, box_ord, label AS cls, (x1+x2)/2/640.0::DOUBLE AS cx, (y1+y2)/2/480.0::DOUBLE AS cy,
        (x2-x1)/640.0::DOUBLE AS w, (y2-y1)/480.0::DOUBLE AS h FROM gold""",
    "telemetry": """SELECT epoch_us(ts) // 1000 AS ts_ms, CAST(user_id AS VARCHAR) AS session_id,
        CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'view' THEN 'candidate_rendered' WHEN 'click' THEN 'box_accept'
        WHEN 'error' THEN 'box_reject' WHEN 'purchase' THEN 'image_finalized' END AS event_type,
        CAST(event_id % 1000 AS VARCHAR) AS image_id, concat(event_id % 1000, ':', event_id % 5) AS box_id,
        CAST(floor(value*1000) AS BIGINT) AS dwell_ms FROM events""",
    # seed figures
    "seed_counts": "SELECT image_id, count(*) AS n FROM human GROUP BY image_id",
    "seed_sorted": "SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM seed_counts",
    "seed": """SELECT count(*) AS n_images, sum(n)::BIGINT AS total_boxes, avg(n) AS mean_count, median(n) AS median_count,
        (SELECT max(n)::DOUBLE FROM seed_sorted WHERE i = round_even(0.9::DOUBLE*(c-1), 0)) AS p90_count FROM seed_counts""",
    "nesting": """SELECT count(*) AS nested FROM human a JOIN human b ON a.image_id = b.image_id AND a.box_ord <> b.box_ord
        WHERE {a_in_b} >= 0.8""",
    "decision_raw": """SELECT (SELECT nested FROM nesting) / (SELECT sum(n*(n-1)) FROM seed_counts)::DOUBLE AS frac,
        (SELECT mean_count FROM seed) AS mean,
        (SELECT max(n) FROM seed_sorted WHERE i = least(c-1, floor(0.9::DOUBLE*c))) AS p90""",
    "decision": """SELECT NOT (frac >= 0.03 OR mean < 2.5) AS containment,
        CAST(greatest(2, round_even(1.5::DOUBLE*p90, 0)) AS INT) AS max_topk FROM decision_raw""",
}

NEEDS = {
    "cand_ranked": ["cand_keys"],
    "cand_sized": ["cand_ranked"],
    "candidates": ["cand_sized"],
    "gold": ["candidates"],
    "human": ["gold"],
    "owned": ["images"],
    "targets": ["images"],
    "pool": ["candidates"],
    "cand_norm": ["candidates"],
    "gold_norm": ["gold"],
    "seed_counts": ["human"],
    "seed_sorted": ["seed_counts"],
    "seed": ["seed_sorted"],
    "nesting": ["human"],
    "decision_raw": ["nesting", "seed"],
    "decision": ["decision_raw"],
}


def shared(a: str, b: str) -> str:
    return (
        f"(greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1),0.0::DOUBLE)"
        f"*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1),0.0::DOUBLE))"
    )


def area(a: str) -> str:
    return f"(greatest({a}.x2-{a}.x1,0.0::DOUBLE)*greatest({a}.y2-{a}.y1,0.0::DOUBLE))"


def iou(a: str, b: str) -> str:
    return f"coalesce({shared(a, b)}/nullif({area(a)}+{area(b)}-{shared(a, b)},0.0::DOUBLE),0.0::DOUBLE)"


def containment(inner: str, outer: str) -> str:
    return f"coalesce({shared(inner, outer)}/nullif({area(inner)},0.0::DOUBLE),0.0::DOUBLE)"


TABLES["nesting"] = TABLES["nesting"].format(a_in_b=containment("a", "b"))


def fold(name: str, source: str, order: str, over: float, contain: str = "false") -> list[tuple[str, str]]:
    """Greedy suppression of ``source`` as a recursion over the boxes of each image in ``order``.

    ``contain`` is a constant or ``d.containment`` from the decision.
    """
    block = f"{iou('k', 'r')} > {over} OR ({contain} AND {shared('k', 'r')} > 0 AND {area('r')} <= {area('k')}"
    block += f" AND {containment('r', 'k')} >= 0.8)"
    evict = f"{contain} AND {area('k')} < {area('r')} AND {containment('k', 'r')} >= 0.8"
    joined = " JOIN decision d ON true" if contain.startswith("d.") else ""
    return [
        (f"{name}_rk", f"SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS rk FROM {source}"),
        (
            f"{name}_run(image_id, rk, kept)",
            f"""SELECT DISTINCT image_id, 0::BIGINT, []::STRUCT(o BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] FROM {source}
        UNION ALL SELECT r.image_id, r.rk, CASE WHEN len(list_filter(s.kept, lambda k: {block})) > 0 THEN s.kept ELSE
          list_append(list_filter(s.kept, lambda k: NOT ({evict})),
            {{'o': r.box_ord, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) END
        FROM {name}_run s JOIN {name}_rk r ON r.image_id = s.image_id AND r.rk = s.rk + 1{joined}""",
        ),
        (f"{name}_last", f"SELECT image_id, arg_max(kept, rk) AS kept FROM {name}_run GROUP BY image_id"),
        (f"{name}_keys", f"SELECT image_id, unnest(kept).o AS box_ord FROM {name}_last"),
        (name, f"SELECT s.* FROM {source} s JOIN {name}_keys USING (image_id, box_ord)"),
    ]


def contained_sweep(name: str, source: str, contain: str = "true") -> list[tuple[str, str]]:
    """Drop boxes lying in a strictly larger box of ``source``."""
    joined = ", decision d" if contain.startswith("d.") else ""
    return [
        (
            name,
            f"""SELECT i.* FROM {source} i{joined} WHERE NOT ({contain} AND EXISTS (SELECT 1 FROM {source} o WHERE
        o.image_id = i.image_id AND o.box_ord <> i.box_ord AND {area('o')} > {area('i')} AND {containment('i', 'o')} >= 0.8))""",
        )
    ]


def match(name: str, pred: str, gold: str, at_least: float, class_aware: bool = False) -> list[tuple[str, str]]:
    """Greedy one-to-one matching as a recursion over the pairs of each image."""
    same = " AND a.label = b.label" if class_aware else ""
    return [
        (
            f"{name}_pairs",
            f"""SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, pi DESC, gi DESC) AS rk FROM (
        SELECT a.image_id, a.box_ord AS pi, b.box_ord AS gi, {iou('a', 'b')} AS iou, a.label AS pred_label, b.label AS gold_label
        FROM {pred} a JOIN {gold} b ON a.image_id = b.image_id WHERE {iou('a', 'b')} >= {at_least}{same})""",
        ),
        *match_pairs(name, f"{name}_pairs", ["image_id"]),
    ]


def match_pairs(name: str, pairs: str, keys: list[str]) -> list[tuple[str, str]]:
    """The recursion of ``match`` on given pairs with rank ``rk`` inside ``keys``."""
    k = ", ".join(keys)
    return [
        (
            f"{name}_run({k}, rk, done)",
            f"""SELECT DISTINCT {k}, 0::BIGINT, []::STRUCT(p BIGINT, g BIGINT)[] FROM {pairs}
        UNION ALL SELECT {', '.join('r.' + c for c in keys)}, r.rk,
          CASE WHEN len(list_filter(s.done, lambda m: m.p = r.pi OR m.g = r.gi)) > 0 THEN s.done
          ELSE list_append(s.done, {{'p': r.pi, 'g': r.gi}}) END
        FROM {name}_run s JOIN {pairs} r ON {' AND '.join(f'r.{c} = s.{c}' for c in keys)} AND r.rk = s.rk + 1""",
        ),
        (f"{name}_won", f"SELECT {k}, unnest(arg_max(done, rk)) AS m FROM {name}_run GROUP BY {k}"),
        (
            name,
            f"""SELECT p.* FROM {pairs} p JOIN {name}_won w ON {' AND '.join(f'p.{c} = w.{c}' for c in keys)}
        AND p.pi = w.m.p AND p.gi = w.m.g""",
        ),
    ]


def query(body: str, *parts) -> str:
    """A full statement: needed derived tables, then ``parts`` (name/text pairs or lists of them), then ``body``."""
    steps: list[tuple[str, str]] = []
    for part in parts:
        steps.extend(part if isinstance(part, list) else [part])
    text = body + " ".join(t for _, t in steps)
    wanted: list[str] = []

    def add(name: str) -> None:
        if name in wanted:
            return
        for other in NEEDS.get(name, []):
            add(other)
        wanted.append(name)

    for name in TABLES:
        if _mentions(text, name):
            add(name)
    every = [(n, TABLES[n]) for n in wanted] + steps
    if not every:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({t})" for n, t in every) + "\n" + body


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b(FROM|JOIN|,)\s*{name}\b", text) is not None


# -- reproducible draws -------------------------------------------------------------------------
def digest(seed: int, *keys: str) -> str:
    return "md5(concat_ws(':', " + ", ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]]) + "))"


def order_key(seed: int, *keys: str) -> str:
    return f"CAST('0x' || substr({digest(seed, *keys)}, 1, 13) AS BIGINT)"


def uniform(i: int, seed: int, *keys: str) -> str:
    return f"(CAST('0x' || substr({digest(seed, *keys)}, {1 + 8 * i}, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE)"
