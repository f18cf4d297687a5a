"""Runs, graphs, steps and replies derived from the star-schema test tables.

One SQL text per view serves Spark and DuckDB: both use the same whole-number arithmetic. Braces of
JSON are written << and >>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verity.plans.tables import table

RESULTS = """
SELECT o_orderkey AS ord, CAST(o_orderkey AS STRING) AS instance_id, concat('m', CAST(o_custkey % 3 AS STRING)) AS model,
       o_orderpriority AS benchmark,
       CASE o_orderpriority WHEN '1-URGENT' THEN '<15 min fix' WHEN '2-HIGH' THEN '15 min - 1 hour' WHEN '3-MEDIUM' THEN '1-4 hours' WHEN '4-NOT SPECIFIED' THEN '>4 hours' END AS difficulty,
       CAST((o_orderkey * 37 + o_custkey * 11) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS estimated_confidence,
       CASE WHEN (o_orderkey * 53 + o_custkey * 29) % 100 < (o_orderkey * 37 + o_custkey * 11) % 101 THEN 1 ELSE 0 END AS resolved,
       CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE 1000 + o_orderkey % 9000 END AS total_tokens,
       CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE 100 + o_orderkey % 900 END AS generated_tokens
FROM {orders}
"""
RESULTS_RUNS = """
SELECT r.run, s.* FROM {results} s CROSS JOIN (SELECT 'run-a' AS run, 3 AS k UNION ALL SELECT 'run-b', 7 UNION ALL SELECT 'run-c', 11) r
WHERE (s.ord + r.k) % 13 <> 0
"""
GNODES = """
SELECT n_nationkey AS gid, concat('n', CAST(n_nationkey AS STRING)) AS id, 'GSNGoalNode' AS kind, CAST(-1 AS DOUBLE) AS confidence, CAST(0.8 AS DOUBLE) AS confidence_in_children FROM {nation}
UNION ALL SELECT c_nationkey, concat('c', CAST(c_custkey AS STRING)), 'GSNGoalNode', CAST(50 + c_custkey % 50 AS DOUBLE) / CAST(100 AS DOUBLE), CAST(0.9 AS DOUBLE) FROM {customer}
UNION ALL SELECT c_nationkey, concat('o', CAST(o_orderkey AS STRING)), 'GSNGoalNode', CAST(9990000 + (o_orderkey * 37) % 10001 AS DOUBLE) / CAST(10007003 AS DOUBLE), CAST(-1 AS DOUBLE) FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""
GEDGES = """
SELECT c_nationkey AS gid, concat('c', CAST(c_custkey AS STRING)) AS source, concat('n', CAST(c_nationkey AS STRING)) AS target, 'decomposes_from' AS relationship_type, c_custkey AS pos FROM {customer}
UNION ALL SELECT c_nationkey, concat('o', CAST(o_orderkey AS STRING)), concat('c', CAST(c_custkey AS STRING)), CASE WHEN count(*) OVER (PARTITION BY c_custkey) = 1 THEN 'particularizes' ELSE 'decomposes_from' END, o_orderkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""
#: The same graphs with evidence: below customers, and below some of the orders.
ENODES = """
SELECT gid, id, kind, confidence, CAST(-1 AS INT) AS s1, CAST(-1 AS INT) AS s2 FROM {gnodes}
UNION ALL SELECT c_nationkey, concat('e', CAST(o_orderkey AS STRING)), 'EvidenceNodeV2', CASE WHEN o_orderkey % 3 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(o_orderkey % 89 AS DOUBLE) / CAST(89 AS DOUBLE) END, CAST(o_orderkey % 50 AS INT), CAST((o_orderkey * 7) % 61 AS INT) FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderkey % 4 = 0
"""
EEDGES = """
SELECT gid, source, target, relationship_type FROM {gedges}
UNION ALL SELECT c_nationkey, concat('e', CAST(o_orderkey AS STRING)), CASE WHEN o_orderkey % 8 = 0 THEN concat('o', CAST(o_orderkey AS STRING)) ELSE concat('c', CAST(c_custkey AS STRING)) END,
  CASE o_orderkey % 5 WHEN 0 THEN 'proves' WHEN 1 THEN 'supports' WHEN 2 THEN 'refutes' WHEN 3 THEN 'undermines' ELSE 'unverified' END FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderkey % 4 = 0
"""
#: Edges that no tree may have: a second parent for some orders, which also mixes relations.
BADEDGES = """
SELECT gid, source, target, relationship_type FROM {gedges}
UNION ALL SELECT c_nationkey, concat('o', CAST(o_orderkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), 'particularizes' FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderkey % 25 = 0
UNION ALL SELECT c_nationkey, concat('x', CAST(c_custkey AS STRING)), concat('y', CAST(c_custkey AS STRING)), 'particularizes' FROM {customer} WHERE c_custkey % 3 = 0
UNION ALL SELECT c_nationkey, concat('z', CAST(c_custkey AS STRING)), concat('y', CAST(c_custkey AS STRING)), 'particularizes' FROM {customer} WHERE c_custkey % 6 = 0
"""
#: Deep graphs: the orders of a nation as one chain of goals, each with a leaf and the next order below
#: it (the last one with its leaf alone), and evidence that cites steps under every third.
DEEPNODES = """
SELECT gid, concat('d', CAST(r AS STRING)) AS id, 'GSNGoalNode' AS kind, CAST(40 + ok % 60 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence, CAST(0.6 AS DOUBLE) AS confidence_in_children, CAST(-1 AS INT) AS s1, CAST(-1 AS INT) AS s2, CAST(r AS BIGINT) AS r FROM {chains}
UNION ALL SELECT gid, concat('l', CAST(r AS STRING)), 'GSNGoalNode', CAST(9990000 + (ok * 37) % 10001 AS DOUBLE) / CAST(10007003 AS DOUBLE), CAST(-1 AS DOUBLE), CAST(-1 AS INT), CAST(-1 AS INT), CAST(r AS BIGINT) FROM {chains}
UNION ALL SELECT gid, concat('e', CAST(r AS STRING)), 'EvidenceNodeV2', CAST(-1 AS DOUBLE), CAST(-1 AS DOUBLE), CAST((ok * 7919) % 40000 AS INT), CAST(ok % 61 AS INT), CAST(r AS BIGINT) FROM {chains} WHERE ok % 3 = 0
"""
DEEPEDGES = """
SELECT gid, concat('d', CAST(r + 1 AS STRING)) AS source, concat('d', CAST(r AS STRING)) AS target, 'decomposes_from' AS relationship_type, CAST(r AS BIGINT) AS pos FROM {chains} WHERE r < n
UNION ALL SELECT gid, concat('l', CAST(r AS STRING)), concat('d', CAST(r AS STRING)), 'decomposes_from', CAST(r AS BIGINT) FROM {chains}
UNION ALL SELECT gid, concat('e', CAST(r AS STRING)), concat('d', CAST(r AS STRING)), 'supports', CAST(r AS BIGINT) FROM {chains} WHERE ok % 3 = 0
"""
CHAINS = """
SELECT c_nationkey AS gid, o_orderkey AS ok, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""
#: Tool calls with raw inputs and content blocks of every form, right and wrong.
RAWCALLS = """
SELECT user_id AS traj, event_id AS idx, concat('c', CAST(event_id AS STRING)) AS tool_call_id, CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'completed' END AS status, event_type AS title,
       CASE event_id % 5 WHEN 0 THEN 'execute' WHEN 1 THEN 'read' WHEN 2 THEN 'read' ELSE 'edit' END AS call_kind,
       CASE event_id % 11 WHEN 0 THEN concat('<<"file_path":"/a/', CAST(event_id AS STRING), '">>') WHEN 1 THEN concat('<<"path":"/b/', CAST(event_id AS STRING), '">>') WHEN 2 THEN '<<"file_path":7,"path":"/c">>' WHEN 3 THEN concat('<<"changes":<<"/d/', CAST(event_id AS STRING), '":<<"x":1>>>>>>')
         WHEN 4 THEN '<<"changes":<<"/e":1,"/f":2>>>>' WHEN 5 THEN '<<"command":"ls">>' WHEN 7 THEN '[1,2]' WHEN 8 THEN '<<>>' WHEN 9 THEN '<<"changes":<<"/g":1>>,"path":5>>' WHEN 10 THEN '<<"file_path":null,"path":"/h">>' END AS raw_input,
       CASE event_id % 7 WHEN 0 THEN '[]' WHEN 1 THEN concat('[<<"type":"diff","path":"/x/', CAST(event_id AS STRING), '","new_text":"n">>]') WHEN 2 THEN '[<<"type":"diff","path":"/y","new_text":"n">>,<<"type":"diff","path":"/z","old_text":"o","new_text":"n">>]'
         WHEN 3 THEN '[<<"type":"content","content":<<"type":"text","text":"t">>>>]' WHEN 4 THEN '[<<"type":"diff","path":"/w","old_text":null,"new_text":"n">>]' WHEN 5 THEN '[<<"type":"diff","path":"/v","old_text":3,"new_text":"n">>]' END AS content
FROM {events}
"""
#: Graph documents, most of them with something wrong.
LOOSE = """
SELECT o_orderkey AS gid, CASE o_orderkey % 13 WHEN 11 THEN '[1]' WHEN 12 THEN 'no json <<' ELSE concat('<<"note":', CAST(o_orderkey AS STRING), CASE o_orderkey % 13 WHEN 1 THEN '' WHEN 2 THEN ',"nodes":<<"id":"a">>' ELSE concat(',"nodes":[<<"id":"a","kind":"GSNGoalNode","weight":', CAST(o_custkey AS STRING), '>>,',
    CASE o_orderkey % 13 WHEN 3 THEN '<<"kind":"GSNGoalNode">>' WHEN 4 THEN '<<"id":"b">>' WHEN 5 THEN '<<"id":"a","kind":"EvidenceNodeV2","steps":[1]>>' WHEN 10 THEN '17' ELSE '<<"id":"b","kind":"EvidenceNodeV2","steps":[1,2]>>' END, ']') END,
    CASE o_orderkey % 13 WHEN 9 THEN '' ELSE concat(',"edges":[<<"source":"', CASE o_orderkey % 13 WHEN 7 THEN 'q' ELSE 'b' END, '","target":"', CASE o_orderkey % 13 WHEN 8 THEN 'r' ELSE 'a' END, '"', CASE o_orderkey % 13 WHEN 6 THEN '' ELSE ',"relationship_type":"supports"' END, '>>]') END, '>>') END AS doc
FROM {orders}
"""
#: Snapshots of calls that may begin anew, be told twice, or never end.
SNAPSHOTS = """
SELECT user_id AS traj, concat(event_type, CAST(event_id % 2 AS STRING)) AS tool_call_id, CAST(event_id - event_id % 10 + CASE WHEN event_id % 10 = 9 THEN 8 ELSE event_id % 10 END AS BIGINT) AS idx, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('title ', CAST(event_id AS STRING)) END AS title,
       CASE event_id % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'pending' END AS status, ts
FROM {events}
"""
STEPS = """
SELECT user_id AS traj, event_id, ts, event_type, value,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx,
       lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_id,
       CASE WHEN event_type IN ('click','purchase') THEN 'action' WHEN event_type = 'error' THEN 'error' ELSE 'observation' END AS kind
FROM {events}
"""
#: Logs in which two calls run at a time, group by group: two actions, what they give in either order
#: (or an error that names the call), then a message or a late error. Calls are named anew every fourth
#: group. ``calls_broken`` has names that nothing bears, and groups that end too soon.
CALLS_BROKEN = """
SELECT traj, event_id, ts, idx, CASE WHEN r IN (0, 1) THEN 'action' WHEN r = 2 AND event_id % 5 = 0 THEN 'error' WHEN r IN (2, 3) THEN 'observation' WHEN event_id % 3 = 0 THEN 'error' ELSE 'message' END AS kind,
       CASE WHEN event_id % 97 = 0 THEN -1 WHEN r = 2 AND event_id % 5 <> 0 THEN CASE WHEN g % 2 = 0 THEN lag(event_id, 1) OVER w ELSE lag(event_id, 2) OVER w END WHEN r = 3 THEN CASE WHEN g % 2 = 0 THEN lag(event_id, 3) OVER w ELSE lag(event_id, 2) OVER w END END AS action_id,
       CASE WHEN r IN (0, 1) THEN concat('c', CAST(g % 4 AS STRING), '-', CAST(r AS STRING)) WHEN event_id % 89 = 0 THEN 'lost' WHEN r = 2 AND event_id % 5 = 0 THEN concat('c', CAST(g % 4 AS STRING), '-', CASE WHEN g % 2 = 0 THEN '1' ELSE '0' END) WHEN r = 4 AND event_id % 3 = 0 THEN concat('c', CAST(g % 4 AS STRING), '-0') END AS tool_call_id
FROM (SELECT user_id AS traj, event_id, ts, idx, CAST(floor((idx - 1) / 5) AS BIGINT) AS g, (idx - 1) % 5 AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM {events}) s) t
WINDOW w AS (PARTITION BY traj ORDER BY idx)
"""
#: The same without what is broken: whole groups whose names are all borne.
CALLS = """
SELECT traj, event_id, ts, row_number() OVER (PARTITION BY traj ORDER BY idx) AS idx, kind, action_id, tool_call_id
FROM (SELECT *, count(*) OVER (PARTITION BY traj, floor((idx - 1) / 5)) AS members, max(CASE WHEN action_id = -1 OR tool_call_id = 'lost' THEN 1 ELSE 0 END) OVER (PARTITION BY traj, floor((idx - 1) / 5)) AS broken FROM {calls_broken}) s
WHERE members = 5 AND broken = 0
"""
CONV = """
SELECT conv_id, turn, role, text, concat(text, {newline}, 'Confidence: ', CAST((conv_id * 17 + turn * 5) % 130 AS STRING), '%') AS response
FROM {conversations}
"""
TABLES = {"results": (RESULTS, ["orders"]), "results_runs": (RESULTS_RUNS, ["results"]), "gnodes": (GNODES, ["nation", "customer", "orders"]), "gedges": (GEDGES, ["customer", "orders"]), "enodes": (ENODES, ["gnodes", "orders", "customer"]), "eedges": (EEDGES, ["gedges", "orders", "customer"]), "badedges": (BADEDGES, ["gedges", "orders", "customer"]), "steps": (STEPS, ["events"]), "rawcalls": (RAWCALLS, ["events"]), "loose": (LOOSE, ["orders"]), "snapshots": (SNAPSHOTS, ["events"]), "chains": (CHAINS, ["orders", "customer"]), "deepnodes": (DEEPNODES, ["chains"]), "deepedges": (DEEPEDGES, ["chains"]), "calls_broken": (CALLS_BROKEN, ["events"]), "calls": (CALLS, ["calls_broken"]), "conv": (CONV, ["conversations"])}


def view(spark: SparkSession, sf_dir: str, name: str, **made: DataFrame) -> DataFrame:
    """A derived view, or the table of that name; what it needs is derived too, but for what is ``made``."""
    if name not in TABLES:
        return table(spark, sf_dir, name)
    text, needs = TABLES[name]
    text = text.replace("{newline}", "char(10)").replace("<<", "{{").replace(">>", "}}")  # braces of JSON
    return spark.sql(text, **{n: made[n] if n in made else view(spark, sf_dir, n, **made) for n in needs})


def with_views(*names: str) -> str:
    """The common table expressions of these views (and what they need), for DuckDB."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES and name not in parts:
            text, needs = TABLES[name]
            for n in needs:
                add(n)
            for n in needs:
                text = text.replace("{" + n + "}", n)
            parts[name] = text.replace("{newline}", "chr(10)").replace("<<", "{").replace(">>", "}")

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({t.strip()})" for n, t in parts.items())
