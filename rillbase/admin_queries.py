"""Queries of the admin surface and of the smaller planning rules, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import routing, scalar
from .operators import admin, append, metrics, replication
from .plans import commands, layout
from .queries import _BYTES, _M, COPIES, LOG, copies, leos, log_events, placements, progress, query, sql_hash, table


@query(
    "WITH r AS (SELECT o_orderkey AS slot, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'node-' || (o_orderkey % 3) END AS leader, CASE WHEN o_orderkey % 7 = 0 THEN 'migrating' ELSE 'stable' END AS state, o_orderkey % 2 = 0 AS control_only FROM orders) "
    "SELECT slot, CASE WHEN leader = '' AND slot > 0 AND 2 ** (length(bin(slot)) - 1) < 256 THEN 1010 WHEN leader = '' AND control_only THEN 1009 WHEN leader = '' THEN 0 WHEN state = 'migrating' AND leader <> 'node-1' THEN 1004 WHEN leader = 'node-1' THEN 0 ELSE 1003 END AS err_id FROM r"
)
def routing_verdict(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("slot"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("node-"), k % 3)).alias("leader"), F.lit("node-1").alias("self"), F.when(k % 7 == 0, "migrating").otherwise("stable").alias("state"), F.lit(256).alias("served_base"), (k % 2 == 0).alias("control_only"))
    return rows.select("slot", admin.routing_verdict().alias("err_id"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 1006 WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 >= 2 THEN 1008 WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 AND o_orderkey % 4 >= 2 AND o_orderkey % 2 > 0 AND o_orderkey % 4000 >= 2000 THEN 1008 ELSE 0 END AS err_id FROM orders"
)
def land_guard(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", (k % 11 == 0).alias("pending"), (k % 3 != 0).alias("has_copy"), (k % 5).alias("copy_leo"), (k % 4).alias("epoch"), (k % 2).alias("seat_leo"), (k % 4000).alias("seat_ms"))
    return rows.select("o_orderkey", admin.land_guard().alias("err_id"))


@query(COPIES + "SELECT p.slot FROM place p LEFT JOIN (SELECT slot, max(CASE WHEN slot % 2 = 0 THEN 0 ELSE leo END) AS leo FROM progress WHERE slot <> 12 GROUP BY slot) t USING (slot) WHERE leo IS NULL OR leo > 0")
def busy_slots(spark, d):
    known = leos(spark, d).where("slot <> 12").withColumn("leo", F.when(F.col("slot") % 2 == 0, 0).otherwise(F.col("leo")))
    return admin.busy_slots(placements(spark, d), known)


_PROBES = "WITH probes AS (SELECT 'node-' || user_id AS node, event_id * 700 AS at_ms, value < 60 AS answered, value >= 60 AND event_type IN (SELECT min(event_type) FROM events) AS refused FROM events)"


@query(
    _PROBES
    + ", s AS (SELECT *, sum(answered::INT) OVER w AS streak, sum((NOT refused)::INT) OVER w AS run FROM probes WINDOW w AS (PARTITION BY node ORDER BY at_ms)), "
    "f AS (SELECT *, sum((NOT answered)::INT) OVER (PARTITION BY node, streak ORDER BY at_ms) AS fails, min(CASE WHEN refused THEN at_ms END) OVER (PARTITION BY node, run ORDER BY at_ms) AS since FROM s), "
    "l AS (SELECT node, streak, bool_or(NOT answered AND CASE WHEN refused THEN at_ms - since >= 3000 ELSE fails >= 3 END) AS down FROM f GROUP BY ALL) SELECT node, arg_max(down, streak) AS down FROM l GROUP BY node"
)
def liveness(spark, d):
    e = table(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("kind"))
    probes = e.crossJoin(F.broadcast(kind)).select(F.concat(F.lit("node-"), F.col("user_id")).alias("node"), (F.col("event_id") * 700).alias("at_ms"), (F.col("value") < 60).alias("answered"), ((F.col("value") >= 60) & (F.col("event_type") == F.col("kind"))).alias("refused"))
    return admin.liveness(probes)


@query("WITH t AS (SELECT n_nationkey AS slot, n_nationkey % 4 = 1 AS c, n_nationkey % 3 = 0 AS m, (n_nationkey - 7 + 25) % 25 AS turn FROM nation) SELECT slot, row_number() OVER (ORDER BY CASE WHEN c THEN 0 WHEN m THEN 1 ELSE 2 END, turn) - 1 AS place FROM t")
def fetch_order(spark, d):
    k = F.col("n_nationkey")
    slots = table(spark, d, "nation").select(k.alias("slot"), k.alias("i"), (k % 4 == 1).alias("critical"), (k % 3 == 0).alias("ring_moving"))
    return admin.fetch_order(slots, 7).withColumn("place", F.col("place").cast("long"))


@query("SELECT n_nationkey AS slot, n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 AS adopted FROM nation")
def adopt_pending(spark, d):
    slots = table(spark, d, "nation").select(F.col("n_nationkey").alias("slot"))
    return admin.adopt(slots, slots.where("slot % 2 = 0"), slots.where("slot % 3 = 0"))


@query(LOG + f"SELECT slot, count(*) AS writes, sum({_BYTES})::BIGINT AS write_bytes, count(*) FILTER (WHERE event_id % 4 <> 0) AS client_writes, coalesce(sum({_BYTES}) FILTER (WHERE event_id % 4 <> 0), 0)::BIGINT AS client_write_bytes FROM log GROUP BY slot")
def write_counters(spark, d):
    events = F.array(F.struct(F.col("event_type").alias("type"), F.encode("body", "UTF-8").alias("body")))
    log = log_events(spark, d).select("slot", scalar.encoded_size(F.col("aggregate_id"), F.col("command_id"), events).alias("bytes"), F.when(F.col("event_id") % 4 != 0, "client").otherwise("replica").alias("origin"))
    return admin.write_counters(log)


@query(LOG + "SELECT slot, event_id AS at, seq - event_id % 13 AS leo, max(seq - event_id % 13) OVER (PARTITION BY slot ORDER BY event_id) AS floor FROM log".replace(" AS at,", ' AS "at",'))
def commit_floor(spark, d):
    reports = log_events(spark, d).select("slot", F.col("event_id").alias("at"), (F.col("seq") - F.col("event_id") % 13).alias("leo"))
    return admin.commit_floor(reports)


@query(LOG + ", f AS (SELECT slot, max(seq) - 5 AS floor FROM log GROUP BY slot) SELECT slot, seq, CASE WHEN event_id % 5 = 0 THEN 'exists' WHEN seq > floor THEN 'fail' ELSE 'success' END AS status, CASE WHEN event_id % 5 <> 0 AND seq > floor THEN 1007 ELSE 0 END AS err_id FROM log JOIN f USING (slot)")
def prefix_ack(spark, d):
    log = log_events(spark, d)
    results = log.select("slot", "seq", F.when(F.col("event_id") % 5 == 0, "exists").otherwise("success").alias("status"), F.lit(0).alias("err_id"))
    return admin.prefix_ack(results, log.groupBy("slot").agg((F.max("seq") - 5).alias("floor"))).select("slot", "seq", "status", "err_id")


@query("WITH s AS (SELECT user_id AS slot, count(*) AS appends, max(value) AS wait_p99, count(*) % 7 AS lag_peak FROM events GROUP BY user_id) SELECT * FROM s ORDER BY wait_p99 DESC, lag_peak DESC, slot LIMIT 10")
def worst_ack_slots(spark, d):
    slots = table(spark, d, "events").groupBy(F.col("user_id").alias("slot")).agg(F.count("*").alias("appends"), F.max("value").alias("wait_p99"), (F.count("*") % 7).alias("lag_peak"))
    return admin.worst_ack(slots, 10)


@query(LOG + """SELECT slot, '{"aggregates":' || count(DISTINCT aggregate_id) || ',"last_seq":' || max(seq) || ',"slot":' || slot || '}' AS json FROM log GROUP BY slot""")
def status_json(spark, d):
    return admin.status_json(log_events(spark, d).groupBy("slot").agg(F.count_distinct("aggregate_id").alias("aggregates"), F.max("seq").alias("last_seq")))


@query(f"WITH {sql_hash(chr(39).join(['SELECT ', 'bench-', ' || range AS id FROM range(2000)']))} SELECT id AS aggregate_id FROM routed WHERE h % 16 = 3")
def seed_ids(spark, d):
    return admin.seed_ids(spark, 3, 16, "bench-", 2000)


_FILTER_BITS = 1 << 17


@query(
    f"""WITH asked AS (SELECT 'evt-' || event_id AS id, true AS known FROM events UNION ALL SELECT 'new-' || event_id, false FROM events),
h0 AS (SELECT id, known, list_reduce(list_prepend({routing.FNV_OFFSET}::UHUGEINT, list_transform(string_split(id, ''), lambda c: ascii(c)::UHUGEINT)), lambda a, b: (xor(a, b) * {routing.FNV_PRIME}::UHUGEINT) % {_M}) AS h FROM asked),
h1 AS (SELECT *, (xor(h, h >> 30) * {routing.MIX_A}::UHUGEINT) % {_M} AS m FROM h0), h2 AS (SELECT id, known, h, (xor(m, m >> 27) * {routing.MIX_B}::UHUGEINT) % {_M} AS m FROM h1), h3 AS (SELECT id, known, h, xor(m, m >> 31) AS m FROM h2),
p AS (SELECT id, known, ((h + i::UHUGEINT * (m - m % 2 + 1)) % {_M}) % {_FILTER_BITS}::UHUGEINT AS place FROM h3, range(10) r(i)), bits AS (SELECT DISTINCT place FROM p WHERE known)
SELECT id AS command_id, bool_and(b.place IS NOT NULL) AS maybe FROM p LEFT JOIN bits b USING (place) GROUP BY id"""
)
def command_filter(spark, d):
    """Known commands, all of them maybe, and as many unknown ones, of which a small filter takes some for known."""
    log = log_events(spark, d)
    asked = log.select("command_id").unionByName(table(spark, d, "events").select(F.concat(F.lit("new-"), F.col("event_id")).alias("command_id")))
    return admin.maybe_known(asked, "command_id", admin.build_filter(log, _FILTER_BITS))


@query(COPIES + "SELECT node, count(*) FILTER (WHERE slot % 3 <> 0 AND node = leader) AS \"leading\", count(*) FILTER (WHERE slot % 3 = 0) AS in_flight FROM (SELECT p.slot, p.leader, unnest(replicas) AS node FROM place p) GROUP BY node HAVING \"leading\" > 0 OR in_flight > 0")
def drain_progress(spark, d):
    return layout.drain_progress(placements(spark, d).withColumn("state", F.when(F.col("slot") % 3 == 0, "migrating").otherwise("stable")))


@query("WITH s AS (SELECT o_orderkey, ['n' || (o_orderkey % 4), 'n' || ((o_orderkey + 1) % 4), 'n' || ((o_orderkey + 2) % 4)][1:2 + o_orderkey % 2] AS r, 'n' || (o_orderkey % 4) AS l, 'n' || ((o_orderkey + 1) % 4) AS t, 'n' || (o_orderkey % 5) AS f FROM orders), q AS (SELECT *, list_sort(list_filter(r, lambda x: x <> l AND x <> t)) AS free FROM s) SELECT o_orderkey, CASE WHEN len(r) > 2 THEN coalesce(CASE WHEN list_contains(free, f) THEN f END, free[1], '') ELSE '' END AS seat FROM q")
def surplus_seat(spark, d):
    k = F.col("o_orderkey")
    n = lambda x: F.concat(F.lit("n"), x)
    replicas = F.slice(F.array(n(k % 4), n((k + 1) % 4), n((k + 2) % 4)), F.lit(1), (2 + k % 2).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", layout.surplus_seat(replicas, n(k % 4), n((k + 1) % 4), n(k % 5), 2).alias("seat"))


@query("WITH s AS (SELECT o_orderkey, ['n' || (o_orderkey % 4), 'n' || ((o_orderkey + 1) % 4), 'n' || ((o_orderkey + 2) % 4)] AS r, 'n' || (o_orderkey % 4) AS l, ['n' || (o_orderkey % 3)] AS p FROM orders) SELECT o_orderkey, coalesce(list_sort(list_filter(r, lambda x: x <> l AND NOT list_contains(p, x)))[1], '') AS seat FROM s")
def surplus_for_replan(spark, d):
    k = F.col("o_orderkey")
    n = lambda x: F.concat(F.lit("n"), x)
    seat = layout.surplus_for_replan(F.array(n(k % 4), n((k + 1) % 4), n((k + 2) % 4)), n(k % 4), F.array(n(k % 3)), 2)
    return table(spark, d, "orders").select("o_orderkey", seat.alias("seat"))


_HAND = """WITH p AS (SELECT o_orderkey AS slot, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'node-' || (o_orderkey % 5) END AS leader, ['node-' || (o_orderkey % 5), 'node-' || ((o_orderkey + 1) % 5), 'node-' || ((o_orderkey + 2) % 5)] AS replicas,
 o_orderkey % 7 <> 0 AS stable, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'node-' || ((o_orderkey + o_orderkey % 4) % 5) END AS lead, o_orderkey % 2 = 0 AS balance FROM orders),
q AS (SELECT *, leader = 'node-2' AS drain, list_filter(replicas, lambda r: r <> leader AND r NOT IN ('node-1', 'node-2'))[1] AS heir FROM p WHERE stable AND leader <> '')"""


def _handed(spark, d):
    """Slots by order, their planned leaders, and five members of which node-1 is down and node-2 draining."""
    from .queries import nodes

    k = F.col("o_orderkey")
    node = lambda x: F.concat(F.lit("node-"), x)
    rows = table(spark, d, "orders").select(
        k.alias("slot"), F.when(k % 13 == 0, "").otherwise(node(k % 5)).alias("leader"), F.array(node(k % 5), node((k + 1) % 5), node((k + 2) % 5)).alias("replicas"), F.when(k % 7 != 0, "stable").otherwise("migrating_out").alias("state"),
        F.when(k % 3 == 0, "").otherwise(node((k + k % 4) % 5)).alias("lead"), (k % 2 == 0).alias("balance"), "o_custkey",
    )
    peers = nodes(spark, d).select("id", F.lit("learner").alias("role"), F.col("id").alias("client_addr"), (F.col("k") == 1).alias("down"), (F.col("k") == 2).alias("draining"))
    return rows, peers


@query(_HAND + """SELECT slot, leader AS "from", CASE WHEN drain THEN heir ELSE lead END AS "to", NOT drain AND balance AS balance FROM q WHERE CASE WHEN drain THEN heir IS NOT NULL ELSE lead <> '' AND lead <> leader AND list_contains(replicas, lead) END""")
def leader_rebalance(spark, d):
    rows, peers = _handed(spark, d)
    return layout.leader_rebalance(rows.select("slot", "leader", "replicas", "state"), rows.select("slot", "lead", "balance"), peers)


@query(_HAND + """SELECT slot, leader AS "from", heir AS "to", false AS balance FROM q WHERE drain AND heir IS NOT NULL""".replace("heir", "solo").replace("list_filter(replicas, lambda r: r <> leader AND r NOT IN ('node-1', 'node-2'))[1] AS solo", "0").replace("FROM q", "FROM (SELECT *, CASE WHEN list_contains(replicas, 'node-3') THEN 'node-3' END AS solo FROM q)"))
def leader_rebalance_alone(spark, d):
    """One online node: only slots of the draining leader move."""
    rows, peers = _handed(spark, d)
    alone = peers.withColumn("down", ~F.col("id").isin("node-2", "node-3"))
    return layout.leader_rebalance(rows.select("slot", "leader", "replicas", "state"), rows.select("slot", "lead", "balance"), alone)


@query("SELECT o_custkey, bool_and(o_orderkey % 7 <> 0) AS settled FROM orders GROUP BY o_custkey")
def layout_settled(spark, d):
    rows, _ = _handed(spark, d)
    return layout.settled(rows, ["o_custkey"])


@query("SELECT o_orderkey, o_orderkey % 3 <= 1 OR (o_orderkey % 4 + 1) % 2 = 0 OR o_orderkey % 5 = 0 AS open FROM orders")
def replan_gate(spark, d):
    """Pools of one to four members; the last plan's members are the same for every fifth layout."""
    k = F.col("o_orderkey")
    hosts = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.concat(F.lit("node-"), i))
    before = F.when(k % 5 == 0, F.reverse(hosts)).otherwise(F.array(F.lit("node-9")))
    return table(spark, d, "orders").select("o_orderkey", layout.gate_open(k % 3, hosts, before).alias("open"))


_DAY = 86_400_000


@query(
    f"WITH r AS (SELECT 'node-' || (event_id % 9) AS node, 'node-' || (user_id % 4) AS reporter, epoch_us(ts) // 1000 AS at_ms FROM events WHERE value > 40), v AS (SELECT * FROM r WHERE node <> reporter AND node NOT IN ('node-8', 'node-7')) "
    f"SELECT node, min(at_ms) AS at_ms FROM (SELECT a.node, a.at_ms FROM v a JOIN v b ON a.node = b.node AND b.at_ms <= a.at_ms AND b.at_ms >= a.at_ms - {_DAY} GROUP BY a.node, a.at_ms HAVING count(DISTINCT b.reporter) >= 2) GROUP BY node"
)
def unreachable_quorum(spark, d):
    """Reports of four nodes on nine, of which node-8 is unknown and node-7 is down already."""
    r = table(spark, d, "events").where("value > 40").select(F.concat(F.lit("node-"), F.col("event_id") % 9).alias("node"), F.concat(F.lit("node-"), F.col("user_id") % 4).alias("reporter"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    peers = spark.range(8).select(F.concat(F.lit("node-"), F.col("id")).alias("id"), (F.col("id") == 7).alias("down"))
    return layout.unreachable(r, peers, _DAY)


_MOVES = "SELECT s_suppkey, (8 + s_suppkey % 8)::INT AS slot, 'node-' || (s_nationkey % 6) AS \"to\", s_nationkey % 6 <= 3 AS taken FROM supplier"


def _changes(spark, d):
    """A changelog: five members, a ring of eight slots, a drain, a hand-over per supplier (some to a draining or unknown node), a migration."""
    start = [("config", '{"slot_count": 2048, "replicas": 2}'), ("set_topology", '{"id": "first"}'), ("set_topology", '{"id": "second"}')]
    start += [("join_node", f'{{"id": "node-{i}", "role": "learner", "client_addr": "c{i}"}}') for i in range(5)]
    start += [("set_policy", '{"policy": "3"}'), ("plan_slots", '{"gen": 3, "base": 8, "size": 8}'), ("drain_node", '{"id": "node-4", "on": true}')]
    head = spark.createDataFrame([(i, op, a) for i, (op, a) in enumerate(start)], "seq long, op string, args string")
    moves = table(spark, d, "supplier").select(
        (100 + F.col("s_suppkey")).cast("long").alias("seq"), F.lit("leader_move").alias("op"),
        F.to_json(F.struct(F.array(8 + F.col("s_suppkey") % 8).alias("slots"), F.concat(F.lit("node-"), F.col("s_nationkey") % 6).alias("to"), F.col("s_suppkey").alias("commit_leo"))).alias("args"),
    )
    tail = spark.createDataFrame([(1 << 40, "slot_state", '{"slots": [9], "state": "migrating_out", "to": "node-2"}'), ((1 << 40) + 1, "mark_up", '{"id": "node-77"}')], head.schema)
    return head.unionByName(moves).unionByName(tail)


@query(
    f"WITH m AS ({_MOVES}), ringed AS (SELECT s.slot::INT AS slot, 'node-' || ((s.slot - 8) % 5) AS leader, ['node-' || ((s.slot - 8) % 5), 'node-' || ((s.slot - 7) % 5), 'node-' || ((s.slot - 6) % 5)] AS seats FROM range(8, 16) s(slot)), "
    "t AS (SELECT m.*, lag(\"to\", 1, r.leader) OVER (PARTITION BY slot ORDER BY s_suppkey) AS before FROM m JOIN ringed r USING (slot) WHERE taken), "
    "n AS (SELECT slot, \"to\", min(s_suppkey) AS k FROM t JOIN ringed r USING (slot) WHERE NOT list_contains(r.seats, \"to\") GROUP BY ALL), added AS (SELECT slot, list(\"to\" ORDER BY k) AS more FROM n GROUP BY slot), "
    "a AS (SELECT slot, arg_max(\"to\", s_suppkey) AS last, count(*) FILTER (WHERE \"to\" <> before) AS moved, max(s_suppkey) AS floor FROM t GROUP BY slot) "
    "SELECT r.slot, coalesce(last, r.leader) AS leader, array_to_string(list_concat(seats, coalesce(more, [])), ',') AS replicas, 1 + coalesce(moved, 0) AS epoch, CASE WHEN r.slot = 9 THEN 'migrating_out' ELSE 'stable' END AS state, CASE WHEN r.slot = 9 THEN 'node-2' ELSE '' END AS migrating_to, coalesce(floor, 0)::BIGINT AS floor FROM ringed r LEFT JOIN a USING (slot) LEFT JOIN added USING (slot)"
)
def command_fold(spark, d):
    return commands.command_fold(_changes(spark, d)).withColumn("replicas", F.array_join("replicas", ","))


@query(f"WITH m AS ({_MOVES}) SELECT 100 + s_suppkey AS seq, 'leader_move' AS op, CASE WHEN \"to\" = 'node-4' THEN 'node-4 is draining' ELSE 'unknown node ' || \"to\" END AS reason FROM m WHERE NOT taken")
def command_refusals(spark, d):
    return commands.command_fold(_changes(spark, d), refusals=True)


@query("SELECT seq, frame FROM (SELECT 100 + s_suppkey AS seq, 'ENTRY' AS frame FROM supplier WHERE s_suppkey > 20 UNION ALL SELECT unnest([1099511627776, 1099511627777]), 'ENTRY' UNION ALL SELECT 1099511627777, 'COMMIT')")
def catalog_feed(spark, d):
    return commands.feed_entries(_changes(spark, d), 120).select("seq", "frame")


@query(COPIES + "SELECT coalesce(sum(leo) FILTER (WHERE slot < 12), 0)::BIGINT - coalesce(sum(leo) FILTER (WHERE slot >= 12), 0)::BIGINT AS gap FROM progress WHERE node = leader")
def segment_gap(spark, d):
    led = progress(spark, d).where("node = leader").select("slot", "leo")
    return replication.segment_gap(led, 8, 4, 12, 4)


@query(COPIES + "SELECT slot, node, arg_max(hw, at_ms) AS hw FROM (SELECT slot, node, seq AS hw, seq % 50 * 1000 + seq AS at_ms, CASE WHEN seq % 3 = 0 THEN 2 ELSE 1 END AS epoch FROM copies) WHERE epoch = 1 GROUP BY ALL")
def hw_ledger(spark, d):
    samples = copies(spark, d).select("slot", "node", F.col("seq").alias("hw"), (F.col("seq") % 50 * 1000 + F.col("seq")).alias("at_ms"), F.when(F.col("seq") % 3 == 0, 2).otherwise(1).alias("epoch"))
    return replication.hw_ledger(samples, placements(spark, d))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 5 THEN 'behind' WHEN o_orderkey % 3 = 0 THEN 'equivalent' ELSE 'diverged' END AS status FROM orders")
def copy_status(spark, d):
    k = F.col("o_orderkey")
    pairs = table(spark, d, "orders").select("o_orderkey", (k % 10).alias("last_seq"), F.lit(5).alias("l_last_seq"), (k % 3).alias("aggregates"), F.lit(0).alias("l_aggregates"), F.lit(1).alias("versions"), F.lit(1).alias("l_versions"), F.lit(1).alias("resolvable"), F.lit(1).alias("l_resolvable"))
    return replication.copy_status(pairs).select("o_orderkey", "status")


@query("SELECT user_id, count(*) FILTER (WHERE event_id * 100 BETWEEN 60000 AND 299999) / 240.0::DOUBLE AS rate, count(*) FILTER (WHERE event_id * 100 BETWEEN 60000 AND 299999 AND event_type <> 'error') / 240.0::DOUBLE AS ok_rate FROM events GROUP BY user_id")
def bench_throughput(spark, d):
    answers = table(spark, d, "events").select("user_id", (F.col("event_id") * 100).alias("at_ms"), (F.col("event_type") != "error").alias("ok"))
    return metrics.throughput(answers, ["user_id"], 60_000, 300_000)


@query("SELECT event_type, sum(event_id % 5000) / count(*) / 1000.0 AS mean_ms FROM events GROUP BY event_type")
def latency_mean(spark, d):
    return metrics.mean_ms(table(spark, d, "events").withColumn("us", F.col("event_id") % 5000), "us", ["event_type"])


@query("WITH s AS (SELECT o_orderkey, ['a', 'b', 'n' || (o_orderkey % 3)] AS x, ['b', 'n' || (o_orderkey % 4)] AS y FROM orders) SELECT o_orderkey, array_to_string(list_concat(x, list_filter(y, lambda v: NOT list_contains(x, v))), ',') AS joined, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ',') AS dropped, list_sort(x) = list_sort(y) AS same, array_to_string(list_transform(x, lambda v: CASE WHEN v = 'a' THEN 'z' ELSE v END), ',') AS replaced FROM s")
def replica_sets(spark, d):
    k = F.col("o_orderkey")
    x = F.array(F.lit("a"), F.lit("b"), F.concat(F.lit("n"), k % 3))
    y = F.array(F.lit("b"), F.concat(F.lit("n"), k % 4))
    return table(spark, d, "orders").select(
        "o_orderkey", F.array_join(F.array_union(x, y), ",").alias("joined"), F.array_join(F.array_sort(F.array_except(x, y)), ",").alias("dropped"), scalar.same_members(x, y).alias("same"), F.array_join(scalar.replace_member(x, F.lit("a"), F.lit("z")), ",").alias("replaced")
    )


@query(LOG + "SELECT aggregate_id, tail + 2 AS next, max(version) AS last, count(*) AS n, tail FROM (SELECT l.aggregate_id, l.version, (substr(l.aggregate_id, 6)::BIGINT % 3) AS tail FROM log l) WHERE version > tail AND version <> tail + 1 GROUP BY ALL")
def replay_gaps(spark, d):
    from .operators.regroup import replay_gaps as gaps

    log = log_events(spark, d).select("aggregate_id", "version")
    tails = log.select("aggregate_id").distinct().withColumn("tail", F.substring("aggregate_id", 6, 20).cast("long") % 3)
    holed = log.join(tails, "aggregate_id").where("version <> tail + 1").select("aggregate_id", "version")
    return gaps(holed, tails)


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT user_id, count(*) AS accepted FROM r WHERE k <= 5 GROUP BY user_id")
def bounded_accepts(spark, d):
    """Appends of at most five per user: the fold over requests whose later versions are wrong."""
    e = table(spark, d, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    requests = e.withColumn("k", k).select((F.col("user_id") % 16).cast("int").alias("slot"), F.col("event_id").alias("batch_id"), F.lit(0).alias("pos"), F.concat(F.lit("user-"), F.col("user_id")).alias("aggregate_id"), F.when(F.col("k") <= 5, F.col("k")).otherwise(F.col("k") + 1).cast("long").alias("version"), F.concat(F.lit("evt-"), F.col("event_id")).alias("command_id"), F.lit(None).cast("string").alias("reason"))
    done = append.append_fold(requests).where("status = 'success'")
    return done.groupBy(F.substring("aggregate_id", 6, 20).cast("long").alias("user_id")).agg(F.count("*").alias("accepted"))


