"""The registered queries of the event-log operators, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import routing, scalar
from .operators import append, directory, metrics, reads, regroup, replication
from .plans import layout
from .sources import codec
from .sources.logviews import frames_lineitem, log_conversations, log_events, table

SIZE, GEN = 8, 3
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# Pieces of SQL. The hash in DuckDB: unsigned 128-bit arithmetic modulo 2 ** 64 over the ids' (ASCII) characters.

_M = "18446744073709551616::UHUGEINT"


def sql_hash(ids: str, name: str = "routed") -> str:
    """CTEs ending in ``name`` (id, h) from a statement giving ``id``."""
    return f"""h0 AS (SELECT id, list_reduce(list_prepend({routing.FNV_OFFSET}::UHUGEINT, list_transform(string_split(id, ''), lambda c: ascii(c)::UHUGEINT)), lambda a, b: (xor(a, b) * {routing.FNV_PRIME}::UHUGEINT) % {_M}) AS h FROM ({ids})),
h1 AS (SELECT id, (xor(h, h >> 30) * {routing.MIX_A}::UHUGEINT) % {_M} AS h FROM h0),
h2 AS (SELECT id, (xor(h, h >> 27) * {routing.MIX_B}::UHUGEINT) % {_M} AS h FROM h1),
{name} AS (SELECT id, xor(h, h >> 31) AS h FROM h2)"""


def sql_slot(size: int, base: int | None = None) -> str:
    return f"({size if base is None else base} + (h % {size})::INT)::INT"


_ROUTED = sql_hash("SELECT DISTINCT 'user-' || user_id AS id FROM events")
LOG = f"""WITH {_ROUTED},
log0 AS (SELECT event_id, 'user-' || user_id AS aggregate_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version,
 floor(epoch(ts))::BIGINT AS unix_time, 'evt-' || event_id AS command_id, event_type, props AS body FROM events),
log AS (SELECT l.*, {sql_slot(SIZE)} AS slot, row_number() OVER (PARTITION BY {sql_slot(SIZE)} ORDER BY event_id) AS seq FROM log0 l JOIN routed ON id = aggregate_id)
"""
FRAMES = """WITH frames AS (SELECT (l_orderkey % 4)::INT AS slot, 'ord-' || l_orderkey AS aggregate_id, l_linenumber::BIGINT AS version, floor(epoch(l_shipdate))::BIGINT AS unix_time,
 row_number() OVER (PARTITION BY l_orderkey % 4 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS seq FROM lineitem),
first AS (SELECT slot, aggregate_id, version, min(seq) AS seq, arg_min(unix_time, seq) AS unix_time FROM frames WHERE version >= 1 GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY slot, aggregate_id ORDER BY version) AS rn FROM first),
dir AS (SELECT slot, aggregate_id, version, seq, unix_time FROM numbered WHERE rn = version)
"""
NODES = "SELECT 'node-' || r_regionkey AS id, r_regionkey AS k FROM region"
#: Copies of the log on five nodes: node k lacks the last 7 k records of each slot, and node 3 one record in the middle.
COPIES = (
    LOG
    + f""", nodes AS ({NODES}), top AS (SELECT slot, max(seq) AS top FROM log GROUP BY slot),
copies AS (SELECT n.id AS node, n.k, l.slot, l.seq, l.aggregate_id, l.version, l.command_id FROM log l JOIN top USING (slot) CROSS JOIN nodes n WHERE l.seq <= top - 7 * n.k AND NOT (n.k = 3 AND l.seq = top // 2)),
place AS (SELECT s.slot::INT AS slot, 'node-' || ((s.slot - {SIZE}) % 5) AS leader, ['node-' || ((s.slot - {SIZE}) % 5), 'node-' || ((s.slot - {SIZE} + 1) % 5), 'node-' || ((s.slot - {SIZE} + 2) % 5)] AS replicas FROM range({SIZE}, {2 * SIZE}) s(slot)),
progress AS (SELECT p.slot, n.id AS node, n.k, p.leader, list_position(p.replicas, n.id) - 1 AS pos, c.leo, lead.leo AS leader_leo, 100000 - 3000 * n.k AS last_ok_ms, n.k = 4 AS building, n.k = 2 AND p.slot % 2 = 0 AS down, 100000 AS now_ms
 FROM place p JOIN nodes n ON list_contains(p.replicas, n.id) JOIN (SELECT slot, node, max(seq) AS leo FROM copies GROUP BY ALL) c ON c.slot = p.slot AND c.node = n.id
 JOIN (SELECT slot, node, max(seq) AS leo FROM copies GROUP BY ALL) lead ON lead.slot = p.slot AND lead.node = p.leader)
"""
)
COUNTERS = (
    LOG
    + """, ticks AS (SELECT slot, unix_time // 3600 - (SELECT min(unix_time // 3600) FROM log) AS tick, count(*) AS n, sum(strlen(body)) AS bytes FROM log GROUP BY ALL),
samples AS (SELECT slot, tick, 'node-' || ((slot + tick // 6) % 5) AS leader, sum(n) OVER (PARTITION BY slot ORDER BY tick) AS writes, sum(bytes) OVER (PARTITION BY slot ORDER BY tick) AS write_bytes FROM ticks)
"""
)


# Derived inputs in Spark.


def nodes(spark, d):
    return table(spark, d, "region").select(F.concat(F.lit("node-"), F.col("r_regionkey")).alias("id"), F.col("r_regionkey").alias("k"))


def copies(spark, d):
    log = log_events(spark, d).select("slot", "seq", "aggregate_id", "version", "command_id")
    top = log.groupBy("slot").agg(F.max("seq").alias("top"))
    each = log.join(F.broadcast(top), "slot").crossJoin(F.broadcast(nodes(spark, d).withColumnRenamed("id", "node")))  # five nodes
    return each.where((F.col("seq") <= F.col("top") - 7 * F.col("k")) & ~((F.col("k") == 3) & (F.col("seq") == F.floor(F.col("top") / 2)))).drop("top")


def placements(spark, d):
    return layout.ring_plan(spark, [f"node-{i}" for i in range(5)], SIZE, 2 * SIZE, 3)


def leos(spark, d):
    return copies(spark, d).groupBy("slot", "node").agg(F.max("seq").alias("leo"))


def progress(spark, d):
    place = placements(spark, d)
    all_leos = leos(spark, d)
    held = place.select("slot", "leader", F.posexplode("replicas").alias("pos", "node")).join(nodes(spark, d).withColumnRenamed("id", "node"), "node")
    lead = all_leos.select("slot", F.col("node").alias("leader"), F.col("leo").alias("leader_leo"))
    rows = held.join(all_leos, ["slot", "node"]).join(lead, ["slot", "leader"])
    return rows.select(
        "slot", "node", "k", "leader", "pos", "leo", "leader_leo", (100000 - 3000 * F.col("k")).cast("long").alias("last_ok_ms"), (F.col("k") == 4).alias("building"), ((F.col("k") == 2) & (F.col("slot") % 2 == 0)).alias("down"), F.lit(False).alias("is_target"), F.lit(False).alias("session_gone"), F.lit(100000).cast("long").alias("now_ms")
    )


def counter_samples(spark, d):
    log = log_events(spark, d).withColumn("hour", F.floor(F.col("unix_time") / 3600))
    start = log.agg(F.min("hour").alias("start"))
    ticks = log.crossJoin(F.broadcast(start)).groupBy("slot", (F.col("hour") - F.col("start")).alias("tick")).agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes"))
    w = Window.partitionBy("slot").orderBy("tick")
    return ticks.select("slot", "tick", F.concat(F.lit("node-"), ((F.col("slot") + F.floor(F.col("tick") / 6)) % 5).cast("string")).alias("leader"), F.sum("n").over(w).alias("writes"), F.sum("bytes").over(w).alias("write_bytes"))


def log_directory(spark, d):
    return directory.directory(log_events(spark, d).select("slot", "seq", "aggregate_id", "version", "unix_time"))


# Routing and scalars.

_IDS = "SELECT 'user-' || user_id AS id FROM events UNION SELECT 'ord-' || o_orderkey FROM orders"


def _ids(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("user-"), F.col("user_id")).alias("id")).unionByName(table(spark, d, "orders").select(F.concat(F.lit("ord-"), F.col("o_orderkey")).alias("id"))).distinct()


@query(f"WITH {sql_hash(_IDS)} SELECT id, (h % 1024)::INT AS slot FROM routed")
def route_logical_slot(spark, d):
    return _ids(spark, d).select("id", routing.logical_slot("id", 1024).alias("slot"))


@query(f"WITH {sql_hash('SELECT DISTINCT ' + chr(39) + 'user-' + chr(39) + ' || user_id AS id FROM events')} SELECT id, (h % 4096)::INT AS slot FROM routed")
def route_logical_slot_native(spark, d):
    ids = table(spark, d, "events").select(F.concat(F.lit("user-"), F.col("user_id")).alias("id")).distinct()
    return ids.select("id", routing.logical_slot_native(F.col("id"), 4096).alias("slot"))


@query(f"WITH {sql_hash(_IDS)} SELECT id, (16 + h % 16)::INT AS slot, (h % 16)::INT AS logical FROM routed")
def route_physical_slot(spark, d):
    slot = routing.slot_for_aggregate("id", 16, 16)
    return _ids(spark, d).select("id", slot.alias("slot")).withColumn("logical", routing.logical_of(F.col("slot"), 16, 16))


@query(f"WITH {sql_hash(_IDS)} SELECT (h % 64)::INT AS slot, count(*) AS n FROM routed GROUP BY ALL")
def route_slot_histogram(spark, d):
    return _ids(spark, d).groupBy(routing.logical_slot("id", 64).alias("slot")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS slot, CASE WHEN o_orderkey > 0 THEN length(bin(o_orderkey::BIGINT)) - 1 END::INT AS gen FROM orders")
def segment_of_slot(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("slot"), routing.segment_of(F.col("o_orderkey")).cast("int").alias("gen"))


_POLICIES = ["low", "medium", "high", "", "3", "007", "0", "2000000", "x"]


@query(
    "SELECT p.policy, n_nationkey AS members, least(CASE WHEN policy = 'low' THEN 1 WHEN policy = 'high' THEN 3 WHEN regexp_full_match(policy, '[0-9]+') AND policy::BIGINT BETWEEN 1 AND 1048576 THEN policy::BIGINT ELSE 2 END, greatest(n_nationkey, 1))::BIGINT AS copies FROM nation, (VALUES "
    + ", ".join(f"('{p}')" for p in _POLICIES)
    + ") p(policy)"
)
def replica_factor_for_policy(spark, d):
    policies = spark.createDataFrame([(p,) for p in _POLICIES], "policy string")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("members")).crossJoin(F.broadcast(policies))
    return rows.select("policy", "members", scalar.replica_count(F.col("policy"), F.col("members")).alias("copies"))


@query("SELECT o_orderkey, n, CASE WHEN n >= 1073741824 AND n % 1073741824 = 0 THEN (n // 1073741824) || 'GiB' WHEN n >= 1048576 AND n % 1048576 = 0 THEN (n // 1048576) || 'MiB' ELSE n::VARCHAR END AS human FROM (SELECT o_orderkey, (o_orderkey * 131072)::BIGINT AS n FROM orders)")
def human_bytes(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 131072).alias("n"))
    return rows.withColumn("human", scalar.human_bytes(F.col("n")))


@query("SELECT event_id, strftime(to_timestamp(floor(epoch(ts))::BIGINT) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS stamp, least(60, 2 * (2 ** (least(greatest(event_id % 12, 1) - 1, 30)))::BIGINT)::BIGINT AS delay FROM events")
def stamps_and_delays(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", scalar.utc_stamp(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("stamp"), scalar.retry_delay_s(F.col("event_id") % 12).alias("delay"))


@query("SELECT page_id, CASE WHEN url = '' OR contains(url, '://') THEN url ELSE 'http://' || url END AS address, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE url END AS host_port FROM pages")
def normal_addresses(spark, d):
    return table(spark, d, "pages").select("page_id", scalar.normal_address(F.col("url")).alias("address"), scalar.host_port(F.col("url")).alias("host_port"))


@query("SELECT name, CASE WHEN ok THEN gen END AS gen, CASE WHEN ok THEN (1 << gen)::INT END AS size FROM (SELECT 'G' || n_nationkey || ' ' AS name, n_nationkey AS gen, n_nationkey <= 10 AS ok FROM nation)")
def parse_slot_group(spark, d):
    names = table(spark, d, "nation").select(F.concat(F.lit("G"), F.col("n_nationkey"), F.lit(" ")).alias("name"))
    return names.withColumn("g", scalar.slot_group(F.col("name"))).select("name", "g.gen", "g.size")


# The log.


@query(LOG + "SELECT slot, seq, aggregate_id, version, unix_time, command_id, event_type FROM log")
def event_log(spark, d):
    return log_events(spark, d).select("slot", "seq", "aggregate_id", "version", "unix_time", "command_id", "event_type")


@query(LOG + "SELECT slot, seq, (23 + strlen(aggregate_id) + strlen(command_id) + 6 + strlen(event_type) + strlen(body))::BIGINT AS bytes FROM log")
def record_encoded_size(spark, d):
    events = F.array(F.struct(F.col("event_type").alias("type"), F.encode("body", "UTF-8").alias("body")))
    return log_events(spark, d).select("slot", "seq", scalar.encoded_size(F.col("aggregate_id"), F.col("command_id"), events).alias("bytes"))


@query(LOG + f", c AS (SELECT DISTINCT command_id AS id FROM log), f AS (SELECT id, list_reduce(list_prepend({routing.FNV_OFFSET}::UHUGEINT, list_transform(string_split(id, ''), lambda c: ascii(c)::UHUGEINT)), lambda a, b: (xor(a, b) * {routing.FNV_PRIME}::UHUGEINT) % {_M}) AS h FROM c) SELECT aggregate_id, version, unix_time, (CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END)::BIGINT AS command_hash FROM log JOIN f ON id = command_id")
def record_meta_projection(spark, d):
    return log_events(spark, d).select("aggregate_id", "version", "unix_time", routing.fnv1a64_native(F.col("command_id")).alias("command_hash"))


@query(LOG + "SELECT slot, seq, aggregate_id, version FROM log WHERE slot = 9 AND seq >= 100")
def scan_from_seq(spark, d):
    return log_events(spark, d).where("slot = 9 and seq >= 100").select("slot", "seq", "aggregate_id", "version")


@query(LOG + "SELECT slot, seq, command_id FROM log WHERE slot = 10 AND seq = 5")
def read_by_seq(spark, d):
    return log_events(spark, d).where("slot = 10 and seq = 5").select("slot", "seq", "command_id")


_BYTES = "23 + strlen(aggregate_id) + strlen(command_id) + 6 + strlen(event_type) + strlen(body)"


@query(LOG + f", s AS (SELECT slot, seq, {_BYTES} AS n, sum({_BYTES}) OVER (PARTITION BY slot ORDER BY seq) AS total, row_number() OVER (PARTITION BY slot ORDER BY seq) AS k FROM log WHERE seq >= 20) SELECT slot, seq, n::BIGINT AS bytes FROM s WHERE total <= 4096 OR k = 1")
def range_read_byte_cap(spark, d):
    events = F.array(F.struct(F.col("event_type").alias("type"), F.encode("body", "UTF-8").alias("body")))
    rows = log_events(spark, d).where("seq >= 20").select("slot", "seq", scalar.encoded_size(F.col("aggregate_id"), F.col("command_id"), events).alias("bytes"))
    return reads.byte_cap(rows, ["slot"], "bytes", 4096)


# Reads.


@query(LOG + "SELECT aggregate_id, version, seq, unix_time FROM log WHERE aggregate_id = 'user-7'")
def read_stream(spark, d):
    return reads.read_stream(log_directory(spark, d), "user-7").select("aggregate_id", "version", "seq", "unix_time")


@query(LOG + "SELECT aggregate_id, version, seq FROM log WHERE aggregate_id = 'user-7' AND version >= 5 ORDER BY version LIMIT 10")
def read_stream_from_limit(spark, d):
    return reads.read_stream(log_directory(spark, d), "user-7", 5, 10).select("aggregate_id", "version", "seq")


@query(FRAMES + ", w AS (SELECT *, bool_and(seq <= 6000) OVER (PARTITION BY aggregate_id ORDER BY version) AS seen FROM dir) SELECT slot, aggregate_id, version, seq FROM w WHERE seen")
def read_stream_bounded(spark, d):
    found = directory.directory(frames_lineitem(spark, d))
    seen = F.min(reads.visible(6000).cast("int")).over(Window.partitionBy("slot", "aggregate_id").orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return found.withColumn("seen", seen).where("seen = 1").select("slot", "aggregate_id", "version", "seq")


@query(LOG + "SELECT count(*) AS n, count(*) + 5 AS next_version, count(*) + 4 AS last_version FROM log WHERE aggregate_id = 'user-7' AND version >= 5")
def read_stream_span(spark, d):
    return reads.stream_span(reads.read_stream(log_directory(spark, d), "user-7", 5), 5)


_ASKED = ["user-3", "nobody", "user-7", "user-3", "", "user-11"]
_ASKED_SQL = "(VALUES " + ", ".join(f"({i}, '{a}')" for i, a in enumerate(_ASKED)) + ") asked(pos, aggregate_id)"


@query(LOG + f"SELECT pos, a.aggregate_id, coalesce(max(version), 0)::BIGINT AS version FROM (SELECT pos::INT AS pos, aggregate_id FROM {_ASKED_SQL}) a LEFT JOIN log l ON l.aggregate_id = a.aggregate_id GROUP BY ALL")
def read_tails(spark, d):
    return reads.read_tails(log_directory(spark, d), reads.ids_frame(spark, _ASKED))


@query(FRAMES + "SELECT a.o_orderkey AS pos, 'ord-' || a.o_orderkey AS aggregate_id, coalesce(max(version), 0)::BIGINT AS version FROM orders a LEFT JOIN (SELECT * FROM dir WHERE seq <= 6000) l ON l.aggregate_id = 'ord-' || a.o_orderkey GROUP BY ALL")
def read_tails_bounded(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("ord-"), F.col("o_orderkey")).alias("aggregate_id"))
    return reads.read_tails(directory.directory(frames_lineitem(spark, d)), ids, 6000)


@query(FRAMES + "SELECT slot, aggregate_id, max(version) AS version FROM dir GROUP BY ALL")
def current_versions(spark, d):
    return directory.tails(frames_lineitem(spark, d)).where("version > 0")


_WHEN = "(SELECT (min(epoch(ts)) + (max(epoch(ts)) - min(epoch(ts))) / 2)::BIGINT FROM events)"


@query(LOG + "SELECT a.aggregate_id, a.\"at\", coalesce(max(version) FILTER (WHERE unix_time <= \"at\"), 0)::BIGINT AS version FROM (SELECT DISTINCT aggregate_id, (SELECT (min(unix_time) + max(unix_time)) // 2 FROM log) AS \"at\" FROM log) a JOIN log l USING (aggregate_id) GROUP BY ALL")
def read_version_by_time(spark, d):
    found = log_directory(spark, d)
    at = found.agg(F.floor((F.min("unix_time") + F.max("unix_time")) / 2).alias("at"))
    return reads.version_by_time(found, found.select("aggregate_id").distinct().crossJoin(F.broadcast(at)))


@query(FRAMES + ", a AS (SELECT DISTINCT aggregate_id, 852076800::BIGINT AS \"at\" FROM frames) SELECT a.aggregate_id, a.\"at\", coalesce(max(version) FILTER (WHERE unix_time <= \"at\" AND seq <= 9000), 0)::BIGINT AS version FROM a LEFT JOIN dir l USING (aggregate_id) GROUP BY ALL")
def version_by_time_bounded(spark, d):
    frames = frames_lineitem(spark, d)
    asked = frames.select("aggregate_id").distinct().withColumn("at", F.lit(852076800).cast("long"))
    return reads.version_by_time(directory.directory(frames), asked, 9000)


@query(LOG + ", m AS (SELECT (min(unix_time) + max(unix_time)) // 2 AS \"at\" FROM log), a AS (SELECT aggregate_id, \"at\", max(version) FILTER (WHERE unix_time <= \"at\") AS anchor FROM log, m WHERE aggregate_id IN ('user-3', 'user-9') GROUP BY ALL) SELECT aggregate_id, \"at\", version, seq, unix_time FROM log JOIN a USING (aggregate_id) WHERE version <= anchor")
def replay_as_of(spark, d):
    found = log_directory(spark, d)
    at = found.agg(F.floor((F.min("unix_time") + F.max("unix_time")) / 2).alias("at"))
    asked = spark.createDataFrame([("user-3",), ("user-9",)], "aggregate_id string").crossJoin(F.broadcast(at))
    return reads.replay_as_of(found, asked)


@query(LOG + f", a AS (SELECT o.aggregate_id AS asked_id, o.command_id, p.slot FROM (SELECT 'user-' || (event_id % 20) AS aggregate_id, 'evt-' || event_id AS command_id FROM events) o JOIN (SELECT id, {sql_slot(SIZE)} AS slot FROM routed2) p ON p.id = o.aggregate_id) SELECT a.asked_id, a.command_id, a.slot, l.seq IS NOT NULL AS found, l.aggregate_id, l.version, l.seq FROM a LEFT JOIN log l USING (slot, command_id)".replace("routed2", "(" + "SELECT id, h FROM routed2x" + ")"))
def read_by_command(spark, d):
    asked = table(spark, d, "events").select(F.concat(F.lit("user-"), F.col("event_id") % 20).alias("aggregate_id"), F.concat(F.lit("evt-"), F.col("event_id")).alias("command_id"))
    log = log_events(spark, d)
    return reads.read_by_command(log, asked, SIZE, SIZE)


def _with_routes(sql: str, ids: str) -> str:
    """LOG with a second routed table."""
    more = sql_hash(ids, "routed2").replace("h0", "g0").replace("h1", "g1").replace("h2", "g2")
    return sql.replace("(SELECT id, h FROM routed2x)", "routed2").replace("WITH ", f"WITH {more},\n", 1)


ORACLE["read_by_command"] = _with_routes(ORACLE["read_by_command"], "SELECT DISTINCT 'user-' || (event_id % 20) AS id FROM events")


@query(f"SELECT s.slot - {SIZE} AS logical_slot, CASE WHEN (s.slot - {SIZE}) % 5 = 4 THEN 'http://self' ELSE 'http://node-' || ((s.slot - {SIZE}) % 5) END AS address, ((s.slot - {SIZE}) % 5)::INT AS node_index FROM (SELECT slot::INT AS slot FROM range({SIZE}, {2 * SIZE}) s(slot)) s")
def prefetch_routes(spark, d):
    peers = nodes(spark, d).where("k < 4").select("id", F.concat(F.lit("http://"), F.col("id")).alias("client_addr"))
    return reads.prefetch_routes(placements(spark, d), peers, SIZE, "http://self")


@query(
    COPIES
    + ", s AS (SELECT slot, k, CASE WHEN slot % 3 = 0 THEN 0 ELSE leo END AS hw, slot % 4 <> 1 AS proven, slot = 11 AS fenced, CASE WHEN slot = 14 THEN 0 ELSE 1 END AS epoch FROM progress WHERE node = 'node-1'), "
    "m AS (SELECT p.slot, CASE WHEN p.leader = 'node-1' AND coalesce(fenced, false) THEN 'empty' WHEN p.leader = 'node-1' THEN 'unbounded' WHEN NOT list_contains(p.replicas, 'node-1') OR NOT (coalesce(proven, false) AND coalesce(s.epoch = 1, false)) THEN 'redirect' WHEN hw = 0 THEN 'empty' ELSE 'bounded' END AS mode, hw FROM place p LEFT JOIN s USING (slot)) "
    "SELECT slot, mode, CASE WHEN mode = 'bounded' THEN hw ELSE 0 END::BIGINT AS bound FROM m"
)
def read_admission(spark, d):
    mine = progress(spark, d).where("node = 'node-1'")
    samples = mine.select("slot", "node", F.when(F.col("slot") % 3 == 0, 0).otherwise(F.col("leo")).alias("hw"), (F.col("slot") % 4 != 1).alias("proven"), (F.col("slot") == 11).alias("fenced"), F.when(F.col("slot") == 14, 0).otherwise(1).alias("epoch"))
    return reads.read_admission(placements(spark, d), samples, "node-1")


_STREAMS = LOG + ", st AS (SELECT aggregate_id, max(version) AS version, arg_max(unix_time, version) AS unix_time FROM log WHERE slot = 9 GROUP BY 1)"


def _streams(spark, d):
    return log_directory(spark, d).where("slot = 9").groupBy("slot", "aggregate_id").agg(F.max("version").alias("version"), F.max_by("unix_time", "version").alias("unix_time"))


def _page_sql(after: str, n: int) -> str:
    return f"{_STREAMS}, r AS (SELECT *, row_number() OVER (ORDER BY aggregate_id) AS k FROM st WHERE aggregate_id > '{after}') SELECT k::INT AS k, aggregate_id, version, unix_time, (SELECT count(*) FROM st) AS total, CASE WHEN (SELECT count(*) FROM r) > {n} THEN (SELECT aggregate_id FROM r WHERE k = {n}) ELSE '' END AS next_after FROM r WHERE k <= {n}"


@query(_page_sql("", 200))
def stream_page_first(spark, d):
    return reads.page_of(_streams(spark, d))


@query(_page_sql("user-2", 5))
def stream_page_after(spark, d):
    return reads.page_of(_streams(spark, d), "user-2", 5)


@query(LOG + f"SELECT s.slot::INT AS slot, count(DISTINCT aggregate_id) AS streams, coalesce(sum({_BYTES}), 0)::BIGINT AS bytes FROM range({SIZE}, {2 * SIZE}) s(slot) LEFT JOIN log l ON l.slot = s.slot GROUP BY ALL")
def slot_stream_count(spark, d):
    events = F.array(F.struct(F.col("event_type").alias("type"), F.encode("body", "UTF-8").alias("body")))
    log = log_events(spark, d).withColumn("bytes", scalar.encoded_size(F.col("aggregate_id"), F.col("command_id"), events))
    per = log.groupBy("slot").agg(F.count_distinct("aggregate_id").alias("streams"), F.sum("bytes").alias("bytes"))
    return spark.range(SIZE, 2 * SIZE).select(F.col("id").cast("int").alias("slot")).join(per, "slot", "left").fillna(0)


# Directory.


@query(FRAMES + "SELECT slot, aggregate_id, version, seq, unix_time FROM dir")
def contiguous_directory(spark, d):
    return directory.directory(frames_lineitem(spark, d))


@query(FRAMES + "SELECT slot, aggregate_id, version, seq FROM numbered WHERE rn <> version")
def withheld_frames(spark, d):
    return directory.withheld(frames_lineitem(spark, d)).select("slot", "aggregate_id", "version", "seq")


@query(FRAMES + ", t AS (SELECT slot, aggregate_id, coalesce(max(version) FILTER (WHERE rn = version), 0) AS v FROM numbered GROUP BY ALL) SELECT slot, count(*) AS aggregates, sum(v)::BIGINT AS versions, sum(v)::BIGINT AS resolvable FROM t GROUP BY slot")
def slot_digest(spark, d):
    return directory.slot_digest(frames_lineitem(spark, d))


@query(FRAMES + ", held AS (SELECT slot, aggregate_id, max(seq) AS held_seq, count(*) AS withheld FROM numbered WHERE rn <> version GROUP BY ALL), last AS (SELECT slot, aggregate_id, max(seq) AS last_seq FROM frames GROUP BY ALL) SELECT h.* FROM held h WHERE EXISTS (SELECT 1 FROM last l WHERE l.slot = h.slot AND l.aggregate_id <> h.aggregate_id AND l.last_seq > h.held_seq)")
def stalled_aggregates(spark, d):
    return directory.stalled(frames_lineitem(spark, d))


@query(LOG + "SELECT slot, min(seq) AS min_seq, max(seq) AS max_seq, count(DISTINCT seq) AS n_seq, min(seq) = 1 AND max(seq) = count(DISTINCT seq) AS dense FROM log GROUP BY slot")
def seq_density_check(spark, d):
    return directory.density(log_events(spark, d))


@query(LOG + "SELECT slot, count(*) AS commands, sum((n > 1)::INT)::BIGINT AS repeated FROM (SELECT slot, command_id, count(*) AS n FROM log GROUP BY ALL) GROUP BY slot")
def command_uniqueness_check(spark, d):
    return directory.command_uniqueness(log_events(spark, d))


@query("SELECT 'conv-' || conv_id AS aggregate_id, count(*) AS versions, max(turn) + 1 = count(*) AS contiguous FROM conversations GROUP BY conv_id")
def conversation_streams(spark, d):
    return directory.directory(log_conversations(spark, d).select("slot", "seq", "aggregate_id", "version", F.lit(0).alias("unix_time"))).groupBy("aggregate_id").agg(F.count("*").alias("versions"), (F.max("version") == F.count("*")).alias("contiguous"))


@query(FRAMES + ", t AS (SELECT slot, aggregate_id, coalesce(max(version) FILTER (WHERE rn = version), 0)::BIGINT AS resolvable, max(version) AS version FROM numbered GROUP BY ALL) SELECT slot, aggregate_id, version, resolvable FROM t WHERE version <> resolvable")
def desync_gate(spark, d):
    frames = frames_lineitem(spark, d)
    claimed = frames.groupBy("slot", "aggregate_id").agg(F.max("version").alias("version"))
    return directory.claims(frames, claimed).select("slot", "aggregate_id", "version", "resolvable")


# Appends.


def _requests(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id")
    return e.select(
        F.floor(n / 10).alias("batch_id"),
        (n % 10).cast("int").alias("pos"),
        F.when(n % 31 == 0, "").otherwise(F.concat(F.lit("user-"), F.col("user_id"))).alias("aggregate_id"),
        F.when(n % 29 == 0, 0).otherwise(F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).cast("long").alias("version"),
        F.when(n % 23 == 0, F.repeat(F.lit("c"), F.lit(300))).otherwise(F.concat(F.lit("evt-"), n)).alias("command_id"),
        F.when(n % 19 == 0, 2).when(n % 17 == 0, 1).otherwise(0).cast("tinyint").alias("codec"),
        F.array(F.struct(F.when(n % 13 == 0, F.repeat(F.lit("t"), F.lit(257))).otherwise(F.col("event_type")).alias("type"), F.encode("props", "UTF-8").alias("body"))).alias("events"),
    )


_REQ = """WITH req AS (SELECT event_id // 10 AS batch_id, (event_id % 10)::INT AS pos, CASE WHEN event_id % 31 = 0 THEN '' ELSE 'user-' || user_id END AS aggregate_id, CASE WHEN event_id % 29 = 0 THEN 0 ELSE row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS version,
 CASE WHEN event_id % 23 = 0 THEN repeat('c', 300) ELSE 'evt-' || event_id END AS command_id, CASE WHEN event_id % 19 = 0 THEN 2 WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS codec, CASE WHEN event_id % 13 = 0 THEN repeat('t', 257) ELSE event_type END AS type FROM events)
"""


@query(
    _REQ
    + "SELECT batch_id, pos, CASE WHEN aggregate_id = '' THEN 'empty_field' WHEN codec = 2 THEN 'unknown_codec' WHEN strlen(command_id) > 256 THEN 'command_too_long' WHEN version = 0 THEN 'version_zero' WHEN strlen(type) > 256 THEN 'event_type_too_long' WHEN codec = 1 THEN 'not_gzip' END AS reason FROM req"
)
def validate_requests(spark, d):
    return _requests(spark, d).select("batch_id", "pos", append.invalid_reason().alias("reason"))


@query(_REQ + "SELECT batch_id, pos, aggregate_id, count(*) OVER (PARTITION BY batch_id, aggregate_id) > 1 AS repeated FROM req")
def batch_duplicate_aggregate(spark, d):
    return _requests(spark, d).select("batch_id", "pos", "aggregate_id", append.duplicate_in_batch().alias("repeated"))


@query(FRAMES + "SELECT slot, aggregate_id, list_reduce(list_prepend(0::BIGINT, list(version ORDER BY seq, version)), lambda a, v: CASE WHEN v = a + 1 THEN v ELSE a END) AS version FROM frames GROUP BY ALL")
def append_fold_versions(spark, d):
    return append.fold_unique(frames_lineitem(spark, d))


#: A fold of requests (slot, batch_id, pos, aggregate_id, version, command_id, reason) whose commands are only repeated by their own aggregate.
_APPENDS = """, line AS (SELECT *, row_number() OVER (PARTITION BY slot, aggregate_id ORDER BY batch_id, pos) AS k FROM asked),
run AS (SELECT slot, aggregate_id, 0::BIGINT AS k, 0::BIGINT AS version, []::VARCHAR[] AS known, '' AS status FROM (SELECT DISTINCT slot, aggregate_id FROM asked) UNION ALL
 SELECT l.slot, l.aggregate_id, l.k, CASE WHEN s = 'success' THEN l.version ELSE was END, CASE WHEN s = 'success' THEN list_append(had, l.command_id) ELSE had END, s FROM (SELECT l.*, r.version AS was, r.known AS had,
 CASE WHEN l.reason IS NOT NULL THEN 'invalid' WHEN list_contains(r.known, l.command_id) THEN 'exists' WHEN l.version = r.version + 1 THEN 'success' ELSE 'conflict' END AS s FROM run r JOIN line l ON l.slot = r.slot AND l.aggregate_id = r.aggregate_id AND l.k = r.k + 1) l),
judged AS (SELECT l.*, r.status AS verdict, r.version AS current FROM line l JOIN run r USING (slot, aggregate_id, k)), landed AS (SELECT slot, command_id, version, row_number() OVER (PARTITION BY slot ORDER BY batch_id, pos) AS seq FROM judged WHERE verdict = 'success'),
results AS (SELECT j.batch_id, j.pos, j.slot, j.aggregate_id, CASE verdict WHEN 'success' THEN verdict WHEN 'exists' THEN verdict ELSE 'fail' END AS status, CASE verdict WHEN 'invalid' THEN 1002 WHEN 'conflict' THEN 1001 ELSE 0 END AS err_id, CASE verdict WHEN 'invalid' THEN 0 WHEN 'exists' THEN w.version ELSE current END AS current_version, coalesce(w.seq, 0) AS seq
 FROM judged j LEFT JOIN landed w ON w.slot = j.slot AND w.command_id = j.command_id AND j.verdict IN ('success', 'exists'))
"""
_RETRIED = (
    LOG.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, good AS (SELECT slot, event_id, aggregate_id, command_id, event_id % 11 = 0 AS off, event_id % 13 = 0 AS bad, sum((event_id % 11 <> 0 AND event_id % 13 <> 0)::INT) OVER (PARTITION BY aggregate_id ORDER BY event_id) AS n FROM log),
asked AS (SELECT slot, 2 * event_id + again AS batch_id, 0 AS pos, aggregate_id, CASE WHEN off THEN n + 2 ELSE n END::BIGINT AS version, command_id, CASE WHEN bad THEN 'version_zero' END AS reason FROM good, (VALUES (0), (1)) a(again) WHERE again = 0 OR event_id % 5 = 0)"""
    + _APPENDS
)


@query(_RETRIED + "SELECT * FROM results")
def append_fold_full(spark, d):
    """Appends of which some skip a version, some are invalid, and every fifth is sent twice."""
    n = F.col("event_id")
    log = log_events(spark, d).select("slot", "event_id", "aggregate_id", "command_id")
    good = F.sum(((n % 11 != 0) & (n % 13 != 0)).cast("long")).over(Window.partitionBy("aggregate_id").orderBy("event_id"))
    rows = log.withColumn("n", good).withColumn("again", F.explode(F.when(n % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    requests = rows.select("slot", (2 * n + F.col("again")).alias("batch_id"), F.lit(0).alias("pos"), "aggregate_id", F.when(n % 11 == 0, F.col("n") + 2).otherwise(F.col("n")).alias("version"), "command_id", F.when(n % 13 == 0, "version_zero").alias("reason"))
    return append.append_fold(requests)


_BATCHED = (
    _REQ.replace("WITH ", "WITH RECURSIVE ", 1)
    + f", {_ROUTED}, asked AS (SELECT CASE WHEN aggregate_id = '' THEN 11 ELSE {SIZE} + (h % {SIZE})::INT END AS slot, batch_id, pos, aggregate_id, version, command_id, CASE WHEN count(*) OVER (PARTITION BY batch_id, aggregate_id) > 1 OR aggregate_id = '' OR codec > 0 OR strlen(command_id) > 256 OR version = 0 OR strlen(type) > 256 THEN 'invalid' END AS reason FROM req LEFT JOIN routed ON id = aggregate_id)"
    + _APPENDS
)


@query(_BATCHED + "SELECT * FROM results")
def batch_append_results(spark, d):
    return append.batch_append(_requests(spark, d), SIZE)


@query("SELECT event_id // 10 AS batch_id, (event_id % 10)::INT AS pos, -1 AS slot, CASE WHEN event_id % 31 = 0 THEN '' ELSE 'user-' || user_id END AS aggregate_id, 'fail' AS status, 1010 AS err_id, 0::BIGINT AS current_version, 0::BIGINT AS seq FROM events")
def batch_append_stale_epoch(spark, d):
    return append.batch_append(_requests(spark, d), SIZE, epoch=3, request_epoch=2)


@query(_RETRIED + "SELECT count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'exists') AS exists_, count(*) FILTER (WHERE status = 'fail') AS fail, 0::BIGINT AS redirected, 0::BIGINT AS fail_1007, count(*) FILTER (WHERE err_id = 1001) AS fail_1001, 0::BIGINT AS fail_1008, 0::BIGINT AS fail_1009, count(*) FILTER (WHERE err_id = 1002) AS fail_other FROM results")
def append_outcomes(spark, d):
    return metrics.outcomes(append_fold_full(spark, d))


@query(_RETRIED + "SELECT batch_id, slot, command_id FROM asked WHERE batch_id % 2 = 1 AND (slot, command_id) IN (SELECT slot, command_id FROM log)")
def known_commands(spark, d):
    """Requests sent again, of which the log already has the command."""
    log = log_events(spark, d).select("slot", "event_id", "command_id")
    again = log.where("event_id % 5 = 0").select((2 * F.col("event_id") + 1).alias("batch_id"), "slot", "command_id")
    fresh = log.select((2 * F.col("event_id") + 1).alias("batch_id"), "slot", F.concat(F.lit("new-"), F.col("event_id")).alias("command_id"))
    return append.known_commands(again.unionByName(fresh), log).select("batch_id", "slot", "command_id")


#: Slot groups of ten requests, seven seconds apart; three tokens a node for ten seconds.
_FLOW = """WITH RECURSIVE asked AS (SELECT 'node-' || (event_id // 10 % 5) AS node, (event_id % 4)::INT AS slot, event_id // 50 * 7 AS "at", event_id // 10 AS group_id, (event_id % 10)::INT AS pos, event_id % 7 < 3 AS refundable FROM events),
line AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY "at", group_id, pos) AS k FROM asked),
run AS (SELECT node, 0::BIGINT AS k, []::BIGINT[] AS due, 0::BIGINT AS refunded, -1::BIGINT AS closed, false AS admitted FROM (SELECT DISTINCT node FROM asked) UNION ALL
 SELECT node, k, CASE WHEN ok THEN list_append(due, "at" + 10) ELSE due END, CASE WHEN ok AND refundable THEN refunded + 1 ELSE refunded END, CASE WHEN ok THEN closed ELSE group_id END, ok FROM (SELECT *, closed <> group_id AND greatest(len(due) - refunded, 0) < 3 AS ok FROM (
  SELECT l.node, l.k, l."at", l.group_id, l.refundable, r.closed, CASE WHEN r.closed = l.group_id THEN r.due ELSE list_filter(r.due, lambda x: x > l."at") END AS due, CASE WHEN r.closed = l.group_id THEN r.refunded ELSE greatest(r.refunded - len(list_filter(r.due, lambda x: x <= l."at")), 0) END AS refunded
  FROM run r JOIN line l ON l.node = r.node AND l.k = r.k + 1))),
flow AS (SELECT node, slot, "at", group_id, pos, admitted, CASE WHEN admitted THEN 0 ELSE 1005 END AS err_id FROM line JOIN run USING (node, k))
"""


@query(_FLOW + "SELECT * FROM flow")
def flow_control(spark, d):
    n = F.col("event_id")
    asked = table(spark, d, "events").select(F.concat(F.lit("node-"), F.floor(n / 10) % 5).alias("node"), (n % 4).cast("int").alias("slot"), (F.floor(n / 50) * 7).alias("at"), F.floor(n / 10).alias("group_id"), (n % 10).cast("int").alias("pos"), (n % 7 < 3).alias("refundable"))
    return append.flow_control(asked, 3, 10)


@query(_FLOW + "SELECT node, slot, count(*) AS hits, sum(count(*)) OVER (PARTITION BY node)::BIGINT AS node_hits FROM flow WHERE NOT admitted GROUP BY node, slot")
def flow_hits(spark, d):
    return append.flow_hits(flow_control(spark, d))


# Replication.


@query(COPIES + "SELECT slot, node FROM progress WHERE node <> leader AND now_ms - last_ok_ms < 10000 AND NOT down AND (NOT building OR leo >= leader_leo)")
def isr_members(spark, d):
    return replication.isr_members(progress(spark, d))


@query(COPIES + "SELECT slot, least(max(leader_leo), coalesce(min(leo) FILTER (WHERE node <> leader AND now_ms - last_ok_ms < 10000 AND NOT down AND (NOT building OR leo >= leader_leo)), max(leader_leo))) AS hw FROM progress GROUP BY slot")
def high_watermark(spark, d):
    return replication.high_watermark(progress(spark, d))


@query(COPIES + ", m AS (SELECT slot, least(max(leader_leo), coalesce(min(leo) FILTER (WHERE node <> leader AND now_ms - last_ok_ms < 10000 AND NOT down AND (NOT building OR leo >= leader_leo)), max(leader_leo))) AS hw, max(leader_leo) - 3 AS durable FROM progress GROUP BY slot) SELECT slot, seq, CASE WHEN seq <= least(hw, durable) THEN 'success' ELSE 'fail' END AS status, CASE WHEN seq <= least(hw, durable) THEN 0 ELSE 1007 END AS err_id FROM log JOIN m USING (slot)")
def ack_verdict(spark, d):
    p = progress(spark, d)
    marks = replication.high_watermark(p).join(p.groupBy("slot").agg((F.max("leader_leo") - 3).alias("durable")), "slot")
    return replication.ack_verdict(log_events(spark, d), marks)


@query(COPIES + "SELECT slot, arg_max(node, leo * 100 - pos) AS node, max(leo) AS leo FROM progress GROUP BY slot")
def freshest_replica(spark, d):
    return replication.freshest_replica(progress(spark, d))


@query(COPIES + ", a AS (SELECT * FROM copies WHERE k = 0), b AS (SELECT * FROM copies WHERE k = 3) SELECT a.slot, a.seq, a.command_id AS leader_command, a.version AS leader_version, b.command_id AS copy_command, b.version AS copy_version FROM a LEFT JOIN b USING (slot, seq) WHERE b.seq IS NULL AND a.seq <= (SELECT max(c.seq) FROM b c WHERE c.slot = a.slot)")
def copy_divergence(spark, d):
    c = copies(spark, d)
    return replication.copy_divergence(c.where("k = 0"), c.where("k = 3"))


_VIEWS = (
    COPIES
    + """, f AS (SELECT slot, node, aggregate_id, version, min(seq) AS seq FROM copies GROUP BY ALL), fn AS (SELECT *, row_number() OVER (PARTITION BY slot, node, aggregate_id ORDER BY version) AS rn FROM f),
t AS (SELECT slot, node, aggregate_id, coalesce(max(version) FILTER (WHERE rn = version), 0) AS v FROM fn GROUP BY ALL),
views AS (SELECT slot, node, slot % 3 <> 2 OR node <> 'node-2' AS loaded, count(*) AS aggregates, sum(v) AS versions, sum(v) AS resolvable, any_value(c.leo) AS last_seq FROM t JOIN (SELECT slot, node, max(seq) AS leo FROM copies GROUP BY ALL) c USING (slot, node) WHERE NOT (node = 'node-4' AND slot % 2 = 1) GROUP BY ALL),
found AS (SELECT h.slot, h.node, CASE WHEN v.loaded IS NULL THEN 'unreachable' WHEN NOT v.loaded THEN 'not-loaded' WHEN v.aggregates = l.aggregates AND v.versions = l.versions THEN NULL WHEN v.last_seq >= l.last_seq THEN 'diverged' ELSE 'behind' END AS kind
 FROM (SELECT slot, leader, unnest(replicas) AS node FROM place) h JOIN views l ON l.slot = h.slot AND l.node = h.leader AND l.loaded LEFT JOIN views v ON v.slot = h.slot AND v.node = h.node WHERE h.node <> h.leader)
"""
)


def _views(spark, d):
    t = directory.tails(copies(spark, d).withColumn("unix_time", F.lit(0)), ["slot", "node", "aggregate_id"])
    digest = t.groupBy("slot", "node").agg(F.count("*").alias("aggregates"), F.sum("version").alias("versions"), F.sum("version").alias("resolvable"))
    rows = digest.join(leos(spark, d).withColumnRenamed("leo", "last_seq"), ["slot", "node"]).where(~((F.col("node") == "node-4") & (F.col("slot") % 2 == 1)))
    return rows.withColumn("loaded", (F.col("slot") % 3 != 2) | (F.col("node") != "node-2"))


@query(_VIEWS + "SELECT slot, node, kind FROM found WHERE kind IS NOT NULL")
def replica_health(spark, d):
    return replication.replica_health(placements(spark, d), _views(spark, d))


@query(_VIEWS + "SELECT k.kind, count(f.kind) AS n FROM (VALUES ('behind'), ('diverged'), ('not-loaded'), ('unreachable')) k(kind) LEFT JOIN found f USING (kind) GROUP BY ALL")
def health_summary(spark, d):
    return replication.health_summary(replication.replica_health(placements(spark, d), _views(spark, d)))


_SIZES = COPIES + ", sizes AS (SELECT slot, node, max(seq) AS last_seq, sum(strlen(command_id))::BIGINT AS bytes FROM copies WHERE NOT (node = 'node-3' AND slot = 11) GROUP BY ALL)"


def _sizes(spark, d):
    return copies(spark, d).where("not (node = 'node-3' and slot = 11)").groupBy("slot", "node").agg(F.max("seq").alias("last_seq"), F.sum(F.octet_length("command_id")).alias("bytes"))


@query(_SIZES + "SELECT coalesce(sum(bytes), 0)::BIGINT AS bytes, coalesce(sum(last_seq), 0)::BIGINT AS records, bool_and(bytes IS NOT NULL) AS complete FROM place p LEFT JOIN sizes s ON s.slot = p.slot AND s.node = p.leader")
def cluster_storage(spark, d):
    return replication.cluster_storage(placements(spark, d), _sizes(spark, d))


@query(_SIZES + "SELECT node, sum(CASE WHEN node = leader THEN last_seq ELSE 0 END)::BIGINT AS records, sum(CASE WHEN node = leader THEN bytes ELSE 0 END)::BIGINT AS bytes FROM sizes JOIN place USING (slot) GROUP BY node")
def leader_totals(spark, d):
    return replication.leader_totals(placements(spark, d), _sizes(spark, d))


@query(COPIES + ", f AS (SELECT slot, count(*) AS n FROM progress WHERE node <> leader AND now_ms - last_ok_ms < 10000 AND NOT building AND NOT down GROUP BY slot) SELECT leader, count(*) AS led, count(*) FILTER (WHERE coalesce(n, 0) + 1 >= 3) AS synced, 0::BIGINT AS pending_seats FROM place LEFT JOIN f USING (slot) GROUP BY leader")
def synced_slots(spark, d):
    return replication.synced_slots(placements(spark, d), progress(spark, d), 3)


_STUCK = COPIES + ", sl AS (SELECT slot, max(leader_leo) AS leo, min(leo) AS hw, CASE WHEN slot = 9 THEN 0 ELSE 90000 + 500 * slot END AS hw_at_ms, 100000 AS now_ms FROM progress GROUP BY slot)"


def _slots(spark, d):
    rows = progress(spark, d).groupBy("slot").agg(F.max("leader_leo").alias("leo"), F.min("leo").alias("hw"))
    return rows.withColumn("hw_at_ms", F.when(F.col("slot") == 9, 0).otherwise(90000 + 500 * F.col("slot"))).withColumn("now_ms", F.lit(100000))


_AGE = "CASE WHEN hw_at_ms > 0 THEN (now_ms - hw_at_ms) / 1000.0::DOUBLE ELSE 0.0::DOUBLE END"


@query(_STUCK + f"SELECT count(*) FILTER (WHERE leo > hw) AS stuck, coalesce(max(leo - hw) FILTER (WHERE leo > hw), 0) AS max_gap, coalesce(max({_AGE}) FILTER (WHERE leo > hw), 0.0)::DOUBLE AS oldest_s FROM sl")
def repl_rollup(spark, d):
    return replication.repl_rollup(_slots(spark, d))


@query(_STUCK + f"SELECT slot, leo, hw, leo - hw AS gap, ({_AGE})::DOUBLE AS age_s FROM sl WHERE leo > hw ORDER BY age_s DESC, slot LIMIT 3")
def worst_stuck_slots(spark, d):
    return replication.worst_stuck(_slots(spark, d), 3)


@query(COPIES + "SELECT node, count(*) AS slots, count(*) FILTER (WHERE now_ms - last_ok_ms <= 10000) AS in_isr, max((now_ms - last_ok_ms) / 1000.0)::DOUBLE AS oldest_s, max(greatest(leader_leo - leo, 0))::BIGINT AS worst_lag FROM progress WHERE node <> leader GROUP BY node")
def follower_rollup(spark, d):
    return replication.follower_rollup(progress(spark, d))


# Metrics.


@query(COUNTERS + ", r AS (SELECT *, lag(writes) OVER w AS b, lag(tick) OVER w AS t, lag(leader) OVER w AS l FROM samples WINDOW w AS (PARTITION BY slot ORDER BY tick)) SELECT slot, tick, leader, greatest(writes - b, 0)::BIGINT AS rate FROM r WHERE t = tick - 1 AND l = leader")
def write_rate_by_slot(spark, d):
    return metrics.rate(counter_samples(spark, d), ["slot"], "writes", "leader").select("slot", "tick", "leader", "rate")


@query(COUNTERS + ", n AS (SELECT leader AS node, tick, sum(writes) AS writes FROM samples GROUP BY ALL), r AS (SELECT *, lag(writes) OVER w AS b, lag(tick) OVER w AS t FROM n WINDOW w AS (PARTITION BY node ORDER BY tick)) SELECT node, tick, greatest(writes - b, 0)::BIGINT AS rate FROM r WHERE t = tick - 1")
def write_rate_by_node(spark, d):
    per = counter_samples(spark, d).groupBy(F.col("leader").alias("node"), "tick").agg(F.sum("writes").alias("writes"))
    return metrics.rate(per, ["node"], "writes").select("node", "tick", "rate")


@query(COUNTERS + ", r AS (SELECT slot, tick, writes - lag(writes) OVER w AS delta FROM samples WINDOW w AS (PARTITION BY slot ORDER BY tick)) SELECT slot, tick, delta::BIGINT AS delta FROM r WHERE delta >= 0")
def slot_rate_series(spark, d):
    return metrics.series(counter_samples(spark, d), ["slot"], "writes").select("slot", "tick", "delta")


@query(COUNTERS + ", r AS (SELECT slot, tick, writes, row_number() OVER (PARTITION BY slot ORDER BY tick DESC) AS k FROM samples) SELECT slot, tick, writes::BIGINT AS writes FROM r WHERE k <= 5")
def last_points(spark, d):
    return metrics.last_points(counter_samples(spark, d), ["slot"], 5).select("slot", "tick", "writes")


_ACK = "[" + ", ".join(map(str, metrics.ACK_MS)) + "]"
_SYNC = "[" + ", ".join(map(str, metrics.SYNC_MS)) + "]"


def _hist_sql(bounds: str) -> str:
    return f"WITH hist AS (SELECT event_type, len(list_filter({bounds}, lambda b: value > b))::INT AS bucket, count(*) AS n FROM events GROUP BY ALL)"


@query(_hist_sql(_ACK) + " SELECT event_type, bucket, n FROM hist")
def latency_hist(spark, d):
    return metrics.histogram(table(spark, d, "events"), "value", metrics.ACK_MS, ["event_type"])


def _pct_sql(bounds: str, overflow: float, add: str) -> str:
    return f"{_hist_sql(bounds)}, r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS run, greatest(floor(sum(n) OVER (PARTITION BY event_type) * 0.9 + {add}), 1) AS rank FROM hist) SELECT event_type, list_append({bounds}, {overflow})[min(bucket) + 1]::DOUBLE AS value FROM r WHERE run >= rank GROUP BY event_type"


@query(_pct_sql(_ACK, 10000.0, "0.5"))
def latency_pct_hist(spark, d):
    hist = metrics.histogram(table(spark, d, "events"), "value", metrics.ACK_MS, ["event_type"])
    return metrics.histogram_percentile(hist, metrics.ACK_MS, 0.9, True, 10000.0, ["event_type"])


@query(_pct_sql(_SYNC, -1.0, "0"))
def latency_pct_fsync(spark, d):
    hist = metrics.histogram(table(spark, d, "events"), "value", metrics.SYNC_MS, ["event_type"])
    return metrics.histogram_percentile(hist, metrics.SYNC_MS, 0.9, False, -1.0, ["event_type"])


@query("SELECT event_type, list(value ORDER BY value)[floor(0.99 * (count(*) - 1))::BIGINT + 1] AS value FROM events GROUP BY event_type")
def latency_pct_exact(spark, d):
    return metrics.exact_percentile(table(spark, d, "events"), "value", 0.99, ["event_type"])


@query("WITH f AS (SELECT event_id, event_id * 10 AS asked_ms, event_id * 10 + event_id % 7 AS begun_ms, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id * 10 + event_id % 7 + event_id % 13 END AS done_ms, strlen(props) AS bytes, (SELECT max(event_id) * 10 + 100 FROM events) AS now_ms FROM events) SELECT count(*) FILTER (WHERE done_ms IS NULL) AS queue, coalesce(sum(bytes) FILTER (WHERE done_ms IS NULL), 0)::BIGINT AS pending_bytes, coalesce(max(now_ms - asked_ms) FILTER (WHERE done_ms IS NULL), 0) AS oldest_ms, round(avg(begun_ms - asked_ms) FILTER (WHERE done_ms IS NOT NULL), 6) AS wait_ms, round(avg(done_ms - begun_ms) FILTER (WHERE done_ms IS NOT NULL), 6) AS service_ms FROM f")
def flush_stats(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id")
    rows = e.select((n * 10).alias("asked_ms"), (n * 10 + n % 7).alias("begun_ms"), F.when(n % 11 != 0, n * 10 + n % 7 + n % 13).alias("done_ms"), F.octet_length("props").alias("bytes"))
    now = e.agg((F.max("event_id") * 10 + 100).alias("now_ms"))
    got = metrics.flush_stats(rows.crossJoin(F.broadcast(now)))
    return got.withColumn("wait_ms", F.round("wait_ms", 6)).withColumn("service_ms", F.round("service_ms", 6))


# Layout.


@query(f"SELECT slot::INT AS slot, 'node-' || ((slot - {SIZE}) % 5) AS leader, 'node-' || ((slot - {SIZE}) % 5) || ',node-' || ((slot - {SIZE} + 1) % 5) || ',node-' || ((slot - {SIZE} + 2) % 5) AS replicas, 1::BIGINT AS epoch, 'stable' AS state FROM range({SIZE}, {2 * SIZE}) s(slot)")
def ring_plan(spark, d):
    return placements(spark, d).withColumn("replicas", F.array_join("replicas", ","))


@query("SELECT o_orderkey, CASE WHEN o_orderkey >= 64 AND o_orderkey < 128 THEN 'node-' || ((o_orderkey - 64) % 5) ELSE '' END AS leader FROM orders")
def ring_leader(spark, d):
    return table(spark, d, "orders").select("o_orderkey", layout.ring_leader(F.col("o_orderkey"), [f"node-{i}" for i in range(5)], 64, 128).alias("leader"))


_PEERS = "WITH peers AS (SELECT 'node-' || n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'voter' ELSE 'learner' END AS role, CASE WHEN n_nationkey % 6 = 1 THEN '' ELSE 'a' || n_nationkey END AS client_addr, n_nationkey % 5 = 2 AS down, n_nationkey % 7 = 3 AS draining FROM nation)"


def _peers(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.concat(F.lit("node-"), k).alias("id"), F.when(k % 4 == 0, "voter").otherwise("learner").alias("role"), F.when(k % 6 == 1, "").otherwise(F.concat(F.lit("a"), k)).alias("client_addr"), (k % 5 == 2).alias("down"), (k % 7 == 3).alias("draining"))


@query(_PEERS + " SELECT string_agg(id, ',' ORDER BY id) FILTER (WHERE h) AS hosting, string_agg(id, ',' ORDER BY id) FILTER (WHERE h AND NOT draining) AS candidates, string_agg(id, ',' ORDER BY id) FILTER (WHERE h AND NOT down AND NOT draining) AS online FROM (SELECT *, role = 'learner' AND client_addr <> '' AS h FROM peers)")
def hosting_pool(spark, d):
    got = layout.pools(_peers(spark, d))
    return got.select(*[F.array_join(c, ",").alias(c) for c in got.columns])


@query("WITH s AS (SELECT o_orderkey AS k, ['node-' || (o_orderkey % 5), 'node-' || ((o_orderkey + 1) % 5), 'node-' || ((o_orderkey + 2) % 5)] AS r, 'node-' || (o_orderkey % 5) AS down, CASE WHEN o_orderkey % 3 = 0 THEN 'node-' || (o_orderkey % 7) ELSE '' END AS pref, ['node-' || (o_orderkey % 4), 'node-2'] AS off, ['node-3'] AS dr FROM orders), t AS (SELECT *, list_filter(r, lambda x: x <> down) AS others FROM s), u AS (SELECT *, list_filter(others, lambda x: NOT list_contains(off, x)) AS live FROM t), v AS (SELECT *, list_filter(live, lambda x: NOT list_contains(dr, x)) AS calm FROM u) SELECT k AS o_orderkey, coalesce(CASE WHEN pref <> '' AND list_contains(calm, pref) THEN pref END, calm[1], live[1], others[1], '') AS leader FROM v")
def failover_leader(spark, d):
    k = F.col("o_orderkey")
    node = lambda x: F.concat(F.lit("node-"), x)
    leader = layout.failover_leader(F.array(node(k % 5), node((k + 1) % 5), node((k + 2) % 5)), node(k % 5), F.when(k % 3 == 0, node(k % 7)).otherwise(F.lit("")), F.array(node(k % 4), F.lit("node-2")), F.array(F.lit("node-3")))
    return table(spark, d, "orders").select("o_orderkey", leader.alias("leader"))


@query(
    "WITH o AS (SELECT o_orderkey AS k, CASE WHEN k % 3 = 0 THEN 'a' ELSE 'b' END AS leader, k % 5 <> 4 AS seated, k % 7 AS epoch, k % 4 <> 0 AS has_owner, CASE WHEN k % 11 = 0 THEN 'x' ELSE 't' END AS owner_topology, k % 8 AS owner_epoch, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS owner_leader, k % 6 <> 0 AS has_wal, k % 9 = 0 AS stranger FROM orders), "
    "p AS (SELECT *, leader = 'a' AS lead, owner_topology = 't' AS same FROM o) SELECT k AS o_orderkey, CASE WHEN NOT lead AND NOT seated THEN 'none/ok' WHEN NOT has_owner AND stranger AND lead AND has_wal THEN 'pending/foreign_dir' WHEN NOT has_owner AND stranger THEN 'none/ok' WHEN NOT has_owner THEN 'stamp/ok' WHEN same AND owner_epoch = epoch AND owner_leader = leader THEN 'none/ok' WHEN same AND owner_epoch < epoch THEN 'stamp/ok' WHEN NOT lead THEN 'none/ok' WHEN NOT same THEN 'pending/topology_mismatch' WHEN owner_epoch > epoch THEN 'pending/epoch_backward' ELSE 'pending/lineage_unknown' END AS decision FROM p"
)
def owner_decision(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.lit("t").alias("topology"), F.lit("a").alias("self"), F.when(k % 3 == 0, "a").otherwise("b").alias("leader"), F.when(k % 5 != 4, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("replicas"), (k % 7).alias("epoch"), (k % 4 != 0).alias("has_owner"),
        F.when(k % 11 == 0, "x").otherwise("t").alias("owner_topology"), (k % 8).alias("owner_epoch"), F.when(k % 2 == 0, "a").otherwise("b").alias("owner_leader"), (k % 6 != 0).alias("has_wal"), (k % 9 == 0).alias("stranger_dir"),
    )
    return rows.withColumn("o", layout.owner_decision()).select("o_orderkey", F.concat_ws("/", "o.action", "o.reason").alias("decision"))


@query("SELECT o_orderkey AS slot FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 3 <> 0")
def orphan_migrations(spark, d):
    o = table(spark, d, "orders")
    placed = o.select(F.col("o_orderkey").alias("slot"), F.when(F.col("o_orderstatus") == "F", "stable").otherwise("migrating").alias("state"))
    return layout.orphan_migrations(placed, o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("slot")))


@query(_PEERS + ", voters AS (SELECT id FROM peers WHERE role = 'voter' UNION ALL SELECT 'node-99') SELECT v.id, 'voter' AS role, p.client_addr, p.draining FROM voters v LEFT JOIN peers p USING (id) UNION ALL SELECT id, role, client_addr, draining FROM peers WHERE role = 'learner'")
def members_view(spark, d):
    p = _peers(spark, d)
    voters = p.where("role = 'voter'").select("id").unionByName(spark.createDataFrame([("node-99",)], "id string"))
    return layout.members(voters, p)


@query(None)
def seat_plan(spark, d):
    peers = nodes(spark, d).select("id", F.lit("learner").alias("role"), F.col("id").alias("client_addr"), (F.col("k") == 1).alias("down"), (F.col("k") == 2).alias("draining"))
    return layout.seat_plan(placements(spark, d), peers, 3, SIZE)


# Generations and codecs.


def _expand_sql() -> str:
    return LOG + f", moved AS (SELECT l.aggregate_id, l.version, l.command_id, l.slot AS old_slot, l.seq AS old_seq, {sql_slot(32)} AS slot FROM log l JOIN routed ON id = aggregate_id) SELECT slot, row_number() OVER (PARTITION BY slot ORDER BY old_slot, aggregate_id, version) AS seq, aggregate_id, version, command_id, old_slot, old_seq FROM moved"


@query(_expand_sql())
def generation_expand(spark, d):
    log = log_events(spark, d).select("slot", "seq", "aggregate_id", "version", "command_id")
    return regroup.expand(log, 32).select("slot", "seq", "aggregate_id", "version", "command_id", "old_slot", "old_seq")


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def gzip_roundtrip(spark, d):
    rows = table(spark, d, "documents").select("doc_id", codec.gzip_body(F.encode("text", "UTF-8"), 1024).alias("p"))
    return rows.select("doc_id", F.md5(codec.inflate_body("p")).alias("text_md5"))


@query(LOG + "SELECT slot, seq, aggregate_id, version, unix_time, command_id, event_type AS type, md5(body) AS body_md5 FROM log")
def segment_roundtrip(spark, d):
    log = log_events(spark, d).select("slot", "seq", "aggregate_id", "version", "unix_time", "command_id", F.lit(0).cast("tinyint").alias("codec"), F.array(F.struct(F.col("event_type").alias("type"), F.encode("body", "UTF-8").alias("body"))).alias("events"))

    back = codec.read_records(codec.to_segments(log))
    event = F.col("events")[0]
    return back.select("slot", "seq", "aggregate_id", "version", "unix_time", "command_id", event["type"].alias("type"), F.md5(event["body"]).alias("body_md5"))
