"""Fixed cases of routing, directories, appends, codecs, layouts and streams."""

import io
import random
import struct
from pathlib import Path

import pytest

from rillbase.functions import routing, scalar
from rillbase.operators import append, directory, metrics, reads, replication
from rillbase.plans.commands import Refused, fold_commands
from rillbase.plans.layout import Layout, Peer, SeatPlanner, Slot
from rillbase.sources import codec

#: Known slots of ids by size.
ROUTES = {"": {1: 0, 2: 1, 8: 3, 1024: 155, 4096: 2203}, "a": {4: 0, 1024: 248, 4096: 248}, "agg-1": {8: 7, 16: 15, 1024: 607, 2048: 607}, "bench-0": {8: 2, 1024: 522, 2048: 1546, 4096: 3594}, "bench-99": {16: 10, 1024: 826, 4096: 3898}, "seed-7-3": {1024: 70, 4096: 2118}, "grpc-smoke-x": {4: 0, 1024: 176}, "世界": {2: 1, 1024: 817, 4096: 2865}}


@pytest.mark.parametrize("form", ["arrow", "native"])
def test_routes(spark, form):
    from pyspark.sql import functions as F

    ids = spark.createDataFrame([(i,) for i in ROUTES], "id string")
    for size in sorted({s for v in ROUTES.values() for s in v}):
        slot = routing.logical_slot("id", size) if form == "arrow" else routing.logical_slot_native(F.col("id"), size)
        got = {r.id: r.slot for r in ids.select("id", slot.alias("slot")).collect()}
        assert all(got[i] == v[size] for i, v in ROUTES.items() if size in v)
    with pytest.raises(ValueError):
        routing.logical_slot("id", 12)


def frames(spark, rows, slot=1):
    return spark.createDataFrame([(slot, s, a, v, 1000 + s) for s, a, v in rows], "slot int, seq long, aggregate_id string, version long, unix_time long")


def test_a_gap_that_closes(spark):
    f = frames(spark, [(1, "a", 2), (2, "a", 4), (3, "a", 1), (4, "a", 3)])
    d = directory.directory(f)
    assert {r.version: r.seq for r in d.collect()} == {1: 3, 2: 1, 3: 4, 4: 2}
    assert [tuple(r) for r in directory.slot_digest(f).collect()] == [(1, 1, 4, 4)]
    assert reads.read_tails(d, reads.ids_frame(spark, ["a"]), 2).first().version == 4  # the highest visible version
    assert reads.read_stream(d, "a", 1, 0, 2).count() == 0  # but nothing before the first hidden one


def test_a_true_gap(spark):
    f = frames(spark, [(1, "a", 3), (2, "a", 4)])
    assert [tuple(r) for r in directory.slot_digest(f).collect()] == [(1, 1, 0, 0)]
    assert directory.withheld(f).count() == 2


def test_stalled(spark):
    held = [(1, "a", 1), (2, "a", 3)]
    assert directory.stalled(frames(spark, held)).count() == 0
    assert [r.aggregate_id for r in directory.stalled(frames(spark, [*held, (3, "b", 1)])).collect()] == ["a"]
    assert directory.stalled(frames(spark, [*held, (3, "b", 1), (4, "a", 5)])).count() == 0


def test_point_in_time(spark):
    rows = [(v, "t", v) for v in range(1, 41)]
    f = frames(spark, rows)
    asked = lambda *ts: spark.createDataFrame([("t", t) for t in ts] + [("none", 1100)], "aggregate_id string, at long")
    got = {(r.aggregate_id, r["at"]): r.version for r in reads.version_by_time(directory.directory(f), asked(1010, 1000, 1100)).collect()}
    assert got == {("t", 1010): 10, ("t", 1000): 0, ("t", 1100): 40, ("none", 1100): 0}
    late = f.unionByName(spark.createDataFrame([(1, 41, "t", 41, 1005)], f.schema))
    d = directory.directory(late)
    assert reads.version_by_time(d, asked(1005)).where("aggregate_id = 't'").first().version == 41
    assert reads.version_by_time(d, asked(1100), 20).where("aggregate_id = 't'").first().version == 20


def test_paging(spark):
    s = spark.createDataFrame([(1, f"s{i}", i, i) for i in range(5)], "slot int, aggregate_id string, version long, unix_time long")
    page = reads.page_of(s, "", 2).collect()
    assert [r.aggregate_id for r in page] == ["s0", "s1"] and {(r.total, r.next_after) for r in page} == {(5, "s1")}
    last = reads.page_of(s, "s1", 10).collect()
    assert [r.aggregate_id for r in last] == ["s2", "s3", "s4"] and {(r.total, r.next_after) for r in last} == {(5, "")}


def test_append_rules():
    s = append.SlotState()
    assert s.append("a", 5, "c0", None) == ("fail", 1001, 0, 0)
    assert s.append("a", 1, "c1", None) == ("success", 0, 1, 1)
    assert s.append("a", 99, "c1", None) == ("exists", 0, 1, 1)
    assert s.append("a", 0, "c1", "version_zero") == ("fail", 1002, 0, 0)
    assert s.append("a", 3, "c2", None) == ("fail", 1001, 1, 0)
    assert s.append("a", 2, "c3", None) == ("success", 0, 2, 2)
    assert s.append("b", 1, "c3", None) == ("exists", 0, 2, 2)  # a command is known to the whole slot


def test_fold_equals_python(spark):
    rng = random.Random(11)
    rows = [(i // 20, i % 20, rng.randrange(4), f"a{rng.randrange(6)}", rng.randint(1, 5), f"c{rng.randrange(150)}", rng.choice([None, None, None, "bad"])) for i in range(400)]
    df = spark.createDataFrame(rows, "batch_id long, pos int, slot int, aggregate_id string, version long, command_id string, reason string")
    want = {r[:2]: w for r, w in zip(rows, append.python_fold((r[2], r[3], r[4], r[5], r[6]) for r in rows), strict=True)}
    assert {(r.batch_id, r.pos): (r.status, r.err_id, r.current_version, r.seq) for r in append.append_fold(df).collect()} == want


def test_bucket():
    b = append.TokenBucket(2, 10)
    assert [b.take(t) for t in (0, 1, 2, 9, 10, 11, 12)] == [True, True, False, False, True, True, False]
    b.refund()
    assert b.take(12) and not b.take(12)
    c = append.TokenBucket(2, 10)
    assert c.take(0) and c.take(5)
    c.refund()  # the deadline at 10 then gives nothing back
    assert [c.take(12), c.take(12), c.take(15)] == [True, False, True]
    assert all(append.TokenBucket(2, 0).take(0) for _ in range(5)) and append.TokenBucket(0, 9).take(0)


def test_health_kinds(spark):
    place = spark.createDataFrame([(7, "n1", ["n1", "n2", "n3", "n4", "n5", "n6"]), (8, "n9", ["n9", "n1"])], "slot int, leader string, replicas array<string>")
    views = spark.createDataFrame([(7, "n1", True, 100, 1, 100, 100), (7, "n2", True, 90, 1, 90, 90), (7, "n3", True, 100, 1, 60, 60), (7, "n4", False, 0, 0, 0, 0), (7, "n5", True, 80, 1, 100, 100), (8, "n1", True, 1, 1, 1, 1)], "slot int, node string, loaded boolean, last_seq long, aggregates long, versions long, resolvable long")
    found = replication.replica_health(place, views)
    assert {(r.node, r.kind) for r in found.collect()} == {("n2", "behind"), ("n3", "diverged"), ("n4", "not-loaded"), ("n6", "unreachable")}


def test_percentiles(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "v double")
    assert metrics.exact_percentile(df, "v", 0.5).first().value == 5.0
    hist = metrics.histogram(df, "v", [2.0, 5.0])
    assert metrics.histogram_percentile(hist, [2.0, 5.0], 0.25, True, 5.0).first().value == 5.0
    assert metrics.histogram_percentile(hist, [2.0, 5.0], 0.25, False, -1.0).first().value == 2.0
    assert metrics.histogram_percentile(hist, [2.0, 5.0], 0.99, False, -1.0).first().value == -1.0


def test_scalars(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("64KiB", 1536, "g3", "http://h:1"), ("1 gb", 1 << 30, "11", "h:1"), ("-1", 0, " G10", ""), ("x", -5, "g", "a://b://c")], "s string, n long, g string, a string")
    rows = df.select(scalar.byte_size(F.col("s")).alias("b"), scalar.display_bytes(F.col("n")).alias("d"), scalar.slot_group(F.col("g"))["size"].alias("g"), scalar.normal_address(F.col("a")).alias("a"), scalar.host_port(F.col("a")).alias("h"), scalar.utc_stamp(F.col("n")).alias("u")).collect()
    assert [r.b for r in rows] == [65536, 10**9, None, None]
    assert [r.d for r in rows] == ["1.5 KiB", "1.0 GiB", "0 B", "-"]
    assert [r.g for r in rows] == [8, None, 1024, None]
    assert [r.a for r in rows] == ["http://h:1", "http://h:1", "", "a://b://c"] and [r.h for r in rows] == ["h:1", "h:1", "", "b://c"]
    assert rows[0].u == "1970-01-01 00:25:36" and rows[2].u == "-"


RECORDS = [codec.Record(f"a{i % 3}", i // 3 + 1, 1000 + i, f"c{i}", [("t", b"x" * i), ("", b"")]) for i in range(50)]


@pytest.mark.parametrize("version", [1, 2])
def test_segments(version):
    slot, rows = codec.read_segment(codec.segment(9, 5, RECORDS, version))
    assert slot == 9 and list(rows) == [(5 + i, r) for i, r in enumerate(RECORDS)]


def test_torn_tail_and_refusals():
    whole = codec.segment(1, 1, RECORDS)
    assert len(list(codec.read_segment(whole + b"\x00" * 11)[1])) == 50
    assert len(list(codec.read_segment(whole[:-3])[1])) == 49
    frame = codec.encode(codec.Record("a", 1, 1, "c", [("t", b"")], codec=7))[4:]
    with pytest.raises(codec.Corrupt):
        codec.decode(frame)
    with pytest.raises(codec.Corrupt):
        codec.decode(codec.encode(RECORDS[0])[4:] + b"x")
    with pytest.raises(codec.Corrupt):
        codec.read_segment(b"nope" + whole[4:])
    assert len(codec.encode(codec.Record("a", 1, 1, "c", [("", b"")]))) == 4 + 27
    assert struct.unpack(">I", codec.encode(RECORDS[1])[:4])[0] == len(codec.encode(RECORDS[1])) - 4
    assert codec.valid_segment_bytes(256 << 20) and not codec.valid_segment_bytes(300 << 20)


def test_gzip():
    assert codec.compress_bodies([b"a" * 4000], 1024)[0] == codec.CODEC_GZIP
    assert codec.compress_bodies([b"a" * 100], 1024) == (codec.CODEC_RAW, [b"a" * 100])
    noise = random.Random(1).randbytes(4000)
    assert codec.compress_bodies([noise], 1024) == (codec.CODEC_RAW, [noise])
    packed = codec.compress_bodies([b"a" * 4000], 1)[1][0]
    assert codec.inflate(packed) == b"a" * 4000
    bomb = codec.gzip.compress(b"\x00" * (codec.MAX_BODY + 1))
    for bad in (b"plain", packed[:-1], packed[:-5] + b"\x00" * 5, bomb):
        with pytest.raises(codec.Corrupt):
            codec.inflate(bad)


def test_wal_sources(spark, tmp_path):
    from rillbase.sources import wal

    (tmp_path / "a.wal").write_bytes(codec.segment(4, 1, RECORDS[:30]) + b"torn")
    (tmp_path / "b.wal").write_bytes(codec.segment(5, 31, RECORDS[30:]))
    wal.register(spark)
    got = spark.read.format("wal").load(str(tmp_path))
    again = codec.scan_segments(spark, str(tmp_path))
    key = lambda df: sorted((r.slot, r.seq, r.aggregate_id, r.version, r.command_id, len(r.events)) for r in df.collect())
    assert key(got) == key(again) and len(key(got)) == 50
    assert spark.read.format("wal").option("from_seq", 40).load(str(tmp_path)).count() == 11
    assert spark.read.format("wal").load(f"file://{tmp_path}").count() == 50
    (tmp_path / "none").mkdir()
    assert spark.read.format("wal").load(str(tmp_path / "none")).count() == 0


def test_wal_files_are_grouped_and_read_frame_by_frame(tmp_path, monkeypatch):
    from rillbase.sources import wal

    for i in range(5):
        (tmp_path / f"{i}.wal").write_bytes(codec.segment(i, 1, RECORDS))
    size = (tmp_path / "0.wal").stat().st_size
    monkeypatch.setattr(wal, "TASK_BYTES", 2 * size)
    reader = wal.WalReader(str(tmp_path), 1)
    assert [[Path(f).name for f, _ in p.files] for p in reader.partitions()] == [["0.wal", "1.wal"], ["2.wal", "3.wal"], ["4.wal"]]
    monkeypatch.setattr(wal, "TASK_BYTES", size - 1)
    assert [len(p.files) for p in reader.partitions()] == [1] * 5

    class File(io.BytesIO):
        most = 0

        def read(self, n=-1):
            assert n >= 0
            self.most = max(self.most, n)
            return super().read(n)

    file = File(codec.segment(1, 1, RECORDS))
    assert len(list(codec.read_stream(file, size)[1])) == 50 and file.most <= max(len(codec.encode(r)) for r in RECORDS)
    shorter = File(codec.segment(1, 1, RECORDS)[:-3])
    assert len(list(codec.read_stream(shorter, size)[1])) == 49  # cut after it was listed
    torn = File(codec.segment(1, 1, RECORDS) + b"\xff" * 9)
    assert len(list(codec.read_stream(torn, size + 9)[1])) == 50 and torn.most < 1 << 20  # a length past the end is not read


def test_command_filter(spark):
    from rillbase.operators import admin

    log = spark.createDataFrame([(f"c{i}",) for i in range(500)], "command_id string").repartition(3)
    known = admin.build_filter(log, 1 << 14)
    asked = spark.createDataFrame([(f"c{i}",) for i in range(500)] + [(f"x{i}",) for i in range(2000)], "command_id string")
    maybe = {r.command_id for r in admin.maybe_known(asked, "command_id", known).where("maybe").collect()}
    assert {f"c{i}" for i in range(500)} <= maybe and len(maybe) < 500 + 40


def test_liveness(spark):
    from rillbase.operators import admin

    probes = [("a", t, False, False) for t in (1, 2, 3)] + [("b", 1, False, False), ("b", 2, True, False), ("b", 3, False, False), ("b", 4, False, False)]
    probes += [("c", t, False, True) for t in (0, 1500, 3000)] + [("d", t, False, True) for t in (0, 2999)] + [("e", 0, False, True), ("e", 1, True, False)]
    got = admin.liveness(spark.createDataFrame(probes, "node string, at_ms long, answered boolean, refused boolean")).collect()
    assert {r.node for r in got if r.down} == {"a", "c"}


def seats(n, nodes, factor, draining=(), down=()):
    ring = [f"n{i}" for i in range(nodes)]
    slots = {s: Slot(ring[s % nodes], [ring[(s + i) % nodes] for i in range(factor)]) for s in range(n)}
    return Layout(slots, {x: Peer(draining=x in draining, down=x in down) for x in ring}, factor)


def test_settled_layout_stays():
    assert all(not (p["add"] or p["drop"] or p["lead"]) for p in SeatPlanner(seats(12, 3, 2)).plan().values())


@pytest.mark.parametrize("n,nodes,factor", [(16, 3, 2), (64, 5, 3), (7, 4, 1)])
def test_new_node_takes_its_share_with_few_moves(n, nodes, factor):
    t = seats(n, nodes, factor)
    t.peers["n9"] = Peer()
    plan = SeatPlanner(t).plan()
    load = {x: sum(x in p["target"] for p in plan.values()) for x in t.peers}
    total = n * factor
    if factor > 1:
        assert max(load.values()) - min(load.values()) <= 1
        assert sum(len(p["add"]) for p in plan.values()) <= total // len(t.peers) + 1
    assert all(len(set(p["target"])) == len(p["target"]) >= factor for p in plan.values())


def test_draining_node_loses_seats_and_leadership():
    t = seats(12, 4, 2, draining={"n1"})
    plan = SeatPlanner(t).plan()
    assert all("n1" not in p["target"] and len(p["target"]) == 2 for p in plan.values())
    assert all(plan[s]["lead"] for s, p in t.slots.items() if p.leader == "n1")


@pytest.mark.parametrize("n,nodes,factor", [(12, 4, 2), (30, 5, 3), (9, 3, 2)])
def test_leaving_node_is_refilled_evenly(n, nodes, factor):
    t = fold_commands([("leave_node", {"id": "n1"})], seats(n, nodes, factor))
    load = [sum(x in p.replicas for p in t.slots.values()) for x in t.peers]
    assert all(len(p.replicas) == len(set(p.replicas)) == factor and p.leader in p.replicas for p in t.slots.values())
    assert max(load) - min(load) <= 1


def joins(n, **more):
    return [("join_node", {"id": f"n{i}", "role": "learner", "client_addr": f"c{i}", **more}) for i in range(n)]


PLAN = ("plan_slots", {"gen": 2, "base": 4, "size": 4})


def shape(t):
    return [(s, p.leader, p.replicas, p.epoch, p.state) for s, p in sorted(t.slots.items())]


def test_command_fold():
    t = fold_commands([*joins(3), ("set_policy", {"policy": "medium"}), PLAN, ("mark_down", {"id": "n0"}), ("leader_move", {"slots": [5], "to": "n2"})])
    assert [(s, p.leader, p.epoch) for s, p in sorted(t.slots.items())] == [(4, "n1", 2), (5, "n2", 2), (6, "n2", 1), (7, "n1", 2)]
    assert (t.gen, t.start, t.size, t.layout_epoch, t.plan_members) == (2, 4, 4, 1, ["n0", "n1", "n2"])


def test_a_policy_follows_the_members():
    assert fold_commands([*joins(2), ("set_policy", {"policy": "high"})]).factor == 2
    assert fold_commands([*joins(4), ("set_policy", {"policy": " HIGH "})]).factor == 3
    assert fold_commands([*joins(4), ("set_policy", {"policy": "007"})]).policy == "7"
    assert fold_commands([("config", {"slot_count": 64, "replicas": 5}), ("config", {"slot_count": 0, "replicas": -1})]).factor == 5
    assert fold_commands([("set_topology", {"id": "a"}), ("set_topology", {"id": "b"})]).topology == "a"


def test_a_node_that_comes_back_serves_again():
    ops = [*joins(2), ("drain_node", {"id": "n1", "on": True, "then_remove": True})]
    t = fold_commands(ops)
    assert t.peers["n1"].draining and t.peers["n1"].pending_remove
    assert not fold_commands([*ops, ("drain_node", {"id": "n1", "on": False, "then_remove": True})]).peers["n1"].pending_remove
    back = fold_commands([*ops, ("join_node", {"id": "n1", "role": "voter", "client_addr": "new"})]).peers["n1"]
    assert (back.draining, back.pending_remove, back.role, back.client_addr) == (False, False, "voter", "new")
    t = fold_commands([("join_node", {"id": "x"}), ("register", {"id": "x", "role": "learner", "admin_addr": "a", "client_addr": "c"}), ("register", {"id": "y", "admin_addr": "a", "client_addr": "c"})])
    assert t.peers["x"].hosting and "y" not in t.peers


def test_leaving_purges_the_node():
    one = fold_commands([*joins(2), ("set_policy", {"policy": "low"}), PLAN, ("slot_state", {"slots": [4], "state": "migrating_out", "to": "n1"})])
    t = fold_commands([("leave_node", {"id": "n1"})], one)
    assert "n1" not in t.peers and (t.slots[4].state, t.slots[4].migrating_to) == ("stable", "")
    assert t.slots[5].epoch == 2 and all("n1" not in p.replicas and p.leader != "n1" for p in t.slots.values())
    alone = fold_commands([*joins(1), ("set_policy", {"policy": "low"}), PLAN, ("leave_node", {"id": "n0"})])
    assert shape(alone) == [(s, "", [], 2, "stable") for s in range(4, 8)]
    again = fold_commands([*joins(2)[1:], ("replan_slots", {})], alone)  # a slot without a writer takes the ring's
    assert shape(again) == [(s, "n1", ["n1"], 3, "stable") for s in range(4, 8)]


def test_a_hand_over():
    start = [*joins(4), ("set_policy", {"policy": "medium"}), PLAN]
    t = fold_commands([*start, ("slot_state", {"slots": [4], "state": "migrating_out", "to": "n3"}), ("leader_move", {"slots": [4], "to": "n3", "commit_leo": 9}), ("leader_move", {"slots": [4], "to": "n3", "commit_leo": 7})])
    assert (t.slots[4].leader, t.slots[4].replicas, t.slots[4].epoch, t.slots[4].state, t.slots[4].migrating_to, t.floors) == ("n3", ["n0", "n1", "n3"], 2, "stable", "", {4: 9})
    same = fold_commands([*start, ("slot_state", {"slots": [4], "state": "migrating_out", "to": "n3"}), ("leader_move", {"slots": [4], "to": "n0"})])
    assert (same.slots[4].epoch, same.slots[4].state) == (1, "stable")
    for op in (("leader_move", {"slots": [4], "to": "n9"}), ("leader_move", {"slots": [99], "to": "n1"}), ("slot_add_replica", {"slots": [4], "id": "n9"}), ("slot_remove_replica", {"slots": [4], "id": "n0"}), ("set_group", {"gen": 3, "base": 8, "size": 16}), ("stage_group", {"base": 4, "size": 4}), ("nothing", {})):
        with pytest.raises(Refused):
            fold_commands([*start, op])
        refused = []
        assert shape(fold_commands([*start, op], refused=refused)) == shape(fold_commands(start)) and refused[0][0] == len(start)
    drained = [*start, ("drain_node", {"id": "n3", "on": True})]
    for op in ("leader_move", "slot_add_replica"):
        with pytest.raises(Refused):
            fold_commands([*drained, (op, {"slots": [4], "to": "n3", "id": "n3"})])


def test_a_verdict_on_a_node():
    start = [*joins(3), ("set_policy", {"policy": "high"}), PLAN]
    t = fold_commands([*start, ("mark_down", {"id": "n0", "new_leaders": {"4": "n2"}, "new_leader_leo": {"4": 12, "7": 5}})])
    assert (t.slots[4].leader, t.slots[7].leader, t.floors) == ("n2", "n1", {4: 12, 7: 5})
    assert shape(fold_commands([*start, ("mark_down", {"id": "n9"}), ("mark_up", {"id": "n9"})])) == shape(fold_commands(start))
    last = fold_commands([*start, ("mark_down", {"id": "n1"}), ("mark_down", {"id": "n2"}), ("drain_node", {"id": "n0"}), ("mark_up", {"id": "n1"})])
    assert last.peers["n2"].down and not last.peers["n1"].down


def test_generations():
    start = [*joins(2), ("set_policy", {"policy": "low"}), PLAN]
    staged = fold_commands([*start, ("stage_group", {"base": 8, "size": 8})])
    assert len(staged.slots) == 12 and staged.slots[8].state == "importing_in"
    done = fold_commands([("leader_move", {"slots": [9], "to": "n0"}), ("slot_state", {"slots": [9], "state": "importing_in"}), ("set_group", {"gen": 3, "base": 8, "size": 8})], staged)
    assert sorted(done.slots) == list(range(8, 16)) and done.slots[9].leader == "n0" and {p.state for p in done.slots.values()} == {"stable"} and done.layout_epoch == 2
    fresh = fold_commands([*start, ("set_group", {"gen": 3, "base": 8, "size": 8})])
    assert [p.leader for _, p in sorted(fresh.slots.items())] == ["n0", "n1"] * 4
    assert fold_commands([("set_group", {"gen": 3, "base": 8, "size": 8})], fresh).layout_epoch == 2


def test_the_gate():
    from rillbase.plans.layout import stale

    t = fold_commands([*joins(2), ("set_policy", {"policy": "medium"}), PLAN, ("set_group", {"gen": 3, "base": 8, "size": 8})])
    assert not stale(t)
    odd = fold_commands([("join_node", {"id": "n2", "role": "learner", "client_addr": "c"})], t)
    assert not stale(odd)  # an odd pool whose members are not the last plan's
    even = fold_commands([("join_node", {"id": "n3", "role": "learner", "client_addr": "c"})], odd)
    assert stale(even)
    assert stale(fold_commands([("set_policy", {"policy": "low"})], t))


def run_stream(spark, make, rows, schema, tmp_path, key, files=3):
    step = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = make(read).writeStream.format("memory").queryName(key).outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(key).collect()


def test_hold_stream_equals_the_directory(spark, tmp_path):
    from rillbase.streaming.fold import hold_stream

    rng = random.Random(2)
    rows = [(f"a{rng.randrange(5)}", rng.randint(1, 12), s) for s in range(1, 200)]
    got = run_stream(spark, hold_stream, rows, "aggregate_id string, version long, seq long", tmp_path, "held")
    f = spark.createDataFrame([(1, s, a, v, 0) for a, v, s in rows], "slot int, seq long, aggregate_id string, version long, unix_time long")
    assert {(r.aggregate_id, r.version) for r in got} == {(r.aggregate_id, r.version) for r in directory.directory(f).collect()}


def test_append_stream_equals_the_fold(spark, tmp_path):
    from rillbase.streaming.fold import append_stream

    rng = random.Random(3)
    rows = [(i // 20, i % 20, rng.randrange(3), f"a{rng.randrange(6)}", rng.randint(1, 5), f"c{rng.randrange(150)}", None) for i in range(300)]
    schema = "batch_id long, pos int, slot int, aggregate_id string, version long, command_id string, reason string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = run_stream(spark, append_stream, rows, schema, tmp_path, "appended", files=1)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {(r.batch_id, r.pos): (r.status, r.seq) for r in append.append_fold(spark.createDataFrame(rows, schema)).collect()}
    assert {(r.batch_id, r.pos): (r.status, r.seq) for r in got} == want


def test_a_desynced_stream_can_not_be_read(spark):
    f = frames(spark, [(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, "b", 3)])
    d = directory.directory(f)
    claimed = f.groupBy("slot", "aggregate_id").max("version").withColumnRenamed("max(version)", "version")
    gated = reads.sound(d, claimed)
    assert [r.version for r in gated.where("aggregate_id = 'a'").collect()] == [1, 2]
    with pytest.raises(Exception, match="claims version 3"):
        gated.where("aggregate_id = 'b'").collect()
    assert [tuple(r) for r in directory.slot_digest(f, claimed).collect()] == [(1, 2, 5, 3)]


def test_the_hold_has_a_limit(spark):
    f = frames(spark, [(1, "a", 4), (2, "a", 3), (3, "a", 2), (4, "a", 1), (5, "a", 2)])
    whole = {(r.version, r.seq) for r in directory.directory(f).select("version", "seq").collect()}
    assert whole == {(1, 4), (2, 3), (3, 2), (4, 1)}
    got = lambda cap: {(r.version, r.seq) for r in directory.capped_directory(f, cap).collect()}
    assert got(4) == whole and got(2) == {(1, 4), (2, 5), (3, 2), (4, 1)} and got(1) == {(1, 4), (2, 5)}


def test_replay_skips_appends_and_stops(spark):
    from rillbase.operators.regroup import replay

    rows = [(16, 8, "a", v) for v in range(1, 6)] + [(16, 8, "b", v) for v in (1, 2, 4, 5, 7)] + [(17, 9, "c", v) for v in (2, 3)]
    tails = spark.createDataFrame([(16, "a", 5), (16, "b", 1)], "slot int, aggregate_id string, tail long")
    got = replay(spark.createDataFrame(rows, "slot int, old_slot int, aggregate_id string, version long"), tails, spark.createDataFrame([(16, 40)], "slot int, last_seq long")).collect()
    assert {(r.aggregate_id, r.version): (r.outcome, r.seq) for r in got} == {
        **{("a", v): ("skip", None) for v in range(1, 6)}, ("b", 1): ("skip", None), ("b", 2): ("append", 41), ("b", 4): ("gap", None), ("b", 5): ("unread", None), ("b", 7): ("unread", None), ("c", 2): ("gap", None), ("c", 3): ("unread", None),
    }


def test_one_command_id_in_two_aggregates_of_a_slot(spark):
    rows = [(1, 0, 1, "a", 1, "x", None), (2, 0, 1, "b", 1, "x", None), (3, 0, 2, "b", 1, "x", None), (4, 0, 1, "b", 1, "y", None)]
    got = append.append_fold(spark.createDataFrame(rows, "batch_id long, pos int, slot int, aggregate_id string, version long, command_id string, reason string")).collect()
    assert {r.batch_id: (r.status, r.current_version, r.seq) for r in got} == {1: ("success", 1, 1), 2: ("exists", 1, 1), 3: ("success", 1, 1), 4: ("success", 1, 2)}


def test_header_scan_reads_what_the_record_scan_reads():
    records = [codec.Record("a" * (i + 1), i + 1, 1000 + i, f"c{i}", [("t", b"x" * i)]) for i in range(5)]
    data = codec.segment(3, 7, records)
    for cut in range(len(data), codec.HEADER.size, -1):
        slot, heads = codec.read_headers(data[:cut])
        whole = [(seq, r.aggregate_id, r.version, r.unix_time, r.command_id) for seq, r in codec.read_segment(data[:cut])[1]]
        heads = list(heads)
        assert slot == 3 and [h[:5] for h in heads] == whole
        assert b"".join(data[h[5] : h[5] + h[6]] for h in heads) == data[codec.HEADER.size : codec.HEADER.size + sum(h[6] for h in heads)]


def test_quorum_needs_two_others_within_the_window(spark):
    from rillbase.plans.layout import unreachable

    peers = spark.createDataFrame([("a", False), ("b", False), ("c", False), ("d", True)], "id string, down boolean")
    reports = [("a", "x", 0), ("a", "y", 1000), ("b", "x", 0), ("b", "y", 1001), ("c", "c", 5), ("c", "x", 6), ("c", "x", 7), ("d", "x", 1), ("d", "y", 2), ("z", "x", 1), ("z", "y", 1)]
    got = unreachable(spark.createDataFrame(reports, "node string, reporter string, at_ms long"), peers)
    assert [tuple(r) for r in got.collect()] == [("a", 1000)]


def test_the_command_index_is_sorted_and_looked_up(spark, tmp_path):
    from rillbase.operators import surface

    log = spark.createDataFrame([(i % 3, i, f"c{i}") for i in range(300)] + [(0, 999, "c3")], "slot int, seq long, command_id string")
    surface.write_command_index(log, f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    for file in {r.f for r in index.selectExpr("input_file_name() AS f").distinct().collect()}:
        keys = [(r.slot, r.hash) for r in spark.read.parquet(file).collect()]
        assert keys == sorted(keys)
    asked = spark.createDataFrame([(0, "c3"), (1, "c3"), (1, "c4")], "slot int, command_id string")
    assert {(r.slot, r.command_id): r.seq for r in surface.find_commands(index, asked).collect()} == {(0, "c3"): 3, (1, "c3"): None, (1, "c4"): 4}


def test_unreachable_holds_no_window_of_reports(spark, capsys):
    """Against all pairs of reports; and no frame of raw reports is gone through again for each of them."""
    from pyspark.sql import functions as F

    from rillbase.plans.layout import unreachable

    peers = spark.createDataFrame([(f"n{i}", i == 3) for i in range(4)], "id string, down boolean")
    rng = random.Random(5)
    for window, most in ((0, 40), (1, 60), (7, 300), (50, 2000)):
        reports = [(f"n{rng.randrange(5)}", rng.choice(["n0", "n1", "n2", "n3", "", None]), rng.choice([None, rng.randrange(-most, most)])) for _ in range(150)]
        df = spark.createDataFrame(reports, "node string, reporter string, at_ms long")
        valid = [(n, r, t) for n, r, t in reports if n in ("n0", "n1", "n2") and r and r != n and t is not None]
        for k in (1, 2, 3):
            hits = [(n, t) for n, _, t in valid if len({r for m, r, u in valid if m == n and t - window <= u <= t}) >= k]
            want = {n: min(t for m, t in hits if m == n) for n, _ in hits}
            assert {r.node: r.at_ms for r in unreachable(df, peers, window, k).collect()} == want, (window, k)
    many = spark.range(200_000).select(F.lit("n0").alias("node"), F.concat(F.lit("n"), 1 + F.col("id") % 2).alias("reporter"), F.col("id").alias("at_ms"))
    unreachable(many, peers, 100_000).explain()
    plan = capsys.readouterr().out
    assert "collect_set" not in plan and plan.index("Window") < plan.index("partial_max(at_ms")  # reports are reduced first


def test_segments_reach_python_in_bounded_pieces(spark):
    """Segments in one task, one of them empty but for its header, one torn, one broken inside, and one of a frame longer than a piece."""
    long = [codec.Record("a", 1, 5, "c", [("t", b"x" * (3 * codec.PIECE + 7))]), codec.Record("b", 1, 5, "d", [("t", b"y")])]
    whole = codec.segment(1, 1, RECORDS)
    broken = bytearray(codec.segment(6, 1, RECORDS))
    broken[codec.HEADER.size + 4 : codec.HEADER.size + 6] = b"\xff\xff"
    contents = [whole, codec.segment(2, 1, []), codec.segment(3, 1, long)[:-1], bytes(broken), codec.segment(4, 9, long), whole[:-3] + b"", codec.segment(5, 1, RECORDS * 40)]
    files = spark.createDataFrame([(bytearray(c),) for c in contents], "content binary").coalesce(1)
    sizes = [len(r.piece) for r in codec.pieces(files).collect()]
    assert max(sizes) <= codec.PIECE and sum(sizes) == sum(map(len, contents))
    heads = [(slot, *h) for slot, rows in map(codec.read_headers, contents) for h in rows]
    assert [tuple(r) for r in codec.scan_headers(files).collect()] == heads
    assert [(r.slot, r.seq, bytes(r.frame)) for r in codec.scan_frames(files).collect()] == [(slot, h[0], c[h[5] : h[5] + h[6]]) for c in contents for slot, rows in [codec.read_headers(c)] for h in rows]
    want = [(slot, seq, r.aggregate_id, [b for _, b in r.events]) for slot, rows in map(codec.read_segment, contents) for seq, r in rows]
    assert [(r.slot, r.seq, r.aggregate_id, [bytes(e.body) for e in r.events]) for r in codec.read_records(files).collect()] == want


def test_gzip_of_columns_in_one_worker(spark, capsys):
    """Null, empty, short, long and incompressible bodies come back; packing and unpacking are one step of the plan."""
    from pyspark.sql import functions as F

    bodies = [None, b"", b"x", b"ab" * 4000, random.Random(1).randbytes(5000), b"z" * codec.MAX_BODY, *[bytes([65 + i]) * codec.MAX_BODY for i in range(9)], None, b"end" * 900]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(bodies)], "i int, b binary").coalesce(1)
    packed = df.select("i", codec.gzip_body("b", 1024).alias("p"))
    assert [r.p and r.p.codec for r in packed.orderBy("i").collect()] == [None, 0, 0, 1, 0, *[1] * 10, None, 1]
    back = packed.select("i", codec.inflate_body("p").alias("b"))
    assert [None if r.b is None else bytes(r.b) for r in back.orderBy("i").collect()] == bodies
    back.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_directories_put_frames_in_order_once(spark, capsys):
    """No aggregation holds a task's frames, and they are dealt and sorted once, however many columns are derived."""
    df = frames(spark, [(i, f"a{i % 3}", i // 3 + 1) for i in range(40)])
    for made in (directory.directory(df), directory.withheld(df), directory.tails(df), directory.standing(df)):
        capsys.readouterr()
        made.explain()
        plan = capsys.readouterr().out
        assert "Aggregate" not in plan and plan.count("Exchange") == plan.count("Sort [") == 1, plan
    capsys.readouterr()
    directory.stalled(df).explain()
    keys = [x.split("functions=")[0] for x in capsys.readouterr().out.splitlines() if "Aggregate(key" in x]
    assert keys and not any("aggregate_id" in k for k in keys)


def test_sums_of_an_aggregate_agree_with_plain_ones(spark):
    """Directories, tails, claims, withheld and stalled streams of random frames with replays, gaps and versions below 1, in plain Python."""
    rng = random.Random(9)
    rows = [(rng.choice("abcdef"), rng.randrange(-1, 9)) for _ in range(90)]
    f = frames(spark, [(s, a, v) for s, (a, v) in enumerate(rows, 1)])
    first = {}
    for s, (a, v) in enumerate(rows, 1):
        if v >= 1:
            first.setdefault((a, v), s)
    ids = {a for a, _ in first}
    top = {a: next(v for v in range(99) if (a, v + 1) not in first) for a in ids}
    late = {a: [s for (b, v), s in first.items() if b == a and v > top[a]] for a in ids}
    last = {a: max(s for s, (b, _) in enumerate(rows, 1) if b == a) for a in {a for a, _ in rows}}
    assert {(r.aggregate_id, r.version): r.seq for r in directory.directory(f).collect()} == {k: s for k, s in first.items() if k[1] <= top[k[0]]}
    assert {r.aggregate_id: r.version for r in directory.tails(f).collect()} == top
    assert {(r.aggregate_id, r.claim, r.resolvable) for r in directory.standing(f).collect()} == {(a, max(v for b, v in first if b == a), top[a]) for a in ids if top[a]}
    want = {(a, max(late[a]), len(late[a])) for a in ids if late[a] and any(last[b] > max(late[a]) for b in last if b != a)}
    assert {(r.aggregate_id, r.held_seq, r.withheld) for r in directory.stalled(f).collect()} == want


def test_lookups_of_repeated_ids(spark):
    from rillbase.operators import surface

    d = spark.createDataFrame([(s, "a", v, 10 * s + v, 50 - s) for s in (1, 2) for v in range(1, 6)], "slot int, aggregate_id string, version long, seq long, unix_time long")
    asked = spark.createDataFrame([("a", 4), ("a", 4), ("a", 6), ("b", 1)], "aggregate_id string, version long")
    got = surface.find_versions(surface.aggregate_index(d, 2), asked).select("aggregate_id", "version", "seq", "unix_time")
    assert sorted(map(tuple, got.collect())) == [("a", 4, 24, 49), ("a", 6, None, None), ("b", 1, None, None)]


def test_frames_are_dealt_by_what_makes_them(spark, sf, tmp_path, capsys):
    """Columns that don't change a frame are not sorted, and the frames are those of an order by all columns."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from rillbase.sources.logviews import frames_lineitem, table

    made = frames_lineitem(spark, sf)
    made.explain()
    assert not any(c in capsys.readouterr().out for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"))
    rows = table(spark, sf, "lineitem").unionByName(table(spark, sf, "lineitem").withColumn("l_tax", F.col("l_tax") + 1)).withColumn("slot", (F.col("l_orderkey") % 4).cast("int"))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    want = rows.withColumn("seq", F.row_number().over(Window.partitionBy("slot").orderBy(*order)))
    want = want.select("slot", "seq", F.concat(F.lit("ord-"), "l_orderkey").alias("aggregate_id"), F.col("l_linenumber").cast("long").alias("version"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("unix_time"))
    rows.drop("slot").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, frames_lineitem(spark, str(tmp_path)).collect())) == sorted(map(tuple, want.collect()))


def test_the_capped_hold_is_one_pass(spark, capsys):
    """Random frames with replays, gaps and null keys under several caps, in batches shorter than an aggregate, in plain Python."""
    rng = random.Random(4)
    rows = [(s, rng.choice(["a", "b", "c", "", None]), rng.randrange(-1, 12)) for s in range(1, 161)]
    f = frames(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for cap in (0, 1, 2, 5, 99):
            want, last, held = set(), {}, {}
            for s, a, v in rows:
                mine = held.setdefault(a, {})
                if v == last.get(a, 0) + 1:
                    mine[v] = s
                    while last.get(a, 0) + 1 in mine:
                        last[a] = last.get(a, 0) + 1
                        want.add((a, last[a], mine.pop(last[a])))
                elif v > last.get(a, 0) and len(mine) < cap:
                    mine.setdefault(v, s)
            got = [(r.aggregate_id, r.version, r.seq) for r in directory.capped_directory(f, cap).collect()]
            assert len(got) == len(want) and set(got) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    capsys.readouterr()
    directory.capped_directory(f, 1).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == plan.count("Sort [") == 1 and "Window" not in plan and "Union" not in plan


def test_rows_are_not_broadcast_to_their_counts(spark, sf, capsys):
    """However small a table looks, its rows stay dealt by slot and bucket while they are numbered."""
    from rillbase.sources.logviews import frames_lineitem, log_events

    for rows in (log_events(spark, sf), frames_lineitem(spark, sf)):
        capsys.readouterr()
        rows.select("slot", "seq").explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
