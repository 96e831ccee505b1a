"""Layout planning over the metadata tables (at most some thousand slots, a fixed bound).

Rules on single rows are column expressions. The seat plan is sequential over one small table and runs in Python
on it; the fold of metadata commands is in ``commands``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import same_members


def ring_plan(spark: SparkSession, nodes: list[str], start: int, end: int, factor: int) -> DataFrame:
    """slot, leader, replicas, epoch and state: slot s is led by nodes[(s - start) % N], the next ones follow."""
    n = len(nodes)
    rf = factor if 0 < factor <= n else n
    ring = F.array(*[F.lit(x) for x in nodes])
    seat = lambda i: F.element_at(ring, ((F.col("slot") - start + i) % n + 1).cast("int"))
    slots = spark.range(start, end).select(F.col("id").cast("int").alias("slot"))
    return slots.select("slot", seat(F.lit(0)).alias("leader"), F.transform(F.sequence(F.lit(0), F.lit(rf - 1)), seat).alias("replicas"), F.lit(1).cast("long").alias("epoch"), F.lit("stable").alias("state"))


def ring_leader(slot: Column, nodes: list[str], start: int, end: int) -> Column:
    ring = F.array(*[F.lit(x) for x in nodes])
    inside = (slot >= start) & (slot < end)
    return F.when(inside, F.element_at(ring, (F.pmod(slot - start, F.lit(len(nodes))) + 1).cast("int"))).otherwise(F.lit(""))


def pools(peers: DataFrame) -> DataFrame:
    """hosting, candidates and online as sorted lists: draining peers are left out unless none is left."""
    hosts = (F.col("role") == "learner") & (F.coalesce("client_addr", F.lit("")) != "")
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    got = peers.agg(ids(hosts).alias("hosting"), ids(hosts & ~F.col("draining")).alias("calm"), ids(hosts & ~F.col("down")).alias("live"), ids(hosts & ~F.col("down") & ~F.col("draining")).alias("calm_live"))
    pick = lambda a, b: F.when(F.size(a) > 0, F.col(a)).otherwise(F.col(b))
    return got.select("hosting", pick("calm", "hosting").alias("candidates"), pick("calm_live", "live").alias("online"))


def failover_leader(replicas: Column, down: Column, preferred: Column, offline: Column, draining: Column) -> Column:
    """The preferred node where it may lead, else the first live and calm replica, the first live, the first other, or none."""
    others = F.filter(replicas, lambda r: r != down)
    live = F.filter(others, lambda r: ~F.array_contains(offline, r))
    calm = F.filter(live, lambda r: ~F.array_contains(draining, r))
    first = lambda a: F.try_element_at(a, F.lit(1))
    chosen = F.when((preferred != "") & F.array_contains(calm, preferred), preferred)
    return F.coalesce(chosen, first(calm), first(live), first(others), F.lit(""))


def owner_decision() -> Column:
    """(action, reason) from columns topology, self, leader, replicas, epoch, has_owner, owner_topology, owner_epoch, owner_leader, has_wal, stranger_dir."""
    lead = F.col("leader") == F.col("self")
    out = lambda a, r="ok": F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"))
    same = F.col("owner_topology") == F.col("topology")
    proven = same & ((F.col("owner_epoch") < F.col("epoch")) | ((F.col("owner_epoch") == F.col("epoch")) & (F.col("owner_leader") == F.col("leader"))))
    current = same & (F.col("owner_epoch") == F.col("epoch")) & (F.col("owner_leader") == F.col("leader"))
    return (
        F.when(~lead & ~F.array_contains("replicas", F.col("self")), out("none"))
        .when(~F.col("has_owner") & F.col("stranger_dir") & lead & F.col("has_wal"), out("pending", "foreign_dir"))
        .when(~F.col("has_owner") & F.col("stranger_dir"), out("none"))
        .when(~F.col("has_owner"), out("stamp"))
        .when(current, out("none"))
        .when(proven, out("stamp"))
        .when(~lead, out("none"))
        .when(~same, out("pending", "topology_mismatch"))
        .when(F.col("owner_epoch") > F.col("epoch"), out("pending", "epoch_backward"))
        .otherwise(out("pending", "lineage_unknown"))
    )


def orphan_migrations(placements: DataFrame, in_flight: DataFrame) -> DataFrame:
    """Slots that are not stable and that no running migration holds, ascending."""
    return placements.where("state <> 'stable'").join(in_flight.select("slot"), "slot", "left_anti").select("slot").orderBy("slot")


def surplus_seat(replicas: Column, leader: Column, target: Column, former: Column, factor: int) -> Column:
    """The seat a stable slot above its factor gives up: the former source, else the smallest id neither leader nor target."""
    free = F.array_sort(F.filter(replicas, lambda r: (r != leader) & (r != target)))
    pick = F.when(F.array_contains(free, former), former).otherwise(F.try_element_at(free, F.lit(1)))
    return F.when((F.size(replicas) > factor), F.coalesce(pick, F.lit(""))).otherwise(F.lit(""))


def drain_progress(placements: DataFrame) -> DataFrame:
    """Per node: stable slots it leads, and other slots it leads or replicates."""
    led = placements.where("state = 'stable'").groupBy(F.col("leader").alias("node")).agg(F.count("*").alias("leading"))
    busy = placements.where("state <> 'stable'").select(F.explode(F.array_union("replicas", F.array("leader"))).alias("node")).groupBy("node").agg(F.count("*").alias("in_flight"))
    return led.join(busy, "node", "full_outer").select("node", F.coalesce("leading", F.lit(0)).alias("leading"), F.coalesce("in_flight", F.lit(0)).alias("in_flight"))


def unreachable(reports: DataFrame, peers: DataFrame, window_ms: int = 1000, reporters: int = 2) -> DataFrame:
    """node, at_ms: members marked down, when ``reporters`` others have named them within the window (its edge included).

    reports: node, reporter, at_ms; peers: id, down. Reports on oneself, on strangers and on nodes that are down do not count.
    """
    up = peers.where(~F.col("down")).select(F.col("id").alias("node"))
    rows = reports.where("reporter <> '' and reporter <> node and at_ms is not null").join(F.broadcast(up), "node", "left_semi")  # the members of a cluster
    # In spans one longer than the window, a reporter counts from its first report of the span on, and up to the window
    # after its last one of the span before. Counts rise only at first reports, so only these can be the answer.
    width = window_ms + 1
    start = F.col("at_ms") - F.pmod("at_ms", F.lit(width))
    each = rows.groupBy("node", "reporter", start.alias("span")).agg(F.min("at_ms").alias("first"), F.max("at_ms").alias("last"))
    none = F.lit(None).cast("long")
    sides = F.array(F.struct(F.col("span"), F.col("first"), none.alias("until")), F.struct((F.col("span") + width).alias("span"), none.alias("first"), (F.col("last") + window_ms).alias("until")))
    met = each.select("node", "reporter", F.inline(sides)).groupBy("node", "span", "reporter").agg(F.max("first").alias("first"), F.max("until").alias("until"))
    known, still = F.col("until").isNotNull(), F.col("first") <= F.col("until")
    steps = (
        F.when(known, F.struct(F.col("span").alias("at_ms"), F.lit(1).alias("step"), F.lit(False).alias("own"))),
        F.when(known & ~F.coalesce(still, F.lit(False)), F.struct((F.col("until") + 1).alias("at_ms"), F.lit(-1).alias("step"), F.lit(False).alias("own"))),
        F.when(F.col("first").isNotNull(), F.struct(F.col("first").alias("at_ms"), F.when(still, 0).otherwise(1).alias("step"), F.lit(True).alias("own"))),
    )
    turns = met.select("node", "span", F.inline(F.array_compact(F.array(*steps))))
    n = F.sum("step").over(Window.partitionBy("node", "span").orderBy("at_ms"))  # with all steps of the same moment
    return turns.withColumn("n", n).where(F.col("own") & (F.col("n") >= reporters)).groupBy("node").agg(F.min("at_ms").alias("at_ms"))


def members(voters: DataFrame, directory: DataFrame) -> DataFrame:
    """Voters with what the directory knows of them, and the directory's learners that are no voters."""
    known = directory.select("id", "role", "client_addr", "draining")
    own = voters.select("id").join(known.drop("role"), "id", "left").select("id", F.lit("voter").alias("role"), "client_addr", "draining")
    rest = known.where("role = 'learner'").join(voters.select("id"), "id", "left_anti")
    return own.unionByName(rest)


@dataclass
class Slot:
    leader: str
    replicas: list[str]
    state: str = "stable"
    epoch: int = 1
    migrating_to: str = ""
    grants: dict[str, str] = field(default_factory=dict)


@dataclass
class Peer:
    role: str = "learner"
    client_addr: str = "http://client"
    admin_addr: str = ""
    down: bool = False
    draining: bool = False
    pending_remove: bool = False

    @property
    def hosting(self) -> bool:
        return self.role == "learner" and self.client_addr != ""

    @property
    def offline(self) -> bool:
        return self.down or self.client_addr == ""


@dataclass
class Layout:
    """The metadata table: slots of the served segment (``start``, ``size``) and staged ones, members, the replica factor, commit floors."""

    slots: dict[int, Slot] = field(default_factory=dict)
    peers: dict[str, Peer] = field(default_factory=dict)
    factor: int = 2
    policy: str = "medium"
    topology: str = ""
    start: int = 0
    size: int = 0
    gen: int = -1
    slot_count: int = 2048
    layout_epoch: int = 0
    plan_members: list[str] = field(default_factory=list)
    floors: dict[int, int] = field(default_factory=dict)

    def hosting(self) -> list[str]:
        return sorted(i for i, p in self.peers.items() if p.hosting)

    def candidates(self) -> list[str]:
        hosts = self.hosting()
        return [i for i in hosts if not self.peers[i].draining] or hosts

    def online(self) -> list[str]:
        live = [i for i in self.hosting() if not self.peers[i].down]
        return [i for i in live if not self.peers[i].draining] or live


class SeatPlanner:
    """Fewest moves to a layout of ``factor`` seats a slot, seats and leaders even over the nodes.

    Slots go in ascending order and ties to the smaller id. ``seats`` is what each slot should hold.
    """

    def __init__(self, layout: Layout):
        self.layout, self.nodes = layout, layout.candidates()
        self.want = min(layout.factor, len(self.nodes))
        self.slots = sorted(s for s, p in layout.slots.items() if p.state == "stable")
        pool = set(self.nodes)
        self.seats = {s: [r for r in dict.fromkeys(layout.slots[s].replicas) if r in pool] for s in self.slots}
        self.load = Counter(r for x in self.seats.values() for r in x)
        self.add: dict[int, list[str]] = {}
        self.lead: dict[int, str] = {}
        self.balance: set[int] = set()

    def leader(self, s: int) -> str:
        return self.layout.slots[s].leader

    def ring(self, s: int, i: int = 0) -> str:
        return self.nodes[(s - self.layout.start + i) % len(self.nodes)]

    def on_ring(self, s: int, node: str) -> bool:
        return node in [self.ring(s, i) for i in range(self.want)]

    def give(self, s: int, node: str) -> None:
        self.seats[s].append(node)
        self.load[node] += 1
        self.add.setdefault(s, []).append(node)

    def fill(self) -> None:
        for s in self.slots:
            while len(self.seats[s]) < self.want:
                self.give(s, min((n for n in self.nodes if n not in self.seats[s]), key=lambda n: (self.load[n], n)))

    def trim(self) -> None:
        """Above the factor: first a seat off the ring, then of the fullest node, then the latest; never the leader's."""
        for s in self.slots:
            while len(self.seats[s]) > self.want:
                free = [(self.on_ring(s, n), -self.load[n], -i, n) for i, n in enumerate(self.seats[s]) if n != self.leader(s)]
                if not free:
                    break
                node = min(free)[3]
                self.seats[s].remove(node)
                self.load[node] -= 1

    def even(self) -> None:
        """Seats go from nodes above the floor to nodes below it, a follower's before a leader's."""
        floor = len(self.slots) * self.want // len(self.nodes)
        for _ in self.slots:
            rich = min((n for n in self.nodes if self.load[n] > floor), key=lambda n: (-self.load[n], n), default=None)
            poor = min((n for n in self.nodes if self.load[n] < floor), key=lambda n: (self.load[n], n), default=None)
            if rich is None or poor is None:
                return
            fits = [s for s in self.slots if rich in self.seats[s] and poor not in self.seats[s]]
            swap = next((s for s in fits if self.leader(s) != rich), None)
            if swap is not None:
                self.seats[swap] = [poor if n == rich else n for n in self.seats[swap]]
                self.load[rich] -= 1
                self.load[poor] += 1
                self.add.setdefault(swap, []).append(poor)
                continue
            extra = next((s for s in fits if self.ring(s) == poor), None)
            if extra is None:
                return
            self.give(extra, poor)

    def lead_all(self) -> None:
        live = set(self.layout.online())
        for s in self.slots:
            now = self.leader(s)
            if now and not (now in self.seats[s] and now in live):
                heirs = [n for n in self.seats[s] if n in live and n != now]
                if heirs:
                    self.lead[s] = min(heirs)
        count = sum(n in live for n in self.nodes) or len(self.nodes)
        floor, ceil = len(self.slots) // count, -(-len(self.slots) // count)
        leads = Counter(self.leader(s) for s in self.slots if self.leader(s) in live)
        for s in self.slots:
            now = self.leader(s)
            if s in self.lead or now not in live or leads[now] <= ceil:
                continue
            heirs = [n for n in self.seats[s] if n != now and n in live and leads[n] < floor]
            if heirs:
                self.lead[s] = heir = min(heirs, key=lambda n: (not self.on_ring(s, n), leads[n], n))
                self.balance.add(s)
                leads[now] -= 1
                leads[heir] += 1
        if any(n in live and not floor <= leads[n] <= ceil for n in self.nodes):
            return
        for s in self.slots:
            now, home = self.leader(s), self.ring(s)
            if s in self.lead or not now or home == now or home not in live or not {now, home} <= set(self.seats[s]):
                continue
            if leads[now] == leads[home] and leads[home] + 1 <= ceil and leads[now] - 1 >= floor:
                self.lead[s] = home
                self.balance.add(s)

    def plan(self) -> dict[int, dict]:
        if not self.nodes or not self.slots:
            return {}
        for step in (self.fill, self.trim, self.even, self.lead_all):
            step()
        out = {}
        for s in self.slots:
            drop = [r for r in self.layout.slots[s].replicas if r not in self.seats[s]]
            out[s] = {"target": self.seats[s], "add": self.add.get(s, []), "drop": drop, "lead": self.lead.get(s, ""), "balance": s in self.balance}
        return out


def refill(t: Layout) -> None:
    """Seats for stable slots that are short of the factor, then swaps until every node has its quota.

    A node's quota is its equal share; what is left over goes to the nodes that carry most already. Of the
    nodes without a seat in the slot the one furthest below its quota is taken, else the emptiest.
    """
    nodes = t.candidates()
    stable = sorted(s for s, p in t.slots.items() if p.state == "stable")
    want = min(t.factor, len(nodes))
    short = [s for s in stable if len(t.slots[s].replicas) < want]
    if not nodes or not short:
        return
    load = Counter({n: sum(n in p.replicas for p in t.slots.values()) for n in nodes})
    share, left = divmod(len(stable) * want, len(nodes))
    fullest = sorted(nodes, key=lambda n: (-load[n], n))[:left]
    quota = {n: share + (n in fullest) for n in nodes}
    need = {n: max(quota[n] - load[n], 0) for n in nodes}
    for s in short:
        seats = t.slots[s].replicas
        while len(seats) < want:
            free = [n for n in nodes if n not in seats]
            if not free:
                break
            needy = [n for n in free if need[n]]
            pick = min(needy, key=lambda n: (-need[n], n)) if needy else min(free, key=lambda n: (load[n], n))
            seats.append(pick)
            load[pick] += 1
            need[pick] = max(need[pick] - 1, 0)
    for _ in short:
        rich = min((n for n in nodes if load[n] > quota[n]), key=lambda n: (-load[n], n), default=None)
        poor = min((n for n in nodes if load[n] < quota[n]), key=lambda n: (load[n], n), default=None)
        if rich is None or poor is None:
            return
        fits = [s for s in [*short, *stable] if rich in t.slots[s].replicas and poor not in t.slots[s].replicas]
        calm = [s for s in fits if t.slots[s].leader != rich]
        led = [s for s in stable if s in fits and len(t.slots[s].replicas) > 1]
        if not calm and not led:
            return
        p = t.slots[(calm or led)[0]]
        if p.leader == rich:
            p.leader, p.epoch = next(n for n in p.replicas if n != rich), p.epoch + 1
        p.replicas[p.replicas.index(rich)] = poor
        load[rich] -= 1
        load[poor] += 1


def surplus_for_replan(replicas: Column, leader: Column, planned: Column, factor: int) -> Column:
    """The smallest id that is neither the leader's nor planned, only above the factor; empty for none."""
    rest = F.array_sort(F.filter(replicas, lambda r: (r != leader) & ~F.array_contains(planned, r)))
    return F.when(F.size(replicas) > factor, F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit(""))).otherwise(F.lit(""))


def leader_rebalance(placements: DataFrame, plan: DataFrame, peers: DataFrame) -> DataFrame:
    """slot, from, to, balance: hand-overs of stable slots, ascending.

    plan: slot, lead, balance; peers: id, role, client_addr, down, draining. A draining leader gives its slot to the first
    seat that hosts, is up and is calm; any other goes to the planned leader, if that holds a seat. With fewer than two
    online nodes only slots of draining leaders move.
    """
    member = F.struct("id", "draining", ((F.col("role") == "learner") & (F.col("client_addr") != "") & ~F.col("down")).alias("live"))
    pool = peers.agg(F.collect_list(member).alias("members"))  # the members of a cluster
    ids = lambda test: F.transform(F.filter("members", test), lambda m: m["id"])
    pool = pool.select(ids(lambda m: m["live"] & ~m["draining"]).alias("calm"), ids(lambda m: m["live"]).alias("live"), ids(lambda m: m["draining"]).alias("leaving"))
    pool = pool.withColumn("online", F.when(F.size("calm") > 0, F.size("calm")).otherwise(F.size("live")))
    rows = placements.where("state = 'stable' and leader <> ''").join(plan.select("slot", "lead", "balance"), "slot", "left").crossJoin(F.broadcast(pool))
    drain = F.array_contains("leaving", F.col("leader"))
    first = F.try_element_at(F.filter("replicas", lambda r: (r != F.col("leader")) & F.array_contains("calm", r)), F.lit(1))
    wanted = F.when((F.col("online") >= 2) & (F.col("lead") != "") & (F.col("lead") != F.col("leader")) & F.array_contains("replicas", F.col("lead")), F.col("lead"))
    to = F.when(drain, first).otherwise(wanted)
    balance = ~drain & F.coalesce("balance", F.lit(False))
    return rows.select("slot", F.col("leader").alias("from"), to.alias("to"), balance.alias("balance")).where("`to` is not null").orderBy("slot")


def settled(placements: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Whether every placement (of each layout named by ``keys``) is stable; true of none."""
    return placements.groupBy(*(keys or [])).agg(F.coalesce(F.bool_and(F.col("state") == "stable"), F.lit(True)).alias("settled"))


def gate_open(layout_epoch: Column, hosting: Column, plan_members: Column) -> Column:
    """Whether automatic seat movement may begin: before a second layout, with an even pool, or where the members are those of the last plan."""
    return (layout_epoch <= 1) | (F.size(hosting) % 2 == 0) | same_members(plan_members, hosting)


def stale(t: Layout) -> bool:
    """Whether the gate is open and the seat plan has something to do."""
    hosts = t.hosting()
    if t.layout_epoch > 1 and len(hosts) % 2 and not (len(t.plan_members) == len(hosts) and set(hosts) <= set(t.plan_members)):
        return False
    return any(x["add"] or x["drop"] or x["lead"] for x in SeatPlanner(t).plan().values())


def seat_plan(placements: DataFrame, peers: DataFrame, factor: int, start: int) -> DataFrame:
    """slot, target, add, drop, lead (empty: stays), balance (the move only evens out or follows the ring) of every stable slot."""
    spark = placements.sparkSession
    t = Layout(
        {r.slot: Slot(r.leader, list(r.replicas), r.state) for r in placements.collect()},
        {r.id: Peer(r.role, r.client_addr or "", "", r.down, r.draining) for r in peers.collect()},
        factor,
        start=start,
    )
    rows = [(s, x["target"], x["add"], x["drop"], x["lead"], x["balance"]) for s, x in SeatPlanner(t).plan().items()]
    return spark.createDataFrame(rows, "slot int, target array<string>, add array<string>, drop array<string>, lead string, balance boolean")
