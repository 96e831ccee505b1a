"""Record schemas, limits and the error dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Schemas as DDL: a worker that imports this module has no session to parse them with.
EVENT_LOG = "slot int, seq long, aggregate_id string, version long, unix_time long, command_id string, codec tinyint, events array<struct<type:string,body:binary>>"
REQUEST = "batch_id long, pos int, aggregate_id string, version long, unix_time long, command_id string, codec tinyint, events array<struct<type:string,body:binary>>"
PEER = "id string, role string, peer_addr string, admin_addr string, client_addr string, down boolean, draining boolean, pending_remove boolean"
PLACEMENT = "slot int, leader string, replicas array<string>, epoch long, state string, migrating_to string, seat_grant map<string,string>"
PROGRESS = "slot int, node string, leo long, last_ok_ms long, building boolean"

#: Field limits of a record.
MAX_ID_BYTES = 256
MAX_TYPE_BYTES = 256
MAX_EVENTS = 1024
MAX_BODY_BYTES = 1 << 20
MAX_WITHHELD = 65536
ISR_STALE_MS = 10_000

#: Refusals of an append.
ERRORS = {
    1001: "version_conflict",
    1002: "bad_request",
    1003: "slot_not_local",
    1004: "migrating",
    1005: "flow_control",
    1006: "slot_unproven",
    1007: "ack_timeout",
    1008: "replica_catching_up",
    1009: "no_data_plane",
    1010: "group_mismatch",
}


def errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(ERRORS.items()), "err_id int, name string")
