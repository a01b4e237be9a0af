"""Schemas of the engine's own tables."""

from __future__ import annotations

IMAGE = "map<string,string>"

SCHEMAS = {
    "tracked": "table_name string, pk_cols array<string>, tracked_at timestamp",
    "relations": "table_name string, schema_name string, kind string, pk_cols array<string>, owned boolean, generated map<string,string>",
    "history": f"id long, txid long, fingerprint string, statement_sample string, table_name string, op string, pk {IMAGE}, row_before {IMAGE}, row_after {IMAGE}, committed_at timestamp, db_user string, application_name string, is_undo boolean, undo_of long, pk_text string, pk_key string, tid struct<blk:long,off:int>",
    "read_set": "reader_xid long, table_name string, blk long, off int, locktype int, read_pk string",
    "dependencies": "txid long, depends_on long, kind string, table_name string, granularity string",
    "undo_txn": "txid long, undo_of long, at timestamp",
    "markers": "id long, label string, at timestamp, source string",
    "ddl_log": "id long, command_tag string, object_type string, schema_name string, object_identity string, statement string, is_destructive boolean, needs_snapshot boolean, snapshot_lsn long, at timestamp, src_id long",
    "snapshots": "id long, backup_name string, lsn long, kind string, created_at timestamp, pruned_at timestamp, tables map<string,array<string>>",
    "recovery_log": "id long, kind string, object string, backup_name string, target_lsn long, rows long, at timestamp",
    "capture_state": "slot string, last_commit_lsn long",
}
