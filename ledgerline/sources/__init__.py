"""What plans read and write: bars, ledgers, memberships, logs."""

from . import snapshots
from .files import SCHEMAS, append_csv, append_jsonl, append_rows, bars, cached, ledger, log, membership, rebuild_history, table_jdbc, upsert_history
from .oos import single_shot
from .walk import random_walk

__all__ = ["SCHEMAS", "append_csv", "append_jsonl", "append_rows", "bars", "cached", "ledger", "log", "membership", "random_walk", "rebuild_history", "single_shot", "snapshots", "table_jdbc", "upsert_history"]
