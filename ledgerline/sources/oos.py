"""The out-of-sample run that happens once."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable, Mapping
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .files import append_jsonl
from .snapshots import Conflict, create, names

RECORD = "run_at string, params_hash string, params string, result string"


def params_hash(params: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:10]


def single_shot(spark: SparkSession, folder: str, params: Mapping[str, object], run: Callable[[], Mapping[str, object]], confirm: bool = False) -> Mapping[str, object]:
    """Runs only if confirmed, warns of earlier runs, and writes what was run and found to the log.

    The holdout is claimed before the run: claim k is a file that only one run can create, so of two runs at once one is blind and the
    other is warned, and a run that stops has still been one.
    """
    if not confirm:
        raise PermissionError("an out-of-sample run has to be confirmed")
    claims, own = f"{folder}/oos_claims", json.dumps(params, sort_keys=True, default=str)
    now = lambda: datetime.now(UTC).isoformat()
    earlier = len([n for n in names(spark, claims) if n.endswith(".claim")])
    while True:
        try:
            create(spark, f"{claims}/{earlier:06d}.claim", json.dumps({"at": now(), "params_hash": params_hash(params)}))
            break
        except Conflict:
            earlier += 1
    if earlier:
        warnings.warn(f"{earlier} earlier out-of-sample runs: this one is no longer blind", stacklevel=2)
    result = run()
    row = (now(), params_hash(params), own, json.dumps(result, sort_keys=True, default=str))
    append_jsonl(spark.createDataFrame([row], RECORD), f"{folder}/oos_log")
    return result
