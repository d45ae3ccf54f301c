"""Each content of a source is taken in once, by whichever of several writers comes first.

A content has an id, the hash of its source and digest. Who may work on it is settled by claims, numbered files that only
one writer can create: the first is claim 0, and who finds claim k abandoned creates k + 1. A claim is abandoned if its
work failed, or if it is older than the lease and has no result. Results are files of their own, looked up by id, so
neither a lookup nor a new result touches the rest of the ledger.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import files

SCHEMA = "source string, sha256 string, result string, arrived_at timestamp"


def content_ledger(spark: SparkSession, path: str) -> DataFrame:
    """source, sha256, result and arrived_at of everything that was taken in."""
    if not files.exists(spark, f"{path}/results"):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(f"{path}/results")


def _claimed(spark: SparkSession, ledger: str, name: str, lease: float) -> bool:
    """Whether this writer now holds the content; False while another does."""
    folder = f"{ledger}/claims/{name}"
    held = [int(n.partition(".")[0]) for n in files.names(spark, folder) if n[0].isdigit()]
    newest = max(held, default=-1)
    if newest >= 0:
        failed = files.exists(spark, f"{folder}/{newest}.failed")
        if not failed and files.age_ms(spark, f"{folder}/{newest}") < lease * 1000:
            return False
    return files.create_once(spark, f"{folder}/{newest + 1}", "")


def take_in(spark: SparkSession, ledger: str, source: str, file: str, work: Callable[[str], str], lease: float = 3600, pause: float = 0.2) -> tuple[str, bool]:
    """The result of work(file), and whether it ran here: a content that came from the source before gets the first result.

    Contents are told apart by SHA-256, computed by an executor where the file is read. A writer that finds the content
    in another's hands waits for the result, and takes over if that work fails or outlasts the lease (in seconds).
    Work that outlasts its lease may therefore run twice; the result that is written first stands.
    """
    digest = spark.read.format("binaryFile").load(file).select(F.sha2("content", 256)).first()[0]
    name = hashlib.sha256(json.dumps([source, digest]).encode()).hexdigest()
    done = f"{ledger}/results/{name}.json"
    first = lambda: json.loads(files.read_text(spark, done))["result"]
    while not files.exists(spark, done):
        if not _claimed(spark, ledger, name, lease):
            time.sleep(pause)
            continue
        if files.exists(spark, done):  # a result that came between the look and the claim
            break
        try:
            result = work(file)
        except BaseException:
            mine = max(int(n) for n in files.names(spark, f"{ledger}/claims/{name}") if n.isdigit())
            files.create_once(spark, f"{ledger}/claims/{name}/{mine}.failed", "")
            raise
        at = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        row = {"source": source, "sha256": digest, "result": result, "arrived_at": at}
        return (result, True) if files.create_once(spark, done, json.dumps(row)) else (first(), True)
    return first(), False
