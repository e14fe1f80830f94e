"""Hash-chained audit logs: manifests, link checks, digest verification and append."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwake.operators.ordered import neighbours

GENESIS = "0" * 64
# Artefacts that are never hashed.
EXCLUDED = ("ground_truth.json", "audit.log", "alert.json")
EXCLUDED_PREFIX = "dossier_"
SEQ_BUCKET = 100_000


def auditable(files: DataFrame) -> DataFrame:
    """Drop the files a manifest must not cover."""
    return files.filter(~F.col("name").isin(*EXCLUDED) & ~F.startswith("name", F.lit(EXCLUDED_PREFIX)))


def broken_links(log: DataFrame, keys: tuple[str, ...] = (), genesis: str = GENESIS, bucket: int = SEQ_BUCKET) -> DataFrame:
    """Entries whose recorded predecessor hash is not the hash before them. Chains split at fixed sequence
    ranges; only one edge row per range meets the rest, so one long log is not one long task."""
    n = neighbours(log.select(*keys, "seq", "incident_id", "prev_hash", "chain_hash"), list(keys), ["seq"],
                   ["chain_hash"], F.floor(F.col("seq") / bucket))
    return n.filter(F.coalesce(F.col("prev.chain_hash"), F.lit(genesis)) != F.col("prev_hash")).select(
        *keys, "seq", "incident_id", "prev_hash")


def broken_bodies(log: DataFrame) -> DataFrame:
    """Entries whose own hash does not match their canonical body."""
    return log.filter(F.sha2(F.col("body"), 256) != F.col("chain_hash")).select("seq", "incident_id")


def newest_entries(log: DataFrame) -> DataFrame:
    return log.groupBy("incident_id").agg(
        F.max_by(F.struct("seq", "chain_hash"), F.col("seq")).alias("e"), F.count(F.lit(1)).alias("entries")).select(
        "incident_id", F.col("e.seq").alias("seq"), F.col("e.chain_hash").alias("chain_hash"), "entries")


def verify_digests(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """Newest recorded digests against files present now: ok, differs, missing or unrecorded."""
    r = recorded.select("incident_id", "name", F.col("sha256").alias("recorded"))
    p = present.select("incident_id", "name", F.col("sha256").alias("actual"))
    status = (F.when(F.col("actual").isNull(), "missing").when(F.col("recorded").isNull(), "unrecorded")
              .when(F.col("actual") != F.col("recorded"), "differs").otherwise("ok"))
    return r.join(p, ["incident_id", "name"], "full_outer").select("incident_id", "name", status.alias("status"))


@F.pandas_udf(T.StringType())
def canonical_json_sha256(text: pd.Series) -> pd.Series:
    """SHA-256 of JSON text with keys sorted and no incidental space; other text is hashed as it is."""
    def digest(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            t = json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            pass
        return hashlib.sha256(t.encode()).hexdigest()

    return text.map(digest)


def append_entries(pending: DataFrame, heads: DataFrame) -> DataFrame:
    """Chain new entries (log_id, seq, body) onto each log's head (log_id, chain_hash).

    The stored body ends with the hash before it and is what the entry's own hash covers, as ``broken_bodies`` expects.
    That makes one log's new entries sequential:
    an ordered fold over that log's pending batch, with logs in parallel.
    """
    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        prev, prevs, bodies, hashes = pdf["head"].iloc[0], [], [], []
        for body in pdf["body"]:
            prevs.append(prev)
            bodies.append(f"{body}|{prev}")
            prev = hashlib.sha256(bodies[-1].encode()).hexdigest()
            hashes.append(prev)
        return pd.DataFrame({"log_id": pdf["log_id"], "seq": pdf["seq"], "body": bodies, "prev_hash": prevs, "chain_hash": hashes})

    h = heads.select("log_id", F.col("chain_hash").alias("head"))
    start = pending.join(h, "log_id", "left").withColumn("head", F.coalesce("head", F.lit(GENESIS)))
    return start.groupBy("log_id").applyInPandas(
        chain, "log_id long, seq long, body string, prev_hash string, chain_hash string")
