"""Behaviour flags: is the vessel acting like one about to discharge?"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwake.config import DEFAULT, Config
from driftwake.functions import geo
from driftwake.operators.ordered import HOUR_US, TRACK_BUCKET_US, carry_forward, neighbours, runs, time_bucket
from driftwake.session import checkpoint

MIN_FIXES = 12
UNDERWAY_KN = 3.0
MIN_UNDERWAY_FRACTION = 0.05


def vessel_norms(ais: DataFrame) -> DataFrame:
    """Per-vessel statistics the rules compare against. Reported speed is quantised, so the exact
    median's value histogram stays small and merges map-side."""
    moving = F.col("sog") > UNDERWAY_KN
    return ais.groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("n_fixes"), F.avg(moving.cast("double")).alias("underway_fraction"),
        F.percentile("sog", 0.5).alias("median_sog"), geo.mean_course(F.col("cog")).alias("prevailing_deg"),
        F.count_if(F.col("cog").isNotNull() & (F.col("cog") != 0)).alias("n_course"),
        F.min(F.when(moving, F.col("t_us"))).alias("first_move_us"),
        F.max(F.when(moving, F.col("t_us"))).alias("last_move_us"))


def eligible(norms: DataFrame) -> DataFrame:
    """Moored and sparse vessels carry no behaviour flags."""
    return norms.filter((F.col("n_fixes") >= MIN_FIXES) & (F.col("underway_fraction") >= MIN_UNDERWAY_FRACTION))


def _first_run(r: DataFrame, min_h: float, *carry: str) -> DataFrame:
    hours = (F.col("run_end") - F.col("run_start")) / 3.6e9
    return (r.withColumn("hours", hours).filter(F.col("hours") >= min_h).groupBy("mmsi")
            .agg(F.min_by(F.struct("run_start", "run_end", "hours", *carry), F.col("run_start")).alias("r"))
            .select("mmsi", F.col("r.run_start").alias("start_us"), F.col("r.run_end").alias("end_us"),
                    F.col("r.hours").alias("hours"), *[F.col(f"r.{c}").alias(c) for c in carry]))


def speed_reduction_runs(ais: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """First stretch of at least an hour below 0.45 of the vessel's own median (median > 6 kn)."""
    n = eligible(norms if norms is not None else vessel_norms(ais)).filter("median_sog > 6").select("mmsi", "median_sog")
    rows = ais.select("mmsi", "t_us", "sog").join(n, "mmsi")
    r = runs(rows, ["mmsi"], "t_us", F.col("sog") < F.col("median_sog") * 0.45,
             [F.avg("sog").alias("mean_sog"), F.max("median_sog").alias("median_sog")])
    return _first_run(r, 1.0, "mean_sog", "median_sog")


def course_deviation_runs(ais: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """First stretch of at least 45 minutes more than 60 degrees off the prevailing course."""
    n = (eligible(norms if norms is not None else vessel_norms(ais))
         .filter("n_fixes > 20 and n_course > 0").select("mmsi", "prevailing_deg"))
    rows = ais.select("mmsi", "t_us", "cog").join(n, "mmsi").withColumn(
        "deviation", geo.angle_deviation(F.col("cog"), F.col("prevailing_deg"))).drop("cog", "prevailing_deg")
    r = runs(rows, ["mmsi"], "t_us", F.col("deviation") > 60.0, [F.avg("deviation").alias("mean_deviation")])
    return _first_run(r, 0.75, "mean_deviation")


def _chunk_exits(times: np.ndarray, start: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """For every fix a hop from an earlier chunk can land on: the instant the chain next needs a fix at."""
    nxt = np.searchsorted(times, times + hop)
    need = np.empty(len(times), dtype=np.int64)
    for i in range(len(times) - 1, -1, -1):
        need[i] = times[i] + hop if nxt[i] >= len(times) else need[nxt[i]]
    zone = np.searchsorted(times, start + hop)
    keep = slice(0, min(zone + 1, len(times)))
    return times[keep], need[keep]


def hop_nodes(ais: DataFrame, hop_us: int = HOUR_US, chunk_us: int = TRACK_BUCKET_US) -> DataFrame:
    """Starts of back-to-back windows of at least ``hop_us``: each begins at the first fix a hop after the last.

    The chain depends on every earlier step, yet no task holds a whole track: each (vessel, chunk)
    first reports where every possible entry leaves it, a per-vessel pass over those short tables
    fixes the entry of each chunk, and the chunks then list their own nodes in parallel.
    """
    rows = ais.select("mmsi", "t_us").withColumn("chunk", F.floor(F.col("t_us") / chunk_us))

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["t_us"].to_numpy(np.int64))
        entry, need = _chunk_exits(times, int(pdf["chunk"].iloc[0]) * chunk_us, hop_us)
        return pd.DataFrame({"mmsi": pdf["mmsi"].iloc[0], "chunk": pdf["chunk"].iloc[0], "entry": entry, "need": need})

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        out, want = [], None
        for chunk, g in pdf.sort_values(["chunk", "entry"]).groupby("chunk", sort=True):
            entry, need = g["entry"].to_numpy(), g["need"].to_numpy()
            i = 0 if want is None else int(np.searchsorted(entry, want))
            if i < len(entry):
                out.append((g["mmsi"].iloc[0], chunk, entry[i]))
                want = need[i]
        return pd.DataFrame(out, columns=["mmsi", "chunk", "entry"])

    def nodes(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["t_us"].to_numpy(np.int64))
        i, found = int(np.searchsorted(times, pdf["entry"].iloc[0])), []
        while i < len(times):
            found.append(times[i])
            i = int(np.searchsorted(times, times[i] + hop_us))
        return pd.DataFrame({"mmsi": pdf["mmsi"].iloc[0], "node_us": found})

    table = rows.groupBy("mmsi", "chunk").applyInPandas(exits, "mmsi long, chunk long, entry long, need long")
    starts = table.groupBy("mmsi").applyInPandas(follow, "mmsi long, chunk long, entry long")
    return rows.join(starts, ["mmsi", "chunk"]).groupBy("mmsi", "chunk").applyInPandas(nodes, "mmsi long, node_us long")


def loiter(ais: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """Longest hour-plus window under 2 kn mean and 3 km net, bracketed by movement; ties keep the first."""
    n = eligible(norms if norms is not None else vessel_norms(ais)).select("mmsi", "first_move_us", "last_move_us")
    rows = ais.join(n, "mmsi").select("mmsi", "t_us", "lat", "lon", "sog", "first_move_us", "last_move_us")
    nodes = checkpoint(hop_nodes(rows))  # four readers below; the chain is far shorter than the track
    marked = (rows.join(nodes.withColumnRenamed("node_us", "t_us").withColumn("is_node", F.lit(True)),
                        ["mmsi", "t_us"], "left")
              .withColumn("_bucket", time_bucket("t_us")).withColumn("_mark", F.when(F.col("is_node"), F.col("t_us"))))
    owned = carry_forward(marked, ["mmsi"], ["t_us"], "_mark", "node_us")
    means = owned.groupBy("mmsi", "node_us").agg(F.avg("sog").alias("mean_sog"))
    ends = neighbours(marked.filter("is_node").drop("_bucket"), ["mmsi"], ["t_us"], ["t_us", "lat", "lon"],
                      time_bucket("t_us")).filter("next is not null")
    w = ends.join(means, (ends.mmsi == means.mmsi) & (ends.t_us == means.node_us)).select(
        ends.mmsi, ends.t_us, F.col("next.t_us").alias("end_us"), "mean_sog", ends.lat, ends.lon,
        (geo.segment_m(ends.lat, ends.lon, F.col("next.lat"), F.col("next.lon")) / 1000.0).alias("net_km"),
        "first_move_us", "last_move_us")
    hit = w.filter((F.col("mean_sog") < 2.0) & (F.col("net_km") < 3.0)
                   & (F.col("first_move_us") < F.col("t_us")) & (F.col("last_move_us") >= F.col("end_us")))
    span = F.col("end_us") - F.col("t_us")
    return hit.groupBy("mmsi").agg(
        F.max_by(F.struct(F.col("t_us").alias("start_us"), "end_us", (span / 3.6e9).alias("hours"), "mean_sog", "net_km",
                          "lat", "lon"), F.struct(span, -F.col("t_us"))).alias("b")).select("mmsi", "b.*")


def night_share(ais: DataFrame) -> DataFrame:
    """Share of strided fixes between 20:00 and 03:59 UTC; stride is floor(n / 200)."""
    from driftwake.operators.tracks import decimate

    picked = decimate(ais, 200)
    hour = F.floor(F.col("t_us") / HOUR_US) % 24
    return picked.groupBy("mmsi").agg(
        F.avg(((hour >= 20) | (hour <= 3)).cast("double")).alias("night_share"))


def behaviour_priors(ais: DataFrame, gap_vessels: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Codes and the product of their multipliers per vessel. ``gap_vessels`` (mmsi) carry an AIS_GAP trust flag."""
    p = cfg.priors
    norms = checkpoint(vessel_norms(ais))

    def code(df: DataFrame, name: str, factor: float) -> DataFrame:
        return df.select("mmsi", F.lit(name).alias("code"), F.lit(factor).alias("factor"))

    slow = code(speed_reduction_runs(ais, norms), "SPEED_REDUCTION", p.unexplained_slowdown)
    amplifiers = code(loiter(ais, norms), "LOITERING", p.loitering).unionByName(
        code(course_deviation_runs(ais, norms), "COURSE_DEVIATION", p.course_deviation))
    night = code(night_share(ais).filter("night_share > 0.25").join(amplifiers.select("mmsi").distinct(), "mmsi", "left_semi"),
                 "NIGHT_MANOEUVRING", p.night_manoeuvring)
    gaps = code(gap_vessels, "AIS_GAP", p.ais_gap_in_aoi)
    flags = slow.unionByName(amplifiers).unionByName(night).unionByName(gaps)
    priors = flags.groupBy("mmsi").agg(F.product("factor").alias("behaviour_prior"),
                                       F.array_sort(F.collect_set("code")).alias("codes"))
    return norms.select("mmsi").join(priors, "mmsi", "left").select(
        "mmsi", F.coalesce("behaviour_prior", F.lit(1.0)).alias("behaviour_prior"),
        F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def low_speed_coverage(ais: DataFrame, window_s: int = 3600) -> DataFrame:
    """Relaxed loiter form: mean speed over the hour that starts at each fix, as a range frame in (vessel, bucket).

    Fixes of the hour after a bucket are copied into it, so the frame sees them without a whole-vessel window.
    """
    b = F.floor(F.col("t_us") / TRACK_BUCKET_US)
    rows = ais.select("mmsi", "t_us", "sog")
    reach = F.floor((F.col("t_us") - window_s * 1_000_000) / TRACK_BUCKET_US)
    spread = rows.withColumn("_bucket", F.explode(F.array_distinct(F.array(b, reach)))).withColumn("_own", F.col("_bucket") == b)
    w = Window.partitionBy("mmsi", "_bucket").orderBy("t_us").rangeBetween(0, window_s * 1_000_000)
    return (spread.withColumn("mean_sog", F.avg("sog").over(w)).filter("_own")
            .select("mmsi", "t_us", "mean_sog"))
