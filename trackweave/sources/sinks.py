"""Writers: tables, CSV, JSON and text reports, run history."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_csv(tracks: DataFrame, points: DataFrame, folder: str) -> None:
    """Headers of all tracks, and all points with the track's number and place."""
    tracks.drop("lines").write.mode("overwrite").csv(f"{folder}/all_tracks_info", header=True)
    points.join(tracks.select("track_id", F.col("opnum").alias("track_opnum"), F.col("load_seq").alias("track_idx")), "track_id").write.mode("overwrite").csv(f"{folder}/all_track_points", header=True)


def cluster_rows(visible: DataFrame, workload: DataFrame, anomalies: DataFrame, risk: DataFrame, overall: DataFrame) -> DataFrame:
    """cluster_id, size, runway, anomalies, risks, workload, risk_level of the visible clusters; zeros and NONE where nothing is known.

    ``visible`` has cluster_id, size, runway; ``anomalies`` cluster_id, anomalies; ``risk`` cluster_id, risks; ``overall`` cluster_id, level.
    """
    out = visible.select("cluster_id", "size", "runway").join(workload.select("cluster_id", "workload"), "cluster_id", "left").join(anomalies.select("cluster_id", "anomalies"), "cluster_id", "left")
    out = out.join(risk.select("cluster_id", "risks"), "cluster_id", "left").join(overall.select("cluster_id", F.col("level").alias("risk_level")), "cluster_id", "left")
    return out.fillna(0, ["anomalies", "risks"]).fillna(0.0, ["workload"]).fillna("NONE", ["risk_level"]).select("cluster_id", "size", "runway", "anomalies", "risks", "workload", "risk_level")


def write_cluster_csv(rows: DataFrame, path: str) -> None:
    """Semicolons, a byte order mark before the first name, quoted where needed, with the index as text for spreadsheets."""
    text = rows.withColumn("workload", F.concat(F.lit('="'), F.format_string("%.1f", "workload"), F.lit('"')))
    text.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0]).write.mode("overwrite").option("sep", ";").option("escape", '"').csv(path, header=True)


def runway_lines(summary: DataFrame) -> DataFrame:
    """(place, line): totals of all runways, then a line for each."""
    one = summary.select(F.col("runway").alias("place"), F.format_string("Runway %s: arrivals %d, busiest hour %d, use %.0f%%, violations %d, mean delay %.0f s", "runway", "arrivals", "landings_per_hour", F.col("utilization") * 100, "violations", "mean_delay").alias("line"))
    every = summary.agg(F.sum("arrivals").alias("a"), F.sum("violations").alias("v"), F.sum("total_delay").alias("d"))
    return every.select(F.lit("").alias("place"), F.format_string("Arrivals %d, violations %d, delay %.0f s", "a", "v", "d").alias("line")).unionByName(one)


def algorithm_lines(compared: DataFrame) -> DataFrame:
    """(place, line): a line for each algorithm, with its error if it failed."""
    failed = F.format_string("%s: error: %s", "algorithm", "error")
    said = F.format_string("%s: clusters %d, tracks %d, quality %.1f%%", "algorithm", "clusters", "tracks", F.col("quality") * 100)
    return compared.select(F.col("algorithm").alias("place"), F.when(F.col("error").isNotNull(), failed).otherwise(said).alias("line"))


def cluster_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.format_string("%010d", "cluster_id").alias("place"), F.format_string("Cluster %d: tracks %d, runway %s, anomalies %d, risks %d, W=%.1f, risk %s", "cluster_id", "size", "runway", "anomalies", "risks", "workload", "risk_level").alias("line"))


def anomaly_lines(found: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` highest scores of each cluster."""
    top = found.withColumn("__r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("score"), "track_id"))).where(F.col("__r") <= most)
    return top.select(F.format_string("%010d/%03d", "cluster_id", "__r").alias("place"), F.format_string("Cluster %d, track %s: score %.2f%%, level %s", "cluster_id", F.col("track_id").cast("string"), F.col("score") * 100, "level").alias("line"))


def full_report(statistics: DataFrame, runways: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """(section, place, line): the six sections of the report: totals, load, anomalies and risks, runways, clusters, top anomalies.

    ``statistics`` is one row with clusters, tracks, conflicts, max_workload, anomalies, risks, risky_tracks.
    """
    said = {
        1: F.format_string("Tracks %d, clusters %d", "tracks", "clusters"),
        2: F.format_string("Largest workload %.1f, conflicts %d", "max_workload", "conflicts"),
        3: F.format_string("Anomalies %d (%.1f%%), rule risks %d on %d tracks", "anomalies", F.col("anomalies") * 100 / F.greatest(F.lit(1), "tracks"), "risks", "risky_tracks"),
    }
    out = statistics.select(F.inline(F.array(*(F.struct(F.lit(k).alias("section"), F.lit("").alias("place"), line.alias("line")) for k, line in said.items()))))
    for k, lines in ((4, runway_lines(runways)), (5, cluster_lines(rows)), (6, anomaly_lines(found))):
        out = out.unionByName(lines.select(F.lit(k).alias("section"), "place", "line"))
    return out


def conclusions(statistics: DataFrame, runways: DataFrame, what_if: DataFrame) -> DataFrame:
    """(place, line): the six closing lines of the report, of the statistics of ``full_report``, the runways' summary and the what-if's
    differences."""
    change = what_if.agg(*(F.max(F.when(F.col("measure") == m, F.col("delta"))).alias(f"d_{m}") for m in ("max_workload", "conflicts")))
    use = runways.agg(F.sum("arrivals").alias("arrivals"), F.sum("violations").alias("violations"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("overloaded"), F.col("runway")))), ", ").alias("full"))
    row = statistics.crossJoin(use).crossJoin(change)
    lines = [
        F.format_string("%d tracks processed; %d bundles and as many sectors found.", "tracks", "clusters"),
        F.format_string("Largest workload W = %.1f; conflict events: %d.", "max_workload", "conflicts"),
        F.format_string("%d anomalies (%.1f%% of the analysed tracks).", "anomalies", F.col("anomalies") * 100 / F.greatest(F.lit(1), "tracks")),
        F.format_string("%d risks by strict criteria on %d tracks.", "risks", "risky_tracks"),
        F.format_string("Runways: %d arrivals, %d spacing violations, overloaded: %s.", "arrivals", "violations", F.when(F.col("full") == "", "none").otherwise(F.col("full"))),
        F.format_string("The what-if scenario changes the largest workload by %.1f and the conflicts by %.0f.", "d_max_workload", "d_conflicts"),
    ]
    return row.select(F.inline(F.array(*(F.struct(F.lit(k).alias("place"), line.alias("line")) for k, line in enumerate(lines, 1)))))


def upsert(current: DataFrame, new: DataFrame, key: str = "track_id") -> DataFrame:
    """Rows of both; of a key that both have, the new row."""
    both = current.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__new")))).where("__r = 1").drop("__r", "__new")


def json_report(timestamp: str, kind: str, **tables: DataFrame) -> DataFrame:
    """One row ``report``: a JSON text of small result tables; each is checked to have 1000 rows at most."""
    out = None
    for name, frame in tables.items():
        packed = frame.limit(1001).agg(F.collect_list(F.struct(*frame.columns)).alias(name))
        packed = packed.withColumn(name, F.when(F.size(name) <= 1000, F.col(name)).otherwise(F.raise_error(F.lit(f"{name} has more than 1000 rows"))))
        out = packed if out is None else out.crossJoin(packed)
    results = F.struct(*tables)
    return out.select(F.to_json(F.struct(F.lit(timestamp).alias("timestamp"), F.lit(kind).alias("report_type"), results.alias("results"))).alias("report"))


def text_report(report: DataFrame) -> str:
    """The sections of a JSON report as lines of text."""
    data = json.loads(report.first().report)
    lines = [f"Report {data['report_type']} of {data['timestamp']}"]
    for name, rows in data["results"].items():
        lines += ["", name.replace("_", " ").upper()] + ["  " + ", ".join(f"{k}={v}" for k, v in row.items()) for row in rows]
    return "\n".join(lines)


def top_per_group(rows: DataFrame, group: str, *order: Column, most: int = 5) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def history(runs: DataFrame, most: int = 20) -> DataFrame:
    """The newest ``most`` runs, newest first."""
    return runs.orderBy(F.desc("timestamp")).limit(most)


def top_risk_types(risk: DataFrame, most: int = 5) -> DataFrame:
    return risk.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(most)
