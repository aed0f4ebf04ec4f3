"""Explainable risk of a change: ten weighted components and their sum."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.functions.scalar import is_core_path, risk_level


@dataclass(frozen=True)
class RiskWeights:
    """Factor weights, and below each the weights of its parts."""

    # Fixed values.
    impact_radius: float = 0.30
    change_nature: float = 0.25
    historical_hotspot: float = 0.25
    coupling_risk: float = 0.20
    blast: float = 0.60
    in_degree: float = 0.40
    file_count: float = 0.15
    line_count: float = 0.25
    api_change: float = 0.35
    core_path: float = 0.25
    bug_rate: float = 0.40
    churn: float = 0.30
    co_change: float = 0.30
    betweenness: float = 0.40
    cycle: float = 0.30
    fan: float = 0.30

    @classmethod
    def from_dict(cls, given: dict) -> RiskWeights:
        names = {f.name for f in fields(cls)}
        return cls(**{k: float(v) for k, v in given.items() if k in names})

    def to_dict(self) -> dict[str, float]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def risk_components(changed: DataFrame, involved: DataFrame, nodes: DataFrame, degree: DataFrame, central: DataFrame, blast: DataFrame, hotspots: DataFrame | None = None, cycles: DataFrame | None = None, symbols: DataFrame | None = None, weights: RiskWeights = RiskWeights(), lines: int | None = None) -> DataFrame:
    """(name, weight, raw_value, normalized_value, contribution): ten rows that sum up to the score.

    changed, involved and nodes have id; degree and central are by id; blast
    is one row with blast_radius in percent; symbols (path, change_type,
    start_line, end_line) are the changed symbols; cycles (nodes) the cycles
    of the graph.
    """
    w = weights
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    files = changed.agg(F.count(F.lit(1)).alias("files"), F.count_if(is_core_path(F.col("id"))).alias("core"))
    known = involved.join(degree, "id")
    links = known.agg(F.coalesce(F.max("in_degree"), F.lit(0)).alias("max_in"), F.coalesce(F.avg(F.when(F.col("in_degree") + F.col("out_degree") > 0, F.col("out_degree") / (F.col("in_degree") + F.col("out_degree")))), F.lit(0.0)).alias("fan"))
    middle = involved.join(central, "id").agg(F.coalesce(F.avg("betweenness"), F.lit(0.0)).alias("betweenness"))
    one = n.crossJoin(files).crossJoin(links).crossJoin(middle).crossJoin(blast.select("blast_radius"))
    if hotspots is None:
        one = one.withColumn("hot", F.lit(0.0))
    else:
        score = F.least(2 * F.col("bug_fix_rate"), F.lit(1.0)) * w.bug_rate + F.least(F.col("churn_frequency") / 3, F.lit(1.0)) * w.churn + F.least(F.col("co_change_count") / 10, F.lit(1.0)) * w.co_change
        one = one.crossJoin(changed.join(hotspots.withColumnRenamed("path", "id"), "id").agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("hot")))
    if cycles is None:
        one = one.withColumns({"cycles": F.lit(0), "on_cycles": F.lit(0)})
    else:
        near = cycles.select(F.array_join("nodes", "\n").alias("c"), F.explode("nodes").alias("id")).join(involved.select("id").distinct(), "id", "left_semi")
        one = one.crossJoin(near.agg(F.count_distinct("c").alias("cycles"), F.count_distinct("id").alias("on_cycles")))
    if symbols is None:
        one = one.withColumns({"signature": F.lit(0), "body": F.lit(0), "symbols": F.lit(0), "length": F.lit(0)})
    else:
        one = one.crossJoin(symbols.agg(F.count_if(F.expr("lower(change_type) = 'signature'")).alias("signature"), F.count_if(F.expr("lower(change_type) = 'body'")).alias("body"), F.count(F.lit(1)).alias("symbols"), F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1), F.lit(0)).alias("length")))
    length = F.col("length") if lines is None else F.lit(lines)
    cap = lambda x: F.least(x, F.lit(1.0))
    api = F.when(F.col("signature") > 0, cap(F.col("signature") / F.col("symbols") + 0.3)).when(F.col("body") > 0, 0.3).otherwise(0.0)
    share = F.col("max_in") / F.greatest("n", F.lit(1))
    parts = [
        ("impact_radius.blast", w.impact_radius * w.blast, F.col("blast_radius"), cap(F.col("blast_radius") / 100)),
        ("impact_radius.in_degree", w.impact_radius * w.in_degree, F.col("max_in"), share),
        ("change_nature.file_count", w.change_nature * w.file_count, F.col("files"), cap(F.col("files") / 20)),
        ("change_nature.line_count", w.change_nature * w.line_count, length, cap(length / 500)),
        ("change_nature.api_change", w.change_nature * w.api_change, F.col("signature"), api),
        ("change_nature.core_path", w.change_nature * w.core_path, F.col("core"), F.col("core") / F.greatest("files", F.lit(1))),
        ("historical_hotspot", w.historical_hotspot, F.col("hot"), F.col("hot")),
        ("coupling_risk.betweenness", w.coupling_risk * w.betweenness, F.col("betweenness"), F.col("betweenness")),
        ("coupling_risk.cycle_participation", w.coupling_risk * w.cycle, F.col("cycles"), cap(F.col("cycles") / 10 * 0.5 + F.col("on_cycles") / F.greatest("n", F.lit(1)) * 0.5)),
        ("coupling_risk.fan_ratio", w.coupling_risk * w.fan, F.col("fan"), F.col("fan")),
    ]
    rows = [F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight"), raw.cast("double").alias("raw_value"), value.cast("double").alias("normalized_value"), (value * weight).cast("double").alias("contribution")) for name, weight, raw, value in parts]
    return one.select(F.inline(F.array(*rows)))


def risk_total(components: DataFrame, high: float = 70, medium: float = 30) -> DataFrame:
    """One row: score as a fraction, score_100, level by score_100, level_raw by the fraction, and the four largest components."""
    total = components.agg(F.sum("contribution").alias("score"), F.slice(F.sort_array(F.collect_list(F.struct(F.round("contribution", 6).alias("c"), "name")), asc=False), 1, 4).alias("top"))
    top = F.array_join(F.transform("top", lambda x: x["name"]), ", ").alias("explanation")
    return total.select("score", (F.col("score") * 100).alias("score_100"), risk_level(F.col("score") * 100, high, medium).alias("level"), risk_level(F.col("score"), high, medium).alias("level_raw"), top)
