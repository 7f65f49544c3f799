"""The whole run; normalizing stages the parsed rows once, the frames that read them are lazy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reference as R
from ..functions.parsing import run_id
from ..operators import anomalies, fill, footprint, ledger, review
from ..operators.materialize import CANONICAL, RULESET, materialize, normalize


@dataclass
class Run:
    records: DataFrame  # normalized, reviewed, not filled
    components: DataFrame  # filled and costed, every column carried
    findings: DataFrame
    events: DataFrame
    resolved: DataFrame | None
    ruleset_version: str
    factor_version: str
    reference_digest: str
    content_hash: str
    created_at: str

    def version(self) -> str:
        return f"{self.ruleset_version}:{self.factor_version}:{self.reference_digest}"

    def run_id(self) -> str:
        spark = self.components.sparkSession
        return spark.range(1).select(run_id(F.lit(self.content_hash), F.lit(self.version()))).first()[0]

    def ledger(self) -> DataFrame:
        return ledger.entries(self.events, self.content_hash, self.version(), self.created_at)

    def canonical(self) -> DataFrame:
        """Canonical rows with their estimate and the lineage of their cells."""
        rows = self.components.withColumn("component_weight_g", F.col("weight_g")).select("id", *CANONICAL, "estimated_kgco2e")
        return rows.join(ledger.lineage(self.events).drop("record_id"), "id", "left")


def empty_input(rows: DataFrame) -> DataFrame:
    """The one finding of a source without rows."""
    one = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(0).cast("bigint").alias("id"), F.lit("source").alias("record_id"))
    return anomalies.emitted(one, [(9, F.lit(True), anomalies.finding(None, "validity", "high", F.lit("the source has no rows")))])


def run(raw: DataFrame, mapping: dict[str, str] | None = None, content_hash: str = "", created_at: str = "", factor_version: str = "v1", approvals: DataFrame | None = None) -> Run:
    """Materialize, normalize, re-apply approvals, fill, cost; anomalies are read before filling."""
    normalized = normalize(materialize(raw, mapping))
    reviewed = review.applied(normalized, approvals) if approvals is not None else normalized
    filled = fill.fill(reviewed)
    costed = footprint.components(filled, factor_version)
    found = [anomalies.emitted(normalized, anomalies.row_checks()[:1]), anomalies.emitted(reviewed, anomalies.row_checks()[1:]), anomalies.duplicates(reviewed), anomalies.distribution(reviewed), fill.fill_findings(filled), footprint.unmapped_findings(costed), empty_input(normalized)]
    events = [ledger.normalize_events(normalized), ledger.fill_events(filled), ledger.footprint_events(costed)]
    if approvals is not None:
        events.insert(1, review.approval_events(reviewed))
    return Run(
        reviewed, costed, reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, events), review.resolved_cells(reviewed) if approvals is not None else None,
        RULESET, factor_version, R.reference_digest(), content_hash, created_at,
    )
