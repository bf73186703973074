"""Quality audit jobs: label sensitivity and the full set of audit tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.operators import audit, panel
from zonecast.operators.contracts import check_conservation, check_counts, check_volume_series, require, stack
from zonecast.operators.folds import Fold, utc_midnight
from zonecast.operators.forecasts import baseline_table
from zonecast.operators.scores import pooled_scores
from zonecast.operators.temporal import make_features
from zonecast.session import cut_lineage
from zonecast.settings import BASELINES
from zonecast.sources.tables import window_of


def label_sensitivity(
    recorded: DataFrame, alternative: DataFrame, train_start: str, validation_start: str, test_start: str
) -> DataFrame:
    """Baseline scores with recorded and with deduplicated labels, features rebuilt for each."""
    split = [
        Fold("split", utc_midnight(train_start), utc_midnight(validation_start), utc_midnight(test_start))
    ]
    parts = []
    for policy, labels in (("recorded_counts", recorded), ("exact_dedup_scenario", alternative)):
        known = window_of(labels, split[0].train_start, split[0].validation_end)
        table = baseline_table(make_features(known), split, warmup_hours=0)
        parts.append(table.withColumn("policy", F.lit(policy)))
    return pooled_scores(parts[0].unionByName(parts[1]), list(BASELINES), ["policy"])


def audit_tables(trips: DataFrame, zones: DataFrame, start: str, sealed: str, **rule) -> dict[str, DataFrame]:
    """All audit tables of a development window, after the contracts hold.

    Raw trips are read twice: for counts per zone, hour and vendor, and for duplicates. Both are cut from their
    lineage, so that every check and table starts from them.
    """
    kept = panel.eligible_trips(trips, zones, start, sealed)
    cells = cut_lineage(audit.trip_cells(kept))
    counts = panel.utc_counts(cells.groupBy("zone_id", "hour").agg(F.sum("demand").alias("demand")))
    labels = panel.attach_zone(panel.densify(counts, zones, start, sealed), zones)
    require(
        stack(
            check_counts(counts, zones, utc_midnight(start), utc_midnight(sealed)),
            check_conservation(counts, labels),
        )
    )
    repeated = cut_lineage(audit.duplicate_rollup(audit.exact_duplicates(kept)))
    city = audit.city_totals(labels)
    vendors = audit.resolved(cells.groupBy("vendor", "hour").agg(F.sum("demand").alias("demand")))
    require(check_conservation(vendors, city))
    series = audit.series_grid(vendors, city, start, sealed)
    require(check_volume_series(series))
    flags = audit.reporting_volume_flags(series, **rule)
    alternative = audit.dedup_panel(labels, repeated)
    return {
        "reporting_volumes": flags,
        "flagged_hours": audit.flagged_hours(flags),
        "exact_dedup_scenario": alternative,
        "duplicates_by_month": audit.duplicates_by_month(counts, repeated),
        "duplicates_by_zone": audit.duplicates_by_zone(alternative),
        "series_summary": audit.series_summary(flags),
        "duplicate_share": audit.duplicate_share(alternative),
    }
