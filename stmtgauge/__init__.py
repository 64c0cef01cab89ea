"""Query-log and data-quality analytics on Spark: DataFrames and streams in, DataFrames out."""

from stmtgauge.operators.correct import (
    apply_thresholds,
    cell_corrections,
    corrected_statements,
    oversized_rewrites,
    sniff_counters,
    statement_decisions,
    statement_outcomes,
)
from stmtgauge.operators.decisions import (
    counter_increments,
    counters,
    counts_by_rule,
    day_dashboard,
    evaluate,
    recent_decisions,
    rule_counters,
    samples_by_rule,
    tail,
    totals_by_action,
)
from stmtgauge.operators.metrics import histogram, rate, windowed_quantile
from stmtgauge.operators.normalize import normalize_as, normalize_columns, suggest_kind, suggest_normalizations
from stmtgauge.operators.packets import decode_packets, reassemble_messages
from stmtgauge.operators.policy import (
    admit_rules,
    decide,
    lookup_rules,
    snapshot_diff,
    suggest_rules,
    validate_rules,
)
from stmtgauge.operators.profiles import field_profiles, merge_profiles, null_drift, select_usage
from stmtgauge.operators.rpc import call_outcomes, fixed_width_corrections, param_decisions, param_types
from stmtgauge.operators.shred import (
    bulk_loads,
    merges,
    multirow_values,
    profiled_columns,
    profiled_values,
    rpc_params,
    selects,
    written_columns,
    written_values,
)
from stmtgauge.plans.reports import (
    daily_report,
    dryrun_report,
    evaluation_report,
    insight_context,
    profile_context,
    profile_summary,
)
from stmtgauge.sources.decisions import append_decisions, read_decisions, read_decisions_of, read_last_decisions
from stmtgauge.sources.events import (
    read_event_xml,
    read_policy_events,
    read_query_events,
    sink_query_events,
    without_repeats,
    write_query_events,
)
from stmtgauge.sources.profiles import (
    read_bucketed_snapshot,
    read_profiles_json,
    read_snapshot,
    write_bucketed_snapshot,
    write_snapshot,
)
from stmtgauge.sources.reports import write_report
from stmtgauge.sources.rules import read_param_types, read_raw_rules, read_rules
from stmtgauge.streaming.jobs import (
    decisions_of_their_time,
    profile_batches,
    run_incremental,
    stream_counters,
    stream_decisions,
    stream_quantile,
    stream_rate,
)
from stmtgauge.streaming.stateful import stream_gates, stream_messages

__all__ = [name for name in dir() if not name.startswith("_")]
