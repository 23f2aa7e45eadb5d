"""History to ranked documentation gaps, end to end."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from colscope.functions.guards import require_empty
from colscope.operators import lineage, ranking, snapshot, usage
from colscope.operators.tokens import distinct_texts
from colscope.plans.stages import staged


@dataclass(frozen=True)
class GapAnalysis:
    """The tables of one analysis. The snapshot and the analysed texts are written stages; the
    rest is lazy over them."""

    classified: DataFrame
    records: DataFrame
    references: DataFrame
    refs: DataFrame
    scoped: DataFrame
    usage: DataFrame
    executions: DataFrame
    coverage: DataFrame
    ranked: DataFrame


def analyse(
    history: DataFrame,
    catalog: DataFrame,
    actors: DataFrame,
    qids: DataFrame,
    *,
    as_of: datetime,
    window_days: int,
    run_id: str,
    weight: float,
) -> GapAnalysis:
    """From the history to the ranking, over two written stages.

    Raise on the guards with ``check`` before trusting the ranking; they are actions, so
    they are left to the caller.
    """
    rows = staged(snapshot.classified(history, actors, as_of, window_days), "snapshot")
    records = snapshot.kept_records(rows)
    texts = staged(lineage.analysed(distinct_texts(records), catalog), "texts")
    references = lineage.query_references(records, texts)
    refs = lineage.column_refs(references)
    scoped = usage.with_scope(records, run_id, qids)
    counted = scoped.where("scope_reason = 'in_scope'")
    used = usage.column_usage(usage.touched_by_text(texts, counted))
    executions = usage.catalog_executions(catalog, used)
    return GapAnalysis(
        classified=rows,
        records=records,
        references=references,
        refs=refs,
        scoped=scoped,
        usage=used,
        executions=executions,
        coverage=usage.coverage(executions),
        ranked=ranking.ranked_gaps(executions, weight),
    )


def check(
    history: DataFrame, analysis: GapAnalysis, catalog: DataFrame, min_parse_rate: float, min_rows: int
) -> None:
    """Fail when the history repeats an id, a gate is crossed or the scope matches nothing."""
    snapshot.require_unique_ids(history)
    gates = snapshot.gates(snapshot.counters(analysis.classified), min_parse_rate, min_rows)
    require_empty(gates.where("NOT passed"), "a snapshot gate is crossed")
    require_empty(usage.scope_errors(analysis.scoped, True), "no query belongs to the scope")
    require_empty(usage.stray_usage(analysis.usage, catalog), "usage of an unknown column")
