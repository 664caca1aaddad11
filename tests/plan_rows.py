"""Rows that the steps of a finished query made."""


def most_rows(df) -> int:
    """Collect ``df``; the most rows that any node of its plan put out."""
    df.collect()

    def walk(plan) -> int:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        rows = plan.metrics().get("numOutputRows")
        children = plan.children()
        return max([rows.get().value() if rows.isDefined() else 0, *(walk(children.apply(i)) for i in range(children.size()))])

    return walk(df._jdf.queryExecution().executedPlan())
