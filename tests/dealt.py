"""What a collected frame dealt, from the metrics of its plan."""


def records_dealt(df, by=""):
    """Records that the exchanges on keys named ``by`` (all of them, if none are named) of a collected frame wrote."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind in ("ReusedExchangeExec", "AdaptiveSparkPlanExec"):
            return walk(node.executedPlan()) if kind.startswith("Adaptive") else 0
        below = sum(walk(node.children().apply(i)) for i in range(node.children().size()))
        own = kind == "ShuffleExchangeExec" and by in node.outputPartitioning().toString()
        return below + (node.metrics().apply("shuffleRecordsWritten").value() if own else 0)

    return walk(df._jdf.queryExecution().executedPlan())
