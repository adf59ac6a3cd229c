"""What the steps of a session's queries count; by execution ids, as a session forgets old executions."""


def values(spark, name: str, run) -> tuple[object, list[int]]:
    """What ``run`` returns, and the values of the metric ``name`` of the steps that it made."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def executions() -> dict:
        bus.waitUntilEmpty()
        rows = store.executionsList(0, 100_000)
        return {rows.apply(k).executionId(): rows.apply(k) for k in range(rows.size())}

    last = max(executions(), default=-1)
    out, found = run(), []
    for k, row in executions().items():
        if k > last:
            steps, counts = row.metrics(), store.executionMetrics(k)
            for m in map(steps.apply, range(steps.size())):
                value = counts.get(m.accumulatorId())
                if m.name() == name and value.isDefined():
                    found.append(int(value.get().replace(",", "")))
    return out, found
