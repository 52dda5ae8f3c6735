"""Helpers that several test files share."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def explain(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def nodes(plan: str, name: str) -> int:
    """Operators of a formatted plan (its numbered detail lines)."""
    return sum(1 for line in plan.splitlines() if line.startswith("(") and line.split(") ", 1)[-1].startswith(name))
