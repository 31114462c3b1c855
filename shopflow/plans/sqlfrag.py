"""Small SQL text helpers for the oracle."""


def r6(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias}"


def d(expr: str, alias: str) -> str:
    return f"CAST({expr} AS DOUBLE) AS {alias}"


def big(expr: str, alias: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {alias}"
