"""Pieces of SQL the oracles are put together from."""

from __future__ import annotations


def condition(query: dict, connector: str = "AND", null_safe: bool = False) -> str:
    """One query as a boolean expression, written from its definition."""
    terms = []
    for col, val in query.items():
        if val is None:
            terms.append(f"{col} IS NULL" if null_safe else "FALSE")
        else:
            terms.append(f"{col} = {val}")
    return f" {connector} ".join(terms)


def case_sum(queries: list[dict], connector: str = "AND", null_safe: bool = False) -> str:
    """Number of queries selecting a row."""
    return " + ".join(f"CASE WHEN {condition(q, connector, null_safe)} THEN 1 ELSE 0 END" for q in queries)


def uniform(*parts: str | int) -> str:
    text = ", ".join(str(p) for p in parts)
    return (f"((('0x' || substr(md5(concat_ws('|', {text})), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE)"
            " / 4294967296::DOUBLE)")


def normal(*parts: str | int) -> str:
    return (f"(sqrt(-2::DOUBLE * ln({uniform(*parts, chr(39) + 'radius' + chr(39))}))"
            f" * cos(6.283185307179586::DOUBLE * {uniform(*parts, chr(39) + 'angle' + chr(39))}))")


def constant(stats: str, *key: str | int) -> str:
    """A sampled constant from the columns of the statistics row ``stats``."""
    drawn = f"{stats}.mean + {stats}.std * {normal(*key)}"
    return f"round_even(greatest(least({drawn}, {stats}.max), {stats}.min), 0)::BIGINT"


def stats(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{c}' AS col, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,"
        f" avg({c}) AS mean, stddev_samp({c}) AS std FROM {table}" for c in cols)


def unit_rows(table: str, id_col: str, cols: list[str], more: str = "", where: str = "") -> str:
    """(id, more, v): a row number, the id and the unit vector as a list."""
    norm = "sqrt(" + " + ".join(f"{c}::DOUBLE * {c}::DOUBLE" for c in cols) + ")"
    parts = ", ".join(f"{c}::DOUBLE / CASE WHEN {norm} = 0 THEN 1e-9::DOUBLE ELSE {norm} END" for c in cols)
    return f"SELECT {id_col} AS id{more}, [{parts}] AS v FROM {table}{where}"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def steps(x: str) -> str:
    """A similarity in whole steps of 1e-9."""
    return f"floor({x} * 1e9::DOUBLE + 0.5::DOUBLE)"
