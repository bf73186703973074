"""Shared pieces of the DuckDB check queries."""

import re

SQL: dict[str, str] = {}
CTES: dict[str, str] = {}

NY = "America/New_York"


def utc(t):
    return f"(({t}) AT TIME ZONE '{NY}' AT TIME ZONE 'UTC')"


def local(u):
    return f"(({u}) AT TIME ZONE 'UTC' AT TIME ZONE '{NY}')"


def strict(t):
    u = utc(t)
    hour = "INTERVAL 1 HOUR"
    return (
        f"(CASE WHEN {local(u)} = ({t}) AND {local(u + ' + ' + hour)} <> ({t}) "
        f"AND {local(u + ' - ' + hour)} <> ({t}) THEN {u} END)"
    )


def r(x):
    return f"(round(({x})::DOUBLE + 2e-10::DOUBLE, 6) + 0.0::DOUBLE)"


def cte(name, body):
    CTES[name] = body


def needs(text):
    """CTE names used in a piece of SQL, in definition order."""
    words = set(re.findall(r"[a-z_0-9]+", text))
    return [name for name in CTES if name in words]


def full(body):
    """The body behind exactly the CTEs it needs."""
    wanted, todo = set(), [body]
    while todo:
        for name in needs(todo.pop()):
            if name not in wanted:
                wanted.add(name)
                todo.append(CTES[name])
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in wanted)
    return f"WITH {parts}\n{body}" if parts else body


def check(name, body):
    SQL[name] = full(body)


def checks(*pairs):
    """Rows of a check table from (name, count query) pairs."""
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS \"check\", coalesce(({sql}), 0)::BIGINT AS bad_rows" for name, sql in pairs
    )
