"""DuckDB SQL of least squares by successive orthogonal columns, one aggregate a column."""

from __future__ import annotations


def least_squares(name: str, source: str, x: list[str], y: str, key: list[str], level: list[str], keep: str = "") -> str:
    """Common table expressions, the last of which are ``<name>`` (key, b1.., n, rss) and
    ``<name>_level`` (key and level columns, level). A constant is absorbed for each value of
    ``key`` and ``level``; there is one fit a value of ``key``. ``source`` holds the columns."""
    k, whole = len(x), " and ".join(f"{c} is not null" for c in [*x, y])
    by = lambda cols: f"partition by {', '.join(cols)}" if cols else ""
    cols = ", ".join([*key, *level]) + ("," if key or level else "")
    keyed = ", ".join(key) + ("," if key else "")
    out = [
        f"{name}_r as (select {cols} " + ", ".join(f"{e}::double as x{i + 1}" for i, e in enumerate(x)) + f", {y}::double as y from {source} where {whole})",
        f"{name}_0 as (select {cols} " + ", ".join(f"{c} - avg({c}) over w as {c}" for c in [*[f"x{i + 1}" for i in range(k)], "y"]) + f" from {name}_r window w as ({by([*key, *level])}))",
    ]
    for i in range(1, k + 1):
        # column i is orthogonal to those before it: take it out of those after it
        share = lambda c, i=i: f"coalesce(sum(x{i} * {c}) over w / nullif(sum(x{i} * x{i}) over w, 0), 0)"
        rest = [f"x{j}" for j in range(i + 1, k + 1)]
        told = "".join(f", {share(c)} as r{i}_{c[1:]}" for c in rest) + f", {share('y')} as c{i}"
        out.append(f"{name}_{i}a as (select *{told} from {name}_{i - 1} window w as ({by(key)}))")
        changed = ", ".join(f"{c} - r{i}_{c[1:]} * x{i} as {c}" for c in rest)
        out.append(f"{name}_{i} as (select * replace ({changed + ', ' if changed else ''}y - c{i} * x{i} as y) from {name}_{i}a)")
    first = ", ".join([*[f"any_value(c{i}) as c{i}" for i in range(1, k + 1)], *[f"any_value(r{i}_{j}) as r{i}_{j}" for i in range(1, k + 1) for j in range(i + 1, k + 1)]])
    group = f" group by {', '.join(key)}" if key else ""
    out.append(f"{name}_c as (select {keyed} {first}, count(*) as n, sum(y * y) as rss from {name}_{k}{group})")
    at = f"{name}_c"
    for i in range(k, 0, -1):
        out.append(f"{name}_b{i} as (select *, c{i}" + "".join(f" - r{i}_{j} * b{j}" for j in range(i + 1, k + 1)) + f" as b{i} from {at})")
        at = f"{name}_b{i}"
    out.append(f"{name} as (select {keyed} " + ", ".join(f"b{i}" for i in range(1, k + 1)) + f", n, rss from {at})")
    using = f"join {name} using ({', '.join(key)})" if key else f"cross join {name}"
    groups = f" group by {', '.join([*key, *level])}" if key or level else ""
    out.append(f"{name}_level as (select {cols} avg(y" + "".join(f" - b{i} * x{i}" for i in range(1, k + 1)) + f") as level, count(*) as n_level from {name}_r {using}{groups})")
    return ",\n".join(out) + keep
