"""SQL building blocks for the DuckDB twins of the registered queries.

Each twin states the operator's semantics independently of the Spark code,
over the same driver tables. Double literals carry an exponent so no engine
types them as DECIMAL.
"""

from __future__ import annotations

from ..sources.applicants import APPLICANTS_SQL

NUM = ["x1", "x2", "x3", "x4", "x5", "x6", "x7", "x8", "x10", "x11", "x12"]
CODES = {"x3": None, "x4": None, "x11": -99000720.0, "x12": -99000792.0}
SENT = -9999998.0


def lit(v: float) -> str:
    return f"{float(v)!r}e0" if "e" not in repr(float(v)) else repr(float(v))


def clean_cte() -> str:
    """Generic code nulled in every numeric feature, per-column codes in X11/X12."""
    cols = []
    for c in NUM:
        conds = [f"{c} <> {lit(SENT)}"]
        if CODES.get(c) is not None:
            conds.append(f"{c} <> {lit(CODES[c])}")
        cols.append(f"CASE WHEN {' AND '.join(conds)} THEN {c} END AS {c}")
    return f"clean AS (SELECT id, base, target, x9, {', '.join(cols)} FROM applicants)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join([APPLICANTS_SQL, *ctes]) + "\n"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def hist_bin(x: str, edges: str) -> str:
    """NumPy histogram bin of x among sorted edges (left-closed, last closed), NULL outside."""
    j = f"(CASE WHEN {x} = {edges}[len({edges})] THEN len({edges}) - 2 ELSE len(list_filter({edges}, lambda e: e <= {x})) - 1 END)"
    return f"(CASE WHEN len({edges}) >= 2 AND {j} BETWEEN 0 AND len({edges}) - 2 THEN {j} END)"


def qcut_bucket(x: str, edges: str) -> str:
    """pandas qcut bucket (1-based): 1 + interior edges strictly below x."""
    interior = f"list_slice({edges}, 2, len({edges}) - 1)"
    return f"greatest(1, len(list_filter({interior}, lambda e: e < {x})) + 1)"


def psi_ctes(ref_sql: str, cur_sql: str, by: list[str] | None = None, n_bins: int = 10, prefix: str = "p") -> tuple[list[str], str]:
    """CTEs computing PSI of cur vs ref per feature (and ``by``); returns (ctes, final table name)."""
    by = by or []
    byc = "".join(f", {b}" for b in by)
    probs = ", ".join(lit(i / n_bins) for i in range(n_bins + 1))
    ctes = [
        f"{prefix}_ref AS (SELECT feature, value FROM ({ref_sql}) WHERE value IS NOT NULL)",
        f"{prefix}_cur AS (SELECT feature{byc}, value FROM ({cur_sql}) WHERE value IS NOT NULL)",
        f"{prefix}_edges AS (SELECT feature, count(*) AS n_ref, list_sort(list_distinct(quantile_cont(value, [{probs}]))) AS edges FROM {prefix}_ref GROUP BY feature)",
        f"{prefix}_refc AS (SELECT feature, bin, count(*) AS c_ref FROM (SELECT r.feature, {hist_bin('r.value', 'e.edges')} AS bin FROM {prefix}_ref r JOIN {prefix}_edges e ON r.feature = e.feature) WHERE bin IS NOT NULL GROUP BY feature, bin)",
        f"{prefix}_curb AS (SELECT c.feature{''.join(f', c.{b}' for b in by)}, {hist_bin('c.value', 'e.edges')} AS bin FROM {prefix}_cur c JOIN {prefix}_edges e ON c.feature = e.feature)",
        f"{prefix}_curt AS (SELECT feature{byc}, count(*) AS n_cur FROM {prefix}_curb GROUP BY feature{byc})",
        f"{prefix}_curc AS (SELECT feature{byc}, bin, count(*) AS c_cur FROM {prefix}_curb WHERE bin IS NOT NULL GROUP BY feature{byc}, bin)",
        f"{prefix}_grid AS (SELECT t.feature{''.join(f', t.{b}' for b in by)}, e.n_ref, t.n_cur, unnest(range(0, len(e.edges) - 1)) AS bin FROM {prefix}_curt t JOIN {prefix}_edges e ON t.feature = e.feature WHERE len(e.edges) >= 2)",
        f"""{prefix}_cells AS (SELECT g.feature{''.join(f', g.{b}' for b in by)}, g.bin,
              CASE WHEN coalesce(r.c_ref, 0) = 0 THEN 1.0e-4 ELSE coalesce(r.c_ref, 0) / g.n_ref END AS e,
              CASE WHEN coalesce(c.c_cur, 0) = 0 THEN 1.0e-4 ELSE coalesce(c.c_cur, 0) / g.n_cur END AS a
            FROM {prefix}_grid g
            LEFT JOIN {prefix}_refc r ON g.feature = r.feature AND g.bin = r.bin
            LEFT JOIN {prefix}_curc c ON g.feature = c.feature{''.join(f' AND g.{b} = c.{b}' for b in by)} AND g.bin = c.bin)""",
        f"{prefix}_sums AS (SELECT feature{byc}, sum((a - e) * ln(a / e)) AS s, count(*) AS nb FROM {prefix}_cells GROUP BY feature{byc})",
        f"""{prefix}_psi AS (SELECT t.feature{''.join(f', t.{b}' for b in by)}, round(coalesce(s.s, 0.0e0), 4) AS psi, coalesce(s.nb, 0) AS n_bins_used
            FROM {prefix}_curt t LEFT JOIN {prefix}_sums s ON t.feature = s.feature{''.join(f' AND t.{b} = s.{b}' for b in by)})""",
    ]
    return ctes, f"{prefix}_psi"


def psi_status(p: str = "psi") -> str:
    return f"CASE WHEN {p} < 0.1e0 THEN 'OK' WHEN {p} < 0.25e0 THEN 'ADVERTENCIA' ELSE 'ALERTA' END"


def unpivot_sql(table: str, cols: list[str], ids: list[str] | None = None, where: str = "") -> str:
    ids = ids or []
    idc = "".join(f"{i}, " for i in ids)
    w = f" WHERE {where}" if where else ""
    return union_all([f"SELECT {idc}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {table}{w}" for c in cols])


def sig_round(x: str, digits: int = 10) -> str:
    e = f"floor(log10(abs({x})))"
    return f"(CASE WHEN {x} = 0 THEN 0.0e0 ELSE round({x} / pow(10.0e0, {e}), {digits - 1}) * pow(10.0e0, {e}) END)"
