"""Run registered queries in Spark and their oracles in DuckDB and compare row sets."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from driftwake.plans.fixtures import RAW_TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v) if not isinstance(v, int) or isinstance(v, bool) else str(v)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first differences."""
    cols = sorted(df.columns)
    con.execute(sql)
    names = [c[0] for c in con.description]
    types = {c[0]: str(c[1]) for c in con.description}
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    theirs = Counter(tuple(_norm(r[i]) for i in order) for r in con.fetchall())
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    bad = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t, t) != types[c]]
    ours = Counter(tuple(_norm(v) for v in r) for r in df.select(*cols).collect())
    if bad:
        return f"types {bad}"
    if ours != theirs:
        a, b = ours - theirs, theirs - ours
        return (f"rows {sum(ours.values())} vs {sum(theirs.values())}, {sum(a.values())} only here, {sum(b.values())} only there; "
                f"{cols}\n   here  {sorted(a)[:2]}\n   there {sorted(b)[:2]}")
    return None if ours else "EMPTY result on both sides"


def main(sf_dir: str, names: list[str]) -> int:
    from driftwake.plans import catalog
    from driftwake.session import local_session

    spark, con, failed = local_session(8), duck(sf_dir), 0
    plans, oracles = catalog.queries(), catalog.oracle_sql()
    for name in names or plans:
        t0 = time.time()
        try:
            if name in oracles:
                msg = compare(plans[name](spark, sf_dir), con, oracles[name])
            else:
                n = plans[name](spark, sf_dir).count()
                msg = None if n else "EMPTY"
                name += " (rows only)"
        except Exception as exc:  # noqa: BLE001
            msg = f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {time.time() - t0:.1f}s {msg or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
