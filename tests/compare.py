"""Spark result against SQL twin: same columns, types and rows, in any order.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _family(kind: pa.DataType) -> str:
    return "text" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else str(kind)


def _rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(zip(*columns), key=lambda row: [(v is None, str(type(v)), v if v is not None else 0) for v in row])


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


def differences(left: pa.Table, right: pa.Table) -> list[str]:
    """What differs, in words; an empty list means equal."""
    if sorted(left.column_names) != sorted(right.column_names):
        return [f"columns {sorted(left.column_names)} != {sorted(right.column_names)}"]
    out = [
        f"type of {n}: {left.schema.field(n).type} != {right.schema.field(n).type}"
        for n in left.column_names
        if _family(left.schema.field(n).type) != _family(right.schema.field(n).type)
    ]
    if left.num_rows != right.num_rows:
        return out + [f"rows {left.num_rows} != {right.num_rows}"]
    lrows, rrows = _rows(left), _rows(right)
    bad = [(a, b) for a, b in zip(lrows, rrows) if not all(map(_same, a, b))]
    out += [f"{len(bad)} rows differ, e.g. {a} != {b}" for a, b in bad[:2]]
    inexact = sum(1 for a, b in zip(lrows, rrows) if a != b)
    if inexact and not bad:
        out.append(f"{inexact} rows differ in the last bits")
    return out


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from conftest import local_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    oracle, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            result = query(spark, sf_dir).toArrow()
            seconds = time.time() - start
            twin = con.sql(oracle[name]).to_arrow_table() if name in oracle else None
            problems = differences(result, twin) if twin is not None else ["no SQL twin"]
        except Exception as error:  # report and go on with the next query
            problems, seconds = [str(error)[:500]], time.time() - start
        failed += bool(problems)
        print(f"{'ok  ' if not problems else 'DIFF'} {name} {seconds:.2f}s", *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{failed} not equal")
