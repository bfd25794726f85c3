import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("WICKERLOOM_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from wickerloom.session import local_session

    s = local_session(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    d = f"{DATA}/sf0.001"
    if not Path(d).exists():
        pytest.skip("no test data")
    return d


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        source = p if p.is_file() else p / "*.parquet"
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def same_rows(got, want):
    """None if two pandas tables hold the same rows under the same columns, else what differs."""
    import math
    from decimal import Decimal

    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"

    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
            return None
        if isinstance(x, Decimal):
            x = float(x)
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)):
            return f"{float(x):.5g}" if isinstance(x, float) and x != int(x) else str(int(x))
        return str(x)

    columns = sorted(got.columns)
    rows = [sorted(tuple(value(x) or "" for x in r) for r in t[columns].itertuples(index=False)) for t in (got, want)]
    if len(rows[0]) != len(rows[1]):
        return f"{len(rows[0])} and {len(rows[1])} rows: {set(rows[0]) ^ set(rows[1])!s:.600}"
    bad = [(a, b) for a, b in zip(*rows) if a != b]
    return f"{len(bad)} rows differ, such as {bad[:3]}" if bad else None
