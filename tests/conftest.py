import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

import pytest  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    s = session(
        "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def norm(df):
    """Rows as sorted tuples of texts, columns by name."""
    cols = sorted(df.columns)

    def text(v):
        if v is None or str(v) in ("nan", "NaT", "<NA>"):
            return "None"
        if hasattr(v, "tolist"):
            v = v.tolist()
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return cols, sorted(tuple(text(v) for v in r) for r in df[cols].astype(object).values.tolist())


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    def check(query, sql):
        a, b = norm(query(spark, sf).toPandas()), norm(duck.sql(sql).df())
        assert a[0] == b[0]
        as_numbers = lambda rows: [tuple(x.removesuffix(".0") for x in r) for r in rows]
        assert sorted(as_numbers(a[1])) == sorted(as_numbers(b[1]))

    return check
