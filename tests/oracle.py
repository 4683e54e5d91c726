import math
from pathlib import Path

import duckdb


def same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)

    def key(rows):
        plain = lambda x: "null" if x is None else f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x)
        return sorted(tuple(plain(v) for v in r) for r in rows)

    got = key(tuple(r) for r in df.select(*names).collect())
    quoted = ", ".join(f'"{n}"' for n in names)
    assert got == key(want.select(quoted).fetchall())
