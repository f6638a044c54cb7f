"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame) -> list:
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con
