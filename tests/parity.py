"""Rows of a Spark query against those of its SQL."""


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


def same(df, cursor) -> None:
    cols = sorted(df.columns)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*cols).collect())
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cursor.fetchall())
    assert got == want
