"""Helpers of the tests."""

SF = "/root/testdata/sf0.001"


def rows_of(df):
    """Rows as sorted reprs, columns by name."""
    names = sorted(df.columns)
    return names, sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


def same(df, duck, sql):
    found = duck.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    want = sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())
    assert rows_of(df) == (sorted(found.columns), want)
