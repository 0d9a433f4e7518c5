"""Shared by the core tests."""

DATA = "/root/testdata/sf0.001"


def same_rows(df, table) -> bool:
    names = sorted(table.column_names)
    assert sorted(df.columns) == names
    return sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, zip(*[table[n].to_pylist() for n in names], strict=True)))
