"""Each engine query against its SQL."""

import pytest

from coppice import queries as engine

#: Slow composites run in the driver's gate; here a spread of operators.
NAMES = [n for n in engine.ORACLE if not n.startswith(("grad_", "loss_", "init_", "metric_m", "te_multi", "src_"))]


def rows(df):
    cols = sorted(df.columns)
    plain = df[cols].astype(object).where(df[cols].notna(), None)
    shown = (tuple(round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else x if x is None else str(x) for x in r) for r in plain.itertuples(index=False))
    return sorted(shown, key=lambda r: [(x is None, isinstance(x, str), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf, duck, name):
    got, want = engine.QUERIES[name](spark, sf).toPandas(), duck.sql(engine.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
