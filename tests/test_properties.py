"""Property test of the ranking core: random values with heavy ties and NULLs."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riskframe.operators.prefix import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60),
    groups=st.integers(1, 3),
)
def test_quantiles_any_input(spark, values, groups):
    pdf = pd.DataFrame({"g": [i % groups for i in range(len(values))], "v": values})
    df = spark.createDataFrame(pdf, "g int, v double")
    exp = pdf.dropna().groupby("g")["v"].quantile(PROBS).unstack() if pdf["v"].notna().any() else None
    got = exact_quantiles(df, "v", PROBS, within=["g"]).toPandas().set_index("g").sort_index()
    if exp is None:
        assert got.empty
        return
    assert list(got.index) == list(exp.index)
    for i, p in enumerate(PROBS):
        np.testing.assert_allclose(got[f"q{i}"].to_numpy(), exp[p].to_numpy(), rtol=1e-12, atol=1e-9)
