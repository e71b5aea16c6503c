"""A mix says what its weights ask for and what its rates reach."""

import numpy as np

from tidemark.llm import mixing
from tidemark.sources.stage import clear_stages


def test_mix_reports_wanted_and_reached(spark):
    docs = spark.createDataFrame([(i, f"good fine text {i}" if i % 2 else f"bad words here {i}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "high" if i % 2 else "low") for i in range(80)], "doc_id long, domain string")
    weights = {"high": 1.0, "low": 0.0}  # posteriors are never 0 or 1, so no rates give this
    out = mixing.mix(docs, labels, weights).collect()
    clear_stages(spark)
    tokens = np.array([[x.n_tokens * p * x.rate for p in x.posteriors] for x in out]).sum(axis=0)
    for x in out:
        assert np.allclose(x.wanted, [320.0, 0.0], atol=0.01) and np.allclose(x.reached, tokens, atol=0.05)
    assert out[0].reached[1] > 0
