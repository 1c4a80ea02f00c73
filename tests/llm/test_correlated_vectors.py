"""Lone links among vectors that are all alike."""

import numpy as np

from locusloom.llm import embedding_dedup


def test_lone_links_of_a_correlated_label_are_found(spark):
    random_ = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, d, pairs = 3000, 64, 300
    centre = unit(random_.normal(size=d))
    x = unit(np.sqrt(0.8) * centre + np.sqrt(0.2) * unit(random_.normal(size=(n, d))))
    side = random_.normal(size=(pairs, d))
    side = unit(side - (side * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    x = np.concatenate([x, 0.934 * x[:pairs] + np.sqrt(1 - 0.934**2) * side])
    frame = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    settings = embedding_dedup.Settings(window=8, block=128)
    found = {r["vec_id"]: r["component_id"] for r in embedding_dedup.dedup(frame, settings).collect()}
    lost = sum(found[k] != found[n + k] for k in range(pairs))
    assert len(found) == n + pairs and lost <= 2, lost
