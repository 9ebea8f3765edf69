from braidwork.llm import langid


def test_every_language_is_sampled(spark):
    rows = [(k, f"text {k}", f"l{k % 90}") for k in range(270)] + [(999, "no label", None)]
    found, weights = langid.sample(spark.createDataFrame(rows, "key long, text string, lang string"), 5)
    assert {lang for _, lang in found} == {f"l{k}" for k in range(90)} and len(weights) == len(found)
    assert langid.sample(spark.createDataFrame([], "key long, text string, lang string"), 5) == ([], [])


def test_whole_texts_are_taught(spark):
    text = "".join(chr(97 + k % 26) for k in range(1000))
    found, weights = langid.sample(spark.createDataFrame([(1, text, "x")], "key long, text string, lang string"), 5)
    assert b"".join(p for p, _ in found).decode() == text and abs(sum(weights) - 1) < 1e-9


def test_layers_end_where_no_core_step_follows():
    """Steps of the core come out as they do from whole windows, and as step() gives them."""
    import numpy as np

    from braidwork.llm.langid import PAD, Network

    network, x = Network.fresh(["a", "b"], 4), np.random.default_rng(3).integers(0, PAD + 1, (9, 5)).astype(np.int16)
    whole = network.distributions(x)
    assert np.array_equal(network.distributions(x, slice(2, 6)), whole[2:6])
    state = np.zeros((4, 5), np.float32)
    for t, found in network.forward.states(x, range(9)):
        state = network.forward.step(x[t], state)[0]
        assert np.array_equal(found, state)
