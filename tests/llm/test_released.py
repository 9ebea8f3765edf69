import pyarrow as pa

from braidwork import shared
from braidwork.llm import sentencepiece


def test_a_worker_gives_memory_back_at_the_end_of_a_task(monkeypatch):
    """Also when a task ends early or fails; batches pass unchanged."""
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    monkeypatch.setattr(shared.pa, "default_memory_pool", Pool)
    batch = pa.RecordBatch.from_pylist([{"a": 1}])
    run = shared.released(lambda batches: (b for b in batches))
    assert list(run(iter([batch, batch]))) == [batch, batch] and calls == [1]
    early = run(iter([batch, batch]))
    next(early)
    early.close()
    assert calls == [1, 1]


def test_blocks_of_texts_are_small():
    assert sentencepiece.BLOCK_CHARS <= 1 << 20
