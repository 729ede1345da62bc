"""Blocks of the byte encoder."""

import weakref

import pyarrow as pa

from goodsledger.llm import bpe
from goodsledger.llm.common import ID, TEXT


def test_a_block_is_gone_when_the_next_is_read(monkeypatch):
    """Two blocks were held at a time before."""
    live = weakref.WeakSet()

    class Watched(bpe.Block):
        def __init__(self):
            super().__init__()
            live.add(self)

        def add(self, key, text, split):
            assert len(live) == 1
            super().add(key, text, split)

    class Task:
        @staticmethod
        def get():
            return type("", (), {"partitionId": staticmethod(lambda: 0)})

    monkeypatch.setattr(bpe, "Block", Watched)
    monkeypatch.setattr(bpe, "TaskContext", Task)
    batch = pa.RecordBatch.from_pydict({ID: pa.array(range(6), pa.int64()), TEXT: [f"text number {n}" for n in range(6)]})
    made = list(bpe.block_batches(bpe.blocks([batch], 20), pa.int64()))
    assert len(made) == 12 and sum(b.num_rows - b.column(ID).null_count for b in made) == 6
