"""What Python workers hold between slices of a batch."""

import pyarrow as pa
from tidemark.llm import common


def test_arrow_gives_back_what_it_freed_after_every_slice(monkeypatch):
    class Pool:
        given_back = 0

        def release_unused(self):
            self.given_back += 1

    pool = Pool()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 10, "c"])], names=["t"])
    seen = [(s.num_rows, pool.given_back) for s in common.small_batches(batch, "t", 10)]
    assert seen == [(2, 0), (1, 1), (1, 2)] and pool.given_back == 3
