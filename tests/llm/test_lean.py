"""Tasks give back their memory at their end, however that comes."""

import pyarrow as pa

from logweir.llm import common


def test_memory_is_given_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batches = [pa.record_batch({"a": [k]}) for k in range(3)]
    same = common.lean(lambda rows: (b for b in rows))
    assert list(same(iter(batches))) == batches and len(calls) == 1
    early = same(iter(batches))
    next(early)
    early.close()
    assert len(calls) == 2
    assert common.lean_group(lambda t: t)(pa.table({"a": [1]})).num_rows == 1 and len(calls) == 3


def test_give_back_runs():
    common.give_back()
