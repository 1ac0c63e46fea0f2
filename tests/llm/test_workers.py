"""What Python workers keep between tasks."""

import re
from pathlib import Path

import pyarrow as pa
import pytest

from lexmill.llm import bpe, langid, neardup, storage


def own_mb():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_free_memory_goes_back():
    pieces = [bytes(2000) for _ in range(100_000)]
    held = pieces[::500]  # so that the heap can't just shrink from its end
    pieces = None
    before = own_mb()
    storage.give_back()
    assert own_mb() < before - 100 and len(held) == 200


def test_tasks_end_by_giving_back(monkeypatch):
    calls = []
    for m in (langid, neardup):
        monkeypatch.setattr(m, "give_back", lambda m=m: calls.append(m))
    assert [x.num_rows > 0 for x in langid._count_grams(iter([pa.record_batch([["en"], ["some words"]], names=["lang", "text"])]))] == [True]
    rows = pa.record_batch([[1, 1, 2], [5, 6, 7], *[[0, 1, 0]] * neardup.COMPARED], names=["node", "s1", *"abcd"])
    assert [x.to_pylist() for x in neardup._link_nodes(73)(iter([rows]))] == [[{"u": 6, "v": 5}], []]
    assert calls == [langid, neardup]


def test_kept_encodings_are_forgotten():
    e = bpe.Encoder(*bpe.vocabulary())
    first = e.digest("some words, " + "ab" * 2000)
    e.forget()
    assert not (e.texts or e.raws or e.sizes or e.long or e.held) and e.digest("some words, " + "ab" * 2000) == first
