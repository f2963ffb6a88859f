import tracemalloc

from postsieve.llm.packing import windows


def test_many_documents_of_one_token():
    tracemalloc.start()
    try:
        packed = windows([1] * 200_000, 4096)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(i for w in packed for i in w) == list(range(200_000))
    assert len(packed) == 49 and peak < 300e6
