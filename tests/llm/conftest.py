import pytest

LONG = "word " * 40_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and an extra column that clashes with operators' own."""
    prose = " ".join(f"w{k} the of and" for k in range(60))
    rows = [(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (2, prose + " tail", "en", None, 2), (3, None, None, "b", None), (4, "", "en", "b", 0), (None, prose, "en", "b", 3), (5, LONG, "xx", "c", 4), (6, " \t\n ", "en", "c", 5), (7, "one two three", "de", "c", 6), (8, "x" * 100_000, "de", "c", 7), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, block long, `slice` long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks and slices for little input."""
    from sparkscan.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(blocks, "SLICE_BYTES", 3_000)
